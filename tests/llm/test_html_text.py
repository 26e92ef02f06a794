"""Block labeller: parsing, gradients, held-out layouts and edge pages."""

import html
import re

import numpy as np
from callscope.llm import html_text, registry
from callscope.llm.html_text import BiLstm, block_vectors, leaf_blocks, made_layouts


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class='x y'><p>One &amp; <b>two</b>
      three<br>four<p>five<ul><li>a<li><a href="q?a>b">link &eacute;</a></ul><!-- <p>no</p> --><style>p{}</style>tail < 3 <textarea>no</textarea>"""
    got = leaf_blocks(page)
    assert [b[1] for b in got] == ["One & two three four", "five", "a", "link é", "tail < 3"]
    assert got[0][0] == ("html", "body", ".x", ".y", "p") and got[2][0][-2:] == ("ul", "li")
    assert got[3][2] > 0.9 and got[0][2] == 0
    for odd in ("", "   ", "<", "<p", "plain", "</p></div>", "<!-- open", "<script>never ends", "<p " + "a='" * 50, "&#0;&bogus;&nbsp;"):
        leaf_blocks(odd)
    assert leaf_blocks("plain &lt;b&gt;")[0][1] == "plain <b>"


def test_gradients():
    model = BiLstm()
    random = np.random.default_rng(1)
    x = random.normal(size=(5, 3, html_text.WIDTH)).astype(np.float32) * 0.3
    on = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    y = random.integers(0, 2, on.shape).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        z = model.logits(x, on).astype(np.float64)
        return (np.where(on, np.logaddexp(0, z) - y * z, 0)).sum() / on.sum()

    g = model.gradients(x, on, y)
    for name in model.p:
        at = tuple(random.integers(0, n) for n in model.p[name].shape)
        eps, before = 1e-2, model.p[name][at]
        model.p[name][at] = before + eps
        up = loss()
        model.p[name][at] = before - eps
        down = loss()
        model.p[name][at] = before
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3, name


def test_held_out_layouts(monkeypatch):
    texts = [f"Sentence number {i} says a little, as sentences of an article do." for i in range(200)]
    links = ["home", "about us", "contact", "news"]
    train = [(block_vectors(b), y) for b, y in made_layouts(texts[:100], links, html_text.LAYOUTS)]
    model = BiLstm().train(train)
    pages = list(made_layouts(texts[100:], links, 100, seed=77))
    labels = model.label([block_vectors(b) for b, _ in pages])
    assert np.mean(np.concatenate([got == (y > 0) for got, (_, y) in zip(labels, pages, strict=True)])) > 0.97


def test_edge_pages(spark):
    body = "<nav><ul><li><a href=x>m</a></ul></nav><article><h1>T &lt; 1</h1><p>Text  of\nit.<br>On.<p>" + "More words. " * 40_000 + "</p></article><footer>&copy; f</footer>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", body), (3, "u", body), (None, "u", "<p"), (4, "u", "<script>x</script>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[4].text == "" and by[2].url is None
    assert by[3].text == "T < 1\nText of it. On.\n" + " ".join(["More words."] * 40_000)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    for r in registry.op4_html_text(spark, path).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
