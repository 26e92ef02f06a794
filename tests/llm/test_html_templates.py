"""Whole pages of templates that the made layouts do not have: the article's blocks of all kinds, and nothing beside them."""

import random
import re
import time

import pytest
from callscope.llm.html_text import BiLstm, block_vectors, leaf_blocks, made_layouts

SAID = "the river runs past old houses where people sit, talk and wait for boats that come late in the day with news from towns far up the valley".split()


def sentence(rand, n=None):
    return " ".join(rand.choice(SAID) for _ in range(n or rand.randrange(7, 22))).capitalize() + "."


def article(rand):
    """(html, text) of an article with every kind of block."""
    parts = [("h1", sentence(rand, 5))]
    kinds = ["p"] * 6 + ["h2", "ul", "table", "pre", "figure", "blockquote", "dl", "p", "ol"]
    rand.shuffle(kinds)
    out, text = [f"<h1>{parts[0][1]}</h1><p>{(lead := sentence(rand))}</p>"], [parts[0][1], lead]
    for kind in kinds:
        some = [sentence(rand, rand.randrange(3, 12)) for _ in range(rand.randrange(2, 5))]
        if kind in ("p", "h2", "pre"):
            body = " ".join(some) if kind == "p" else some[0]
            out.append(f"<{kind}>{body}</{kind}>")
            text.append(body)
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{s}</li>" for s in some) + f"</{kind}>")
            text += some
        elif kind == "table":
            cells = [[sentence(rand, 2), str(rand.randrange(999))] for _ in some]
            out.append("<table><tr><th>Place</th><th>Number</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in cells) + "</table>")
            text += ["Place", "Number", *(c for row in cells for c in row)]
        elif kind == "figure":
            out.append(f"<figure><img src=x><figcaption>{some[0]}</figcaption></figure>")
            text.append(some[0])
        elif kind == "blockquote":
            out.append(f"<blockquote><p>{some[0]}</p></blockquote>")
            text.append(some[0])
        else:
            out.append(f"<dl><dt>{some[0]}</dt><dd>{some[1]}</dd></dl>")
            text += some[:2]
    return out, text


NAV = "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("home", "world", "sport", "culture", "contact")) + "</ul>"
COOKIES = "<p>We use cookies to improve your visit. Accept all or manage your choices.</p>"
REPLIES = "<p>Great post, thanks!</p><p>I do not agree with this at all.</p><p>bob says: me too</p>"


def page(template, rand):
    """(html, the article's text) of one of six templates."""
    parts, text = article(rand)
    cut = rand.randrange(3, len(parts))
    a, b = "".join(parts[:cut]), "".join(parts[cut:])
    if template == 0:
        body = f"<nav>{NAV}</nav><article>{a}{b}</article><footer><p>© 2023 The paper. All rights reserved.</p></footer>"
    elif template == 1:
        body = f"<header><div class=logo>The paper</div>{NAV}</header><main><article>{a}<div class='cookie-notice'>{COOKIES}</div>{b}</article></main><aside><h3>Most read</h3>{NAV}</aside>"
    elif template == 2:
        body = f"<div class='page'><div class='menu'>{NAV}</div><div class='post'>{a}{b}<p class='copyright'>© 2020 The authors</p></div><div class='comments'>{REPLIES}</div></div>"
    elif template == 3:
        body = f"<article>{a}{b}</article><section class='zufa'><div class='kilor'>{REPLIES}</div></section><footer>Terms of use · Privacy policy</footer>"
    elif template == 4:
        body = f"<div class='top'>{NAV}</div><div class='main-content'>{a}<div class='ad'>Buy now and save</div>{b}</div><form><p>Subscribe to our newsletter</p><input><button>Send</button></form><div class='sidebar'>{NAV}</div>"
    else:
        body = f"<div class='cookie-banner'>{COOKIES}</div><main>{a}{b}<div class='related'>{NAV}</div></main><div id='footer'>Copyright 2022 by the paper. All rights reserved.</div>"
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>", text


@pytest.fixture(scope="module")
def model():
    rand = random.Random(1)
    texts = [" ".join(f"{rand.choice('aeiou')}{rand.choice('bdfglmnrst')}{rand.choice('aeiou')}{k % 7}" for k in range(rand.randrange(6, 60))) + "." for _ in range(400)]
    return BiLstm().train([(block_vectors(b), y) for b, y in made_layouts(texts, ["home", "about us", "news"], 720)])


@pytest.mark.parametrize("template", range(6))
def test_articles_of_unseen_templates(model, template):
    rand = random.Random(template)
    whole, kept, dropped, all_in, all_out = 0, 0, 0, 0, 0
    for _ in range(25):
        html, text = page(template, rand)
        blocks = leaf_blocks(html)
        keep = model.label([block_vectors(blocks)])[0]
        got = [b[1] for b, k in zip(blocks, keep, strict=True) if k]
        whole += got == text
        want = list(text)
        inside = []
        for b in blocks:
            own = bool(want) and b[1] == want[0]
            inside.append(own)
            if own:
                want.pop(0)
        assert not want
        all_in += sum(inside)
        all_out += len(inside) - sum(inside)
        kept += sum(k and i for k, i in zip(keep, inside, strict=True))
        dropped += sum(not k and not i for k, i in zip(keep, inside, strict=True))
    print(f"template {template}: whole {whole}/25, kept {kept}/{all_in}, dropped {dropped}/{all_out}")
    assert kept >= 0.98 * all_in and dropped >= 0.95 * all_out and whole >= 15


def test_a_page_of_many_blocks_is_labelled_alike(model):
    rand = random.Random(8)
    blocks = leaf_blocks(re.sub("</?article>", "", page(2, rand)[0]) * 30)
    assert (model.label_long(blocks, 64) == model.label([block_vectors(blocks)])[0]).mean() > 0.999


def test_many_blocks_take_little_memory(model):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.process_time()
    blocks = leaf_blocks("<article>" + "<p>some words here" * 200_000 + "</article>")
    model.label_long(blocks)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB: 1.5 GB at a million blocks
    assert time.process_time() - began < 120
