"""Repeated units against a plain pass over the corpus in rank order."""

import re

import pytest
from callscope.llm import registry
from callscope.llm.substring_dedup import drop_repeated_units, units

SEP = {"line": r"\n+", "paragraph": r"\n[^\S\n]*\n\s*", "sentence": r"[.!?]+\s+|\n+"}


def plain_runs(sizes, least):
    """(first, last) of the shortest runs of at least ``least`` words that begin or end with each unit."""
    out = set()
    for k in range(len(sizes)):
        out |= {min(((k, e) for e in range(k, len(sizes)) if sum(sizes[k : e + 1]) >= least), default=None)}
        out |= {max(((s, k) for s in range(k + 1) if sum(sizes[s : k + 1]) >= least), default=None)}
    return sorted(out - {None}, key=lambda r: (r[1], r[0]))


def plain(texts, by="sentence", least=10):
    """Texts without white space, after one pass in order: a run that stood before goes, whatever became of it there."""
    before = set()
    for text in texts:
        text = text or ""
        cuts = [0, *(m.end() for m in re.finditer(SEP[by], text)), len(text)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        said = [(k, w) for k, p in enumerate(parts) if (w := tuple(re.findall(r"\w+", p.lower())))]
        own, gone = {}, set()
        for first, last in plain_runs([len(w) for _, w in said], least):
            key = tuple(w for _, w in said[first : last + 1])
            if key in before:
                gone |= set(range(first, last + 1))
            elif key in own:
                gone |= set(range(max(first, own[key] + 1), last + 1))
            else:
                own[key] = last
        before |= own.keys()
        gone = {said[k][0] for k in gone}
        # units without words between units that go stay as they are
        yield "".join("".join(p for k, p in enumerate(parts) if k not in gone).split())


LONG = "This sentence has rather more than ten words in it, so it counts."
OTHER = "Another one of many words follows here and is kept for some time."


@pytest.mark.parametrize("by", ["line", "paragraph", "sentence"])
def test_edge_rows(spark, by):
    texts = [None, "", "\n\n", LONG, f"Begin. {LONG} Short tail. End", f"{OTHER} {LONG}\nnext line\n\n{LONG.upper()}\n\nlast", f"{LONG}  Short tail. {OTHER}\n{OTHER}",
             "short\nshort\nshort", f"{LONG} Short tail. No repeat of it.", (OTHER + "\n") * 300, LONG]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, removed string")
    got = drop_repeated_units(docs, by=by).orderBy("doc_id").collect()
    assert ["".join((r.text or "").split()) for r in got] == list(plain(texts, by))
    assert got[0].text is None and got[1].text == ""
    for r, t in zip(got, texts, strict=True):
        if t is None:
            continue
        at, rest = 0, ""
        for s in r.removed:
            rest, at = rest + t[at : s.start], s.end
        assert rest + t[at:] == r.text and r.n_chars == len(r.text)
    assert drop_repeated_units(docs.limit(0), by=by).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(2, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (2, OTHER, "b"), (None, OTHER, "c"), (None, None, "d"), (1, "x " + LONG, "e"), (3, OTHER, "f"), (3, OTHER, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = drop_repeated_units(docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.text or "", r.extra) for r in got) == sorted(
        [("2", LONG, "a"), ("2", "", "a"), ("2", "", "a"), ("2", OTHER, "b"), ("None", "", "c"), ("None", "", "d"), ("1", "x " + LONG, "e"), ("3", "", "f"), ("3", "", "f")])


def test_long_passage_in_other_lines(spark):
    passage = " ".join(f"{LONG[:-1]} {k}." for k in range(6))
    docs = spark.createDataFrame([(1, f"Own words first. {passage} Own end."), (2, f"A wholly other begin! {passage}\nAnd more.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_units(docs).collect()}
    assert got[1].count("rather more") == 6 and got[2] == "A wholly other begin! \nAnd more."


def test_units_tile_the_text():
    text = "A b. C d!  E\n\nF? g\n"
    bounds, digests = units(text)
    assert bounds == [0, 5, 11, 14, 17, 19] and digests == [None] * 5
    assert units("") == ([0], [])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in registry.op8_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert ["".join((got[r.doc_id].text or "").split()) for r in docs] == list(plain([r.text for r in docs]))
    assert sum(r.n_removed for r in got.values()) > 0
