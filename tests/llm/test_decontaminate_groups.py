"""A benchmark of several passes cuts what one pass cuts."""

import random

from callscope.llm import decontaminate


def rows(frame):
    return sorted((str(r.doc_id), r.text or "", str(r.text), r.n_chars, r.spans) for r in frame.collect())


def test_groups_cut_as_one_pass(spark, monkeypatch):
    w = [f"w{i}" for i in range(1, 30)]
    halves = "a b c d e f g h i j"
    # windows that overlap a cut of another item's, in either order; and a window that a cut brings together
    items = [(1, " ".join(w[:20])), (2, " ".join(w[14:25])), (3, halves), (4, "k l m n o p q r s t")]
    docs = [(1, "Before. " + " ".join(w) + " after."), (2, f"a b c d e {' '.join(w[:20])} f g h i j"), (2, f"a b c d e {' '.join(w[:20])} f g h i j"),
            (3, f"k l m n o {halves} p q r s t"), (4, "a b c d e k l m n o p q r s t f g h i j"), (5, None), (6, ""), (None, "clean, as it was")]
    rand = random.Random(7)
    for n in range(60):
        text = [rand.choice("uvxyz") for _ in range(rand.randrange(60))]
        docs.append((100 + n, " ".join(text)))
        items.append((100 + n, " ".join(rand.choice("uvxyz") for _ in range(rand.choice([3, 5, 6])))))
    frame = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in docs], "doc_id long, text string, n_chars long, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = rows(decontaminate.remove_leaks(frame, bench))
    for chars, blocks in ((100, 1), (60, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
        got = decontaminate.remove_leaks(frame, bench)
        assert got.columns == frame.columns and rows(got) == once
    assert ("1", "Before.  w26 w27 w28 w29 after.") in [r[:2] for r in once]
    assert all(n == len(t) for _, t, _, n, _ in once)
