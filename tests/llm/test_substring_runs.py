"""Repeated passages of short sentences, whatever stands around them."""

from random import Random

import pytest
from callscope.llm.substring_dedup import cut, drop_repeated_units, units

LONG = "This sentence has rather more than ten words in it, so it counts."
SHORT = [f"Short sentence {k} has only eight words {k}." for k in range(8)]


@pytest.mark.parametrize("sep", [" ", "\n", "\n\n"])
def test_short_sentences_after_other_leads(spark, sep):
    passage = sep.join(SHORT)
    docs = spark.createDataFrame([(1, f"A lead of the first document, with more than ten words of its own.{sep}{passage}{sep}The first one ends."),
                                  (2, f"Quite another lead stands here in the second document, also over ten words.{sep}{passage}{sep}So does the second."),
                                  (3, f"Third.{sep}Yes.{sep}{LONG}"), (4, f"Fourth.{sep}Yes.{sep}{LONG}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_units(docs).collect()}
    assert all(s in got[1] for s in SHORT) and not any(s in got[2] for s in SHORT)
    assert got[2].startswith("Quite another lead") and got[2].endswith("So does the second.")
    # a short sentence before a repeated long one goes with it
    assert "".join(got[4].split()) == "Fourth."


def test_own_repeats_keep_one_occurrence():
    text = "Again so. " * 30  # runs of five units, which overlap
    assert cut(text, set())[0] == "Again so. " * 5
    verse = "One short line.\nTwo short lines.\nThree short lines.\nFour short lines.\n"
    assert "".join(cut(verse + "Between.\n" + verse, set())[0].split()) == "".join((verse + "Between.").split())


def test_every_unit_of_a_repeated_passage_goes():
    random = Random(3)
    for case in range(300):
        said = [" ".join(f"w{case}x{k}x{j}" for j in range(random.choice([1, 2, 4, 8, 9, 10, 15]))) + "." for k in range(random.randrange(2, 9))]
        if sum(len(s.split()) for s in said) < 10:
            continue
        first = {d for r in units("First. " + " ".join(said) + " One.")[1] if r for _, d in r}
        assert cut("Second. " + " ".join(said) + " Two.", first)[0] == "Second. Two."
