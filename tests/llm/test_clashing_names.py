"""Extra columns named like the operators' own are kept as they are."""

from callscope.llm import chat, decontaminate, phrases, shingle_join, simhash, substring_dedup, toxicity, trie

OWN = ["_k1", "_k2", "row", "rid", "first", "done", "removed", "late", "text_", "__cut", "__spans", "_rid", "_first", "I", "copy", "n_", "key", "node", "lang_", "h"]
TEXT = "This one sentence has rather more words than ten, so that it counts alone."


def docs(spark, repeated):
    rows = [(i, f"{TEXT} Number {i} of some {i * 7} others.", 0, *[f"{c}{i}" for c in OWN]) for i in range(6)] + [(9, None, 0, *OWN), (10, "", 0, *OWN)]
    rows += rows[:2] if repeated else []
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars long", *[f"`{c}` string" for c in OWN]]))


def test_stages_keep_them(spark):
    for repeated in (False, True):
        given = docs(spark, repeated)
        extra = [c for c in OWN if c != "removed"]
        want = {r.doc_id: tuple(r[c] for c in extra) for r in given.collect()}
        benchmark = spark.createDataFrame([("a", TEXT, "x")], "item_id string, text string, __cut string")
        labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "y")], "doc_id long, toxic int, id string")
        for out in (simhash.drop_near_duplicates(given), substring_dedup.drop_repeated_units(given), decontaminate.remove_leaks(given, benchmark), toxicity.drop_toxic(given, labels)):
            assert out.columns == given.columns or out.columns == [*[c for c in given.columns if c != "removed"], "removed"]
            for r in out.collect():
                assert tuple(r[c] for c in extra) == want[r.doc_id]


def test_groups_of_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 1)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    given = docs(spark, False)
    benchmark = spark.createDataFrame([("a", TEXT), ("b", "of some entirely other words that no document of these has at all")], "item_id string, text string")
    out = decontaminate.remove_leaks(given, benchmark)
    assert out.columns == given.columns and not any("rather more words" in (r.text or "") for r in out.collect())


def test_others_read_only_their_own(spark):
    given = docs(spark, True)
    assert shingle_join.join_documents(given).count() == 10 and phrases.collocations(given.withColumnRenamed("lang_", "lang")).count() == 0
    turns = spark.createDataFrame([(100, 0, "user", "hi", "x", "y", 3)], "conv_id long, turn long, role string, text string, block string, h1 string, pos int")
    assert chat.render(turns).count() == 1 and trie.prefix_trie(turns).count() == 2
