"""The pipeline's stages: columns, what each decides, planted cases, empty documents."""

import corpus_pipeline
import numpy as np
from callscope.llm import byte_bpe, decontaminate, substring_dedup
from pyspark.sql import functions as F


def folder(spark, tmp_path, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_planted_cases(spark, tmp_path):
    rand = np.random.default_rng(8)
    word = lambda: "".join(rand.choice(list("abcdefghij"), int(rand.integers(3, 8))))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    body = lambda: " ".join(said(12) for _ in range(8))
    rows = [(i, body() + (" What a nitwit. " + said(12)) * (i % 4 == 0)) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    passage, item = " ".join(said(14) for _ in range(5)), said(30)
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, f"{said(12)} {passage}"), (303, f"{said(15)} {passage} {said(12)}"), (304, f"{said(20)} {item} {said(20)}"), (305, None), (306, "")]
    path = folder(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in rows], labels, [(1, item)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {i for i in range(200) if i % 4} | {302, 303, 304, 305}  # 306 is 305's copy: both without words
    assert passage in left[302] and passage.split(". ")[1] not in left[303]
    assert item[:-1].lower() not in left[304].lower()
    assert all(left[i] == dict(rows)[i] for i in range(200) if i % 4)
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == set(left)
    whole = byte_bpe.digests(byte_bpe.encode(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")), corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_empty_documents(spark, tmp_path):
    path = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_each_stage_leaves_nothing_to_find(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.col("text").isNotNull())
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    cut = spark.createDataFrame(decontaminate.remove_leaks(docs, bench).collect(), docs.schema)
    assert decontaminate.find_leaks(cut, bench).where(F.size("spans") > 0).count() == 0
    once = spark.createDataFrame(substring_dedup.drop_repeated_units(docs).drop("removed").collect(), docs.schema)
    assert once.count() == docs.count()
