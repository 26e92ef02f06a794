"""Chat snapshot collapse against plain prefix comparison."""

import random

import duckdb
from callscope.llm import chat, registry


def plain(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn is None, turn or 0, role is not None, role or "", text is not None, text or ""))
    convs = {c: tuple(t[2:] for t in sorted(ts)) for c, ts in convs.items()}
    classes = {}
    for c, ts in convs.items():
        classes.setdefault(ts, []).append(c)
    prefixes = {ts[:i] for ts in classes for i in range(1, len(ts))}
    for ts, cs in classes.items():
        if ts not in prefixes:
            yield min(cs), len(ts), len(cs), "\n".join(f"<|im_start|>{r}\n{t}<|im_end|>" for _, r, _, t in ts)


def check(spark, rows):
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    assert sorted(tuple(r) for r in chat.render(turns).collect()) == sorted(plain(rows))


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 10, "user", "more"),
            (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, None, None), (6, 0, "", ""), (6, 1, "user", "x"), (7, None, "user", "null turn"), (7, 0, "user", "first"),
            (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (None, 0, "user", "no id"), (9, 0, "user", "y" * 200_000), (10, 0, "user", "y" * 200_000), (2, 0, "user", "hi"), (11, 0, "hi", "user")]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(empty).count() == 0


def test_snapshots_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rand, rows = random.Random(3), []
    for c in range(60):
        script = [(t, rand.choice(["user", "assistant"]), rand.choice("ab")) for t in range(30)] if c % 6 == 0 else script  # noqa: F821
        n = rand.randrange(1, 31)
        rows += [(c, t * 3 + c, r, x) for t, r, x in script[:n]]  # places count, turn numbers do not
    check(spark, rows)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet'")
    assert sorted(tuple(r) for r in registry.op7_chat(spark, path).collect()) == sorted(con.sql(chat.ORACLE).fetchall())


def test_main_path_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = chat.render(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
