"""A body is parsed once for its system prompt, and the prompt's bytes are told apart once."""

import contextlib
import io

from pyspark.sql import functions as F

from callscope.functions import jsonx as J


def _fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return f"{h:016x}"


def test_fingerprint_of_any_text(spark):
    texts = ["", "a", "é", "日本", "😀x", "\0", "a\0b", "\r\n\t", "ÿ" * 300, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", J.fnv1a64_hex(F.col("s")).alias("h")).collect()
    assert {r.i: r.h for r in rows} == {i: None if t is None else _fnv(t) for i, t in enumerate(texts)}


def test_system_prompt_of_odd_bodies(spark):
    bodies = {'{"system":"  hi "}': "hi", '{"system":" ","messages":[{"role":"system","content":"x"}]}': None, '{"system":1,"messages":[{"role":"user"},{"role":"system","content":"x"},{"role":"system","content":"y"}]}': "x",
              '{"messages":[{"role":"system","content":4}]}': None, '{"messages":{}}': None, "{": None, "null": None, "": None}
    df = spark.createDataFrame([(b,) for b in [*bodies, None]], "b string").select("b", J.system_prompt(F.col("b")).alias("p"), J.prompt_hash(F.col("b")).alias("h"))
    assert {r.b: (r.p, r.h) for r in df.collect()} == {b: (p, None if p is None else _fnv(p)) for b, p in {**bodies, None: None}.items()}


def test_body_is_parsed_once(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.createDataFrame([("{}",)], "b string").select(J.prompt_hash(F.col("b"))).explain("extended")
    physical = out.getvalue().split("== Physical Plan ==")[1]
    assert physical.count("parseJson") == 1  # it stood inside the loop over bytes
