"""Ingestion events read back: every line is parsed once, whatever its body holds."""

import contextlib
import io

from pyspark.sql import functions as F

from callscope.plans import q_readback as rb
from callscope.sources import exports as ex


def _odd(make_calls):
    return make_calls([
        dict(id='a"\\', request_body='{"m":"x\\u00e9\\n\\"","n":[1]}', response_body='{"n":12345678901}', workflow_id="wf-é", agent_name='q"', cost_usd=1e-7),
        dict(id="b", request_body="[1]", response_body='"text"', cost_usd=None, input_tokens=None, error="bad", latency_ms=None),
        dict(id="c", request_body=None, response_body=None, cost_usd=123456789.125, output_tokens=0, workflow_id=""),
        dict(id="d", request_body='{"m":null}', response_body='{"n":null}', cost_usd=0.0)])


def _fields(df, path):
    return {r.id: r.v for r in df.select(F.get_json_object("line", "$.batch[0].body.id").alias("id"), F.get_json_object("line", f"$.batch[0].body.{path}").alias("v")).collect()}


def _check(df):
    lines = ex.langfuse(df)
    got = {r.id: r for r in rb._generation(df).collect()}
    for name, path, kind in (("trace", "traceId", str), ("started", "startTime", str), ("ended", "endTime", str), ("model", "model", str), ("input", "input.m", str), ("output", "output.n", int),
                             ("used_in", "usage.input", int), ("used_out", "usage.output", int), ("used", "usage.total", int), ("cost", "metadata.cost_usd", float),
                             ("agent", "metadata.agent_name", str), ("workflow", "metadata.workflow_id", str), ("level", "level", str)):
        assert {i: r[name] for i, r in got.items()} == {i: None if v is None else kind(v) for i, v in _fields(lines, path).items()}, name
    assert {i for i, r in got.items() if r.has_workflow} == {'a"\\', "c"}


def _lines_parsed(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rb._generation(df).explain()
    return out.getvalue().count("get_json_object(line"), out.getvalue().count("from_json(")


def test_events_with_bodies(make_calls):
    df = _odd(make_calls)
    _check(df)
    assert _lines_parsed(df) == (0, 1)  # it was parsed for each of 14 fields


def test_events_without_bodies(make_calls):
    df = ex.without_bodies(_odd(make_calls))
    _check(df)
    assert _lines_parsed(df) == (0, 1)
