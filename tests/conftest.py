import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callscope.schema import CALLS  # noqa: E402
from callscope.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=4, app="callscope-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="callscope-test-ckpt-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s


def call_row(**kw):
    """Unit-test default call: openai gpt-4o, 100/50 tokens, $0.001, 120 ms."""
    base = dict(id="c0", call_ts=dt.datetime(2024, 1, 1, 12, 0, 0), provider="openai", model="gpt-4o",
                endpoint="/v1/chat/completions", status_code=200, latency_ms=120, ttft_ms=None,
                input_tokens=100, output_tokens=50, cost_usd=0.001, request_body='{"model":"gpt-4o"}',
                response_body='{"choices":[]}', error=None, provider_request_id=None, trace_id=None,
                parent_id=None, prompt_hash=None, tags=None, agent_name=None, workflow_id=None, span_name=None)
    base.update(kw)
    return tuple(base[f.name] for f in CALLS.fields)


@pytest.fixture
def make_calls(spark):
    def mk(rows):
        return spark.createDataFrame([call_row(**r) for r in rows], CALLS)
    return mk
