"""callscope: Spark-native analytics over logs of LLM API calls.

Raw request/response exchanges become one typed ``calls`` table; every
question over that table (listings, breakdowns, percentiles, search,
pricing, timelines, exports, live metrics) is a DataFrame operator.
"""

from callscope.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["get_spark", "scratch_dir"]
