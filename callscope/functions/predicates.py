"""Column predicates and label expressions over the calls schema.

Every builder returns a plain Catalyst ``Column`` so that filters reach the
parquet scan (``PushedFilters``) and stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_ONLY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def is_error_a() -> Column:
    """Error predicate A: error text, HTTP >= 400, or connection failure (status 0)."""
    return F.col("error").isNotNull() | (F.col("status_code") >= 400) | (F.col("status_code") == 0)


def is_error_b() -> Column:
    """Error predicate B: like A but status 0 without error text is not an error."""
    return F.col("error").isNotNull() | (F.col("status_code") >= 400)


def contains_ci(col: str, needle: str) -> Column:
    """Case-insensitive literal substring test (``%``/``_`` are plain characters)."""
    return F.lower(F.col(col)).contains(needle.lower())


def by_model(substr: str) -> Column:
    return contains_ci("model", substr)


def by_provider(substr: str) -> Column:
    return contains_ci("provider", substr)


def by_agent(substr: str) -> Column:
    # NULL agent -> NULL predicate -> row dropped, as required.
    return contains_ci("agent_name", substr)


def by_workflow(workflow_id: str) -> Column:
    return F.col("workflow_id") == F.lit(workflow_id)


def by_tag(tag: str) -> Column:
    return F.col("tags") == F.lit(tag)


def _utc(value: dt.datetime) -> dt.datetime:
    """An instant as naive UTC; a value without an offset is UTC already."""
    return value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def parse_since(value) -> dt.datetime:
    """Lower time bound; a bare date means the start of that UTC day, an offset is converted to UTC."""
    if isinstance(value, dt.datetime):
        return _utc(value)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    s = str(value).strip()
    if _DATE_ONLY.match(s):
        return dt.datetime.strptime(s, "%Y-%m-%d")
    return _utc(dt.datetime.fromisoformat(s.replace("Z", "+00:00")))


def parse_until(value) -> dt.datetime:
    """Upper time bound; a bare date means the end of that day at ms precision, an offset is converted to UTC."""
    if isinstance(value, dt.datetime):
        return _utc(value)
    if isinstance(value, dt.date):
        value = value.isoformat()
    s = str(value).strip()
    if _DATE_ONLY.match(s):
        return dt.datetime.strptime(s, "%Y-%m-%d") + dt.timedelta(days=1, milliseconds=-1)
    return _utc(dt.datetime.fromisoformat(s.replace("Z", "+00:00")))


def ts_literal(value: dt.datetime) -> Column:
    """A naive UTC instant as a timestamp literal, whatever time zone the driver's process has.

    (``F.lit`` of a naive datetime would read it in the process time zone.) The
    expression is constant, so it folds to a literal that reaches the scan.
    """
    return F.timestamp_micros(F.lit((value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)))


def by_time(since=None, until=None) -> Column:
    """Inclusive time window on ``call_ts``; either bound may be omitted."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("call_ts") >= ts_literal(parse_since(since)))
    if until is not None:
        cond = cond & (F.col("call_ts") <= ts_literal(parse_until(until)))
    return cond


def parse_status_range(text: str) -> tuple[int, int]:
    """``"LO-HI"`` -> (lo, hi); raises ValueError on bad text or lo > hi."""
    parts = str(text).strip().split("-")
    if len(parts) != 2:
        raise ValueError(f"status range must look like LO-HI, got {text!r}")
    try:
        lo, hi = int(parts[0].strip()), int(parts[1].strip())
    except ValueError as e:
        raise ValueError(f"status range bounds must be integers: {text!r}") from e
    if not (0 <= lo <= 65535 and 0 <= hi <= 65535):
        raise ValueError(f"status codes out of range: {text!r}")
    if lo > hi:
        raise ValueError(f"status range low bound exceeds high bound: {text!r}")
    return lo, hi


def by_status(code: int) -> Column:
    return F.col("status_code") == F.lit(int(code))


def by_status_range(rng) -> Column:
    lo, hi = parse_status_range(rng) if isinstance(rng, str) else rng
    return F.col("status_code").between(int(lo), int(hi))


def error_class() -> Column:
    """Auth / rate_limit / upstream_5xx / timeout / connection, else NULL.

    Labels are shown only on rows satisfying error predicate A.
    """
    s, e = F.col("status_code"), F.col("error")
    label = (F.when(s.isin(401, 403), "auth")
             .when(s == 429, "rate_limit")
             .when(s >= 500, "upstream_5xx")
             .when((s == 0) & (e.contains("timeout") | e.contains("timed out")), "timeout")
             .when((s == 0) & e.contains("connection"), "connection"))
    return F.when(is_error_a(), label)


def status_class() -> Column:
    """Err (0), 2xx, 4xx, 5xx, else other."""
    s = F.col("status_code")
    return (F.when(s == 0, "err").when(s.between(200, 299), "2xx")
            .when(s.between(400, 499), "4xx").when(s.between(500, 599), "5xx")
            .otherwise("other"))


@dataclass
class CallFilter:
    """The ten optional listing predicates; only those set are emitted."""

    errors_only: bool = False
    model: str | None = None
    provider: str | None = None
    since: object = None
    until: object = None
    status: int | None = None
    status_range: object = None
    agent: str | None = None
    workflow: str | None = None
    tag: str | None = None

    def to_column(self) -> Column:
        parts: list[Column] = []
        if self.errors_only:
            parts.append(is_error_a())
        if self.model is not None:
            parts.append(by_model(self.model))
        if self.provider is not None:
            parts.append(by_provider(self.provider))
        if self.since is not None or self.until is not None:
            if self.since is not None:
                parts.append(F.col("call_ts") >= ts_literal(parse_since(self.since)))
            if self.until is not None:
                parts.append(F.col("call_ts") <= ts_literal(parse_until(self.until)))
        # an exact status wins over a range when both are given
        if self.status is not None:
            parts.append(by_status(self.status))
        elif self.status_range is not None:
            parts.append(by_status_range(self.status_range))
        if self.agent is not None:
            parts.append(by_agent(self.agent))
        if self.workflow is not None:
            parts.append(by_workflow(self.workflow))
        if self.tag is not None:
            parts.append(by_tag(self.tag))
        cond = F.lit(True)
        for p in parts:
            cond = cond & p
        return cond

    def apply(self, df):
        """Filter ``df``; on a date-partitioned store also bound ``call_date`` so
        time-bounded queries read only the matching day partitions."""
        out = df.where(self.to_column())
        if "call_date" in df.columns and (self.since is not None or self.until is not None):
            out = out.where(date_bounds(self.since, self.until))
        return out


def date_bounds(since=None, until=None) -> Column:
    """``call_date`` range implied by a call_ts window (partition pruning on the store)."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("call_date") >= F.lit(parse_since(since).date()))
    if until is not None:
        cond = cond & (F.col("call_date") <= F.lit(parse_until(until).date()))
    return cond


def with_time_window(df, since=None, until=None):
    """Inclusive call_ts window plus the implied call_date bounds when the column exists."""
    out = df.where(by_time(since, until))
    if "call_date" in df.columns:
        out = out.where(date_bounds(since, until))
    return out
