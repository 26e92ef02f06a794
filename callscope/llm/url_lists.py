"""URL filters: every capture is judged by the list entries that were active when it was fetched.

A list's history is a table of dated changes. The changes to one entry become validity
intervals; a capture is joined to the intervals of the entries that can match its URL, as of
its fetch time, and the most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import prepare, spool

#: Days that a time bucket has: an entry's captures and intervals are joined bucket by bucket.
BUCKET_DAYS = 30
#: Precedence of a match, from the strongest.
KINDS = {"url": 3, "host": 2, "domain": 1}


def host_of(url):
    """Lower-cased host of a URL without user, port or final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def page_of(url):
    """The URL that ``url`` entries name: lower-cased scheme and host, with path and query as they are, without fragment."""
    head = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    whole = F.regexp_replace(url, "#.*$", "")
    return F.concat(F.lower(head), F.substr(whole, F.length(head) + 1))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """Changes (``kind``, ``entry``, ``action``, ``changed_at``) to intervals (``kind``, ``entry``, ``action``, ``since``, ``until``).

    An action (``block``, ``allow`` or ``remove``) holds from its time up to the entry's next
    change; the last has no ``until``. Removals end an interval and begin none. Of changes to an
    entry at one time the alphabetically first action holds; changes with a null or an unknown
    kind are left out.
    """
    ok = changes.select("kind", "entry", "action", "changed_at").where("entry is not null and action in ('allow', 'block', 'remove') and changed_at is not null").where(F.col("kind").isin(*KINDS))
    one = ok.groupBy("kind", "entry", "changed_at").agg(F.min("action").alias("action"))
    following = F.lead("changed_at").over(W.partitionBy("kind", "entry").orderBy("changed_at"))
    return one.select("kind", "entry", "action", F.col("changed_at").alias("since"), following.alias("until")).where("action != 'remove'")


def _bucket(time):
    return F.floor(F.unix_micros(time) / (BUCKET_DAYS * 86_400_000_000))


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``id_col``, ``url_col``, ``time_col``, ``verdict``, ``kind``, ``entry`` and ``since`` for each capture.

    A ``url`` entry matches that page, a ``host`` entry that host, a ``domain`` entry the host and
    all below it; the strongest kind decides, then the longest entry. Without an active entry,
    or with a null URL or time, the verdict is ``allow`` and the entry null. Rows that repeat id,
    URL and time are judged alike. Captures are joined on (page, time bucket) and on (host, time
    bucket), for which Spark splits a hot host; host and domain entries are looked up once for
    each host and bucket, so that a top-level domain has a key a host, not a capture. Of the list
    nothing goes by the driver, which gets the captures' time range only; an interval is copied
    to the buckets of that range that it touches.
    Empty tables give no rows or verdicts without entry; other columns are not read.
    """
    prepare(captures.sparkSession)
    ids = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").alias("at")]
    rows = captures.select(*ids)
    dated = rows.where("url is not null and at is not null")
    # equal captures are judged once
    asked = dated.groupBy("url", "at").agg(F.count(F.lit(1)).alias("_n")).select("url", "at", _bucket(F.col("at")).alias("bucket"))
    # an interval goes to each bucket of the captures' time range that it touches
    low, high = dated.agg(F.min(_bucket(F.col("at"))), F.max(_bucket(F.col("at")))).first()
    if low is None:
        low, high = 0, -1
    begin = F.greatest(F.lit(low), _bucket(F.col("since")))
    end = F.least(F.lit(high), F.coalesce(_bucket(F.col("until")), F.lit(high)))
    spread = spool(validity_intervals(changes), "list-intervals").where(begin <= end).withColumn("bucket", F.explode(F.sequence(begin, end)))
    # merge: Spark takes the copies for as small as the list's file, and the driver would have to hold them for a broadcast
    listed = lambda of: spread.where(of).hint("merge")
    found = ["url", "at", "kind", "entry", "action", "since", "until"]
    pages = asked.withColumn("entry", page_of(F.col("url"))).join(listed("kind = 'url'"), ["entry", "bucket"]).select(*found)
    # what names a host in a bucket does so for all its captures there
    hosted = asked.withColumn("host", host_of(F.col("url"))).where("host is not null")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    single = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("entry")))
    keys = hosted.select("host", "bucket").distinct().select("host", "bucket", F.explode(F.concat(single, domains)).alias("key")).select("host", "bucket", "key.kind", "key.entry")
    naming = keys.join(listed("kind != 'url'"), ["kind", "entry", "bucket"])
    active = pages.union(hosted.join(naming, ["host", "bucket"]).select(*found)).where("since <= at and (until is null or at < until)")
    strength = F.struct(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")].alias("s"), F.length("entry").alias("l"), "entry", "kind", "action", "since")
    best = active.groupBy("url", "at").agg(F.max(strength).alias("best"))
    return rows.join(best, ["url", "at"], "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), F.coalesce("best.action", F.lit("allow")).alias("verdict"), "best.kind", "best.entry", "best.since")
