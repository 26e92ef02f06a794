"""Calendar views over daily stats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.predicates import is_error_a, parse_since, utc_now, with_time_window


def calendar_fill(df: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """The last ``days`` UTC dates up to ``as_of``, zero-filled where no calls.

    The calendar is generated with ``sequence`` (``days`` rows, bounded by
    the argument) and left-joined to a per-day aggregate of the calls.
    """
    spark = df.sparkSession
    end = (parse_since(as_of) if as_of is not None else utc_now()).date()
    start = end - dt.timedelta(days=int(days) - 1)
    cal = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    midnight = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
    daily = (with_time_window(df, since=start, until=midnight - dt.timedelta(microseconds=1))
             .groupBy(F.to_date("call_ts").alias("date"))
             .agg(F.count(F.lit(1)).alias("calls"),
                  F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
                  F.count_if(is_error_a()).alias("error_count")))
    return (cal.join(daily, "date", "left")
            .select("date", F.coalesce("calls", F.lit(0)).alias("calls"),
                    F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
                    F.coalesce("error_count", F.lit(0)).alias("error_count"))
            .orderBy("date"))


def heat_intensity(calendar: DataFrame) -> DataFrame:
    """each day's cost relative to the most expensive day, plus an error flag.

    Runs on the calendar (one row per day), so the unpartitioned window
    covers at most ``days`` rows.
    """
    mx = F.max("cost_usd").over(Window.partitionBy())
    return calendar.select(
        "*", F.when(mx > 0, F.col("cost_usd") / mx).otherwise(F.lit(0.0)).alias("intensity"),
        (F.col("error_count") > 0).alias("has_error"))
