"""Usage statistics: zero-filled calendars, distinct visitors, hours, origins, queries, clicks, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ZONE, local_day


def calendar(spark, last: Column, days: int) -> DataFrame:
    """day: the last day and those before it, ``days`` of them."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def daily_usage(hits: DataFrame, today: Column, days: int = 30, visitor: str = "visitor", zone: str = ZONE) -> DataFrame:
    """day, requests, visitors of each of the last days, 0 where nothing came. Visitors are counted exactly."""
    rows = hits.withColumn("day", local_day("ts", zone))
    per = rows.groupBy("day").agg(F.count("*").alias("requests"), F.countDistinct(visitor).alias("visitors"))
    zero = F.lit(0).cast("long")
    return calendar(hits.sparkSession, today, days).join(per, "day", "left").select("day", F.coalesce("requests", zero).alias("requests"), F.coalesce("visitors", zero).alias("visitors"))


def window_visitors(hits: DataFrame, today: Column, windows: tuple[int, ...] = (1, 7, 30), visitor: str = "visitor", zone: str = ZONE) -> DataFrame:
    """window, requests, visitors: totals of the last days, each visitor once a window. Hits are first reduced to visitor and day."""
    per = hits.withColumn("day", local_day("ts", zone)).groupBy(visitor, "day").agg(F.count("*").alias("n"))
    spans = F.explode(F.array(*(F.lit(w) for w in windows))).alias("window")
    each = per.select("*", spans).filter(F.col("day").between(F.date_sub(today, F.col("window") - 1), today))
    return each.groupBy("window").agg(F.sum("n").alias("requests"), F.countDistinct(visitor).alias("visitors"))


def hours(hits: DataFrame, today: Column, days: int = 30, zone: str = ZONE) -> DataFrame:
    """hour 0 to 23, today's hits and the daily average of the days before it."""
    rows = hits.select(local_day("ts", zone).alias("day"), F.hour(F.from_utc_timestamp("ts", zone)).alias("hour")).filter(F.col("day").between(F.date_sub(today, days), today))
    per = rows.groupBy("hour").agg(F.count(F.when(F.col("day") == today, 1)).alias("today"), F.round(F.count(F.when(F.col("day") < today, 1)) / F.lit(days), 4).alias("average"))
    all_ = hits.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return all_.join(per, "hour", "left").select("hour", F.coalesce("today", F.lit(0).cast("long")).alias("today"), F.coalesce("average", F.lit(0.0)).alias("average"))


def top(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The most frequent values, ties by value: by, n."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *by).limit(limit)


def top_queries(searches: DataFrame, folded: Column, limit: int = 15) -> DataFrame:
    """folded, query (its latest spelling), n of the most frequent queries."""
    rows = searches.withColumn("folded", folded)
    per = rows.groupBy("folded").agg(F.count("*").alias("n"), F.max_by("query", F.struct("ts", "id")).alias("query"))
    return per.orderBy(F.col("n").desc(), "folded").limit(limit)


def window_counts(rows: DataFrame, kind: str, kinds: DataFrame, today: Column, windows: tuple[int, ...] = (1, 7, 30), zone: str = ZONE) -> DataFrame:
    """kind and its count in each window of days, 0 for kinds that did not occur. kinds: the kinds to report, in a column of that name."""
    day = local_day("ts", zone)
    counts = [F.count(F.when(day.between(F.date_sub(today, w - 1), today), 1)).alias(f"days_{w}") for w in windows]
    per = rows.groupBy(kind).agg(*counts)
    return kinds.join(per, kind, "left").select(kind, *(F.coalesce(f"days_{w}", F.lit(0).cast("long")).alias(f"days_{w}") for w in windows))


def funnel(rows: DataFrame, steps: DataFrame, today: Column, windows: tuple[int, ...] = (1, 7, 30), zone: str = ZONE) -> DataFrame:
    """step, place, counts by window and the share of the step before it, over the longest window. steps: step, place."""
    counts = window_counts(rows, "step", steps.select("step"), today, windows, zone).join(steps, "step")
    last = f"days_{windows[-1]}"
    return counts.withColumn("share", F.round(F.try_divide(F.col(last).cast("double"), F.lag(last).over(Window.orderBy("place")).cast("double")), 4))


def merged_logs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new log, and the old one's rows from before the new one began."""
    start = new.agg(F.min("ts").alias("_start"))  # one row
    return new.unionByName(old.join(F.broadcast(start)).filter(F.col("_start").isNull() | (F.col("ts") < F.col("_start"))).select(old.columns))


def people_searches(searches: DataFrame, marks: list[str]) -> DataFrame:
    """Searches that people made: not in the background, without any mark of a batch, and with a text."""
    unmarked = [F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "false", "0") for c in ("background", *marks)]
    out = searches.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    for ok in unmarked:
        out = out.filter(ok)
    return out
