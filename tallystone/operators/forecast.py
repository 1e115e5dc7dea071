"""Forecasts and what became of them: outcomes, validation, gates, transfer curves, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as S

TREND = 0.02


def outcomes(forecasts: DataFrame, points: DataFrame, key: list[str], order: list[str], now: Column) -> DataFrame:
    """forecasts (key, id, generated_at, horizon, range_low, range_high, trend, baseline, expected) with status, hit_day, days_elapsed, error_percent.

    A forecast looks at the last price of each local day of its horizon: the
    first in its range, or beyond the trend, is a hit.
    """
    f = forecasts.withColumn("_start", F.date_add(S.local_day("generated_at"), 1))
    daily = S.last_per_day(points.filter("price > 0"), key, order)
    x = f.join(daily, key, "left").withColumn("_i", F.datediff("day", "_start") + 1)
    inside = F.col("_i").between(1, F.col("horizon"))
    low, high, base, p = (F.col(c) for c in ("range_low", "range_high", "baseline", "price"))
    hit = p.between(low, high) | ((F.col("trend") == "down") & (p <= base * (1 - TREND))) | ((F.col("trend") == "up") & (p >= base * (1 + TREND)))
    agg = x.groupBy("id").agg(
        F.min(F.when(inside & F.coalesce(hit, F.lit(False)), F.col("_i"))).alias("hit_day"),
        F.count(F.when(inside, 1)).alias("_actual"),
        F.max_by("price", F.when(inside, F.col("_i"))).alias("_last"),
    )
    out = f.join(agg, "id")
    elapsed = F.greatest(F.lit(0), F.least(F.col("horizon"), F.datediff(S.local_day(now), F.col("_start")) + 1))
    status = F.when(F.col("hit_day").isNotNull(), "hit").when(F.col("days_elapsed") < F.col("horizon"), "pending").when(F.col("_actual") > 0, "miss").otherwise("expired")
    error = F.when((F.col("_actual") > 0) & (F.col("expected") > 0), F.round(F.abs(F.col("_last") - F.col("expected")) * 100 / F.col("expected"), 1))
    return out.withColumn("days_elapsed", elapsed).withColumns({"status": status, "error_percent": error}).drop("_start", "_actual", "_last")


def outcome_stats(rows: DataFrame, by: str) -> DataFrame:
    """by: counts of each status, hit_rate of what is decided, medians of days to a hit and of the error."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = rows.groupBy(by).agg(n("hit"), n("miss"), n("expired"), n("pending"), F.median("hit_day").alias("median_days"), F.round(F.median("error_percent"), 4).alias("median_error"))
    return out.withColumn("hit_rate", F.round(F.try_divide(F.col("hit").cast("double"), (F.col("hit") + F.col("miss")).cast("double")), 4))


def validation(rows: DataFrame) -> DataFrame:
    """One row of (last, predicted, actual) arrays: series, mean absolute error of the model and of repeating the last value, improvement, direction accuracy."""
    pairs = F.arrays_zip(F.col("predicted").alias("p"), F.col("actual").alias("a"))
    n = F.least(F.size("predicted"), F.size("actual"))
    total = lambda f: F.aggregate(F.slice(pairs, 1, n), F.lit(0.0).cast("double"), lambda s, x: s + f(x))
    x = rows.filter((n > 0) & F.col("last").isNotNull()).select(
        "last",
        (total(lambda v: F.abs(v["p"] - v["a"])) / n).alias("_model"),
        (total(lambda v: F.abs(F.col("last") - v["a"])) / n).alias("_base"),
        (total(lambda v: v["p"].cast("double")) / n - F.col("last")).alias("_dp"),
        (total(lambda v: v["a"].cast("double")) / n - F.col("last")).alias("_da"),
    )
    right = F.when(F.col("_da") != 0, (F.col("_dp") > 0) == (F.col("_da") > 0)).otherwise(F.abs("_dp") < F.greatest(F.lit(1.0), F.col("last") * 0.02))
    agg = x.agg(F.count("*").alias("series"), F.avg("_model").alias("_m"), F.avg("_base").alias("_b"), F.round(F.avg(right.cast("double")), 4).alias("direction_accuracy"))
    return agg.select("series", F.round("_m", 2).alias("model_mae"), F.round("_b", 2).alias("baseline_mae"), F.round((F.col("_b") - F.col("_m")) * 100 / F.col("_b"), 2).alias("improvement"), "direction_accuracy")


def gate(series: Column, improvement: Column, direction: Column, least_series: int = 30, least_improvement: float = 5, least_direction: float = 0.55) -> Column:
    return (series >= least_series) & (improvement >= least_improvement) & (direction >= least_direction)


def transfer_curve(points: DataFrame, event: list[str], order: list[str], horizon: int, percentiles: tuple[float, ...] = (0.2, 0.5, 0.8), least_events: int = 2) -> DataFrame:
    """day (1 to horizon) and percentiles over events of each event's mean price that day relative to its opening price, carried forward."""
    w = Window.partitionBy(*event).orderBy(*order)
    rows = points.withColumns({"_open": F.first("price").over(w), "_first": F.min(F.to_date("ts")).over(Window.partitionBy(*event))})
    rows = rows.withColumn("day", F.datediff(F.to_date("ts"), "_first") + 1).filter(F.col("day") <= horizon)
    per = rows.groupBy(*event, "day").agg((F.avg("price") / F.first("_open")).alias("ratio"))
    days = per.select(*event).distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    carry = F.last("ratio", ignorenulls=True).over(Window.partitionBy(*event).orderBy("day"))
    full = days.join(per, [*event, "day"], "left").withColumn("ratio", carry)
    return full.groupBy("day").agg(F.count("*").alias("events"), *(F.round(F.percentile("ratio", F.lit(p)), 4).alias(f"p{int(p * 100)}") for p in percentiles)).filter(F.col("events") >= least_events)


def summary(points: Column, current: Column, observations: Column, high: int = 90, medium: int = 30) -> Column:
    """Struct mean, trend (2 percent), confidence by the number of observations, of an array of projected prices."""
    mean = F.aggregate(points, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(points)
    trend = F.when(mean <= current * (1 - TREND), "down").when(mean >= current * (1 + TREND), "up").otherwise("stable")
    return F.struct(F.round(mean, 2).alias("mean"), trend.alias("trend"), F.when(observations >= high, "high").when(observations >= medium, "medium").otherwise("low").alias("confidence"))


def supported_drop(points: Column, upper: Column, current: Column, least: float = 0.6) -> Column:
    """The mean is below the current price, and so is the upper band on a share of the days."""
    mean = F.aggregate(points, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(points)
    below = F.size(F.filter(upper, lambda x: x < current)) / F.size(upper)
    return (mean <= current * (1 - TREND)) & (below >= least)


def unseen(snapshots: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return snapshots.join(old.select(*key).distinct(), key, "left_anti")


def upper_quantile(quantiles: Column, least: float = 0.8, days: int = 7) -> Column:
    """The valid values of the highest quantile from ``least`` on, of a map of names to arrays; null for none."""
    usable = F.filter(F.map_entries(quantiles), lambda e: e["key"].try_cast("double") >= least)
    highest = F.array_max(F.transform(usable, lambda e: F.struct(e["key"].try_cast("double").alias("q"), F.filter(F.slice(e["value"], 1, days), lambda v: v > 0).alias("v"))))
    return highest["v"]


def price_signal(points: Column, quantiles: Column, current: Column) -> Column:
    """Struct status (exceptional below all quantiles, above_expected over them, within_expected) and difference_percent from the mean."""
    mean = F.aggregate(points, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(points)
    values = F.flatten(F.map_values(quantiles))
    status = F.when(current < F.array_min(values), "exceptional").when(current > F.array_max(values), "above_expected").otherwise("within_expected")
    return F.struct(status.alias("status"), (F.round((current - mean) * 100 / mean, 1) + F.lit(0.0)).alias("difference_percent"))


def eta_days(points: Column, trend: Column, low: Column, high: Column, base: Column, horizon: int) -> Column:
    """The first day, from 1, whose projected price is in the range or beyond the trend; the last one for none."""
    hit = lambda p: p.between(low, high) | ((trend == "down") & (p <= base * (1 - TREND))) | ((trend == "up") & (p >= base * (1 + TREND)))
    days = F.filter(F.transform(points, lambda p, i: F.when(F.coalesce(hit(p), F.lit(False)), i + 1)), lambda d: d.isNotNull())
    return F.coalesce(F.array_min(days), F.greatest(F.lit(1), F.least(F.lit(horizon), F.size(points))))


def repeated(points: Column, last: Column, horizon: int) -> Column:
    """The plain forecast: the last value for each day."""
    return F.array_repeat(last, horizon)


def prepared(products: DataFrame, points: DataFrame, key: list[str], least_days: int = 30, least_span: int = 30) -> DataFrame:
    """products with gate: the first condition for a forecast that they miss (identity, stock, days, span), or ready."""
    h = points.filter("price > 0").withColumn("_day", S.local_day("ts")).groupBy(*key).agg(F.countDistinct("_day").alias("_days"), (F.datediff(F.max("_day"), F.min("_day")) + 1).alias("_span"))
    gate = F.when(F.col("compare_code").isNull(), "identity").when(F.coalesce(F.col("stock") <= 0, F.lit(False)), "stock").when(F.coalesce("_days", F.lit(0)) < least_days, "days").when(F.col("_span") < least_span, "span").otherwise("ready")
    return products.join(h, key, "left").withColumn("gate", gate).drop("_days", "_span")


def by_priority(sources: list[DataFrame], key: list[str], limit: int) -> DataFrame:
    """key, priority: the keys of sources in order, each once under the first source that has it, up to a limit."""
    out = None
    for i, df in enumerate(sources, 1):
        one = df.select(*key, F.lit(i).alias("priority"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*key).agg(F.min("priority").alias("priority")).orderBy("priority", *key).limit(limit)


def attached(cards: DataFrame, forecasts: DataFrame, key: list[str], models: list[str], order: list[Column]) -> DataFrame:
    """cards with the columns of their best forecast: by preference of model, then in this order; null for none."""
    preference = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(m) for m in models)), F.col("model")), F.lit(0)), F.lit(len(models) + 1))
    one = forecasts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(preference, *order))).filter("_n = 1").drop("_n")
    return cards.join(one, key, "left")


def counts_for_quality(outcomes: DataFrame, excluded: list[str]) -> DataFrame:
    """Outcomes (status, model, fallback, hit_reason) that judge a model: decided, of no excluded model, not by a fallback, and no hit by standing still."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return outcomes.filter(F.col("status").isin("hit", "miss") & ~F.lower(F.coalesce("model", F.lit(""))).isin(excluded) & ~flag(F.col("fallback")) & (F.coalesce("hit_reason", F.lit("")) != "stable"))
