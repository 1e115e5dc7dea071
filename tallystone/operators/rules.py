"""Alert rules, preferences, throttling, quotas and the send history.

Offers come with previous_price, median and fake from the price statistics; a
rule is a filter over them. The throttle depends on what was sent before, so its
batch form folds one receiver's changes in order, and the stream form keeps
the last send as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .offers import landed_price

# The shipped rule set.
RULES = {"min_price": 10000, "drop_percent": 40.0, "drop_amount": 20000, "gap_percent": 40.0, "below_median_percent": 40.0, "gap_confidence": 0.8}
# Active alerts that each tier may have.
QUOTAS = {"user": 3, "paid": 20, "admin": 10000}


def in_range(price: Column, low: int | None = None, high: int | None = None) -> Column:
    ok = price.isNotNull()
    if low is not None:
        ok = ok & (price >= low)
    if high is not None:
        ok = ok & (price <= high)
    return F.coalesce(ok, F.lit(False))


def drop_alerts(offers: DataFrame, percent: float, amount: int, skip_fake: bool = True) -> DataFrame:
    """Offers whose price fell by percent or by amount: rule (both names joined by +), drop, drop_percent."""
    rows = offers.filter((F.col("previous_price") > 0) & (F.col("price") < F.col("previous_price")))
    if skip_fake:
        rows = rows.filter(~F.coalesce("fake", F.lit(False)))
    fall = F.col("previous_price") - F.col("price")
    share = fall * 100 / F.col("previous_price")
    rule = F.concat_ws("+", F.when(share >= percent, "price_drop_percent"), F.when(fall >= amount, "price_drop_amount"))
    return rows.withColumns({"rule": rule, "drop": fall, "drop_percent": F.round(share, 2)}).filter("rule <> ''")


def median_alerts(offers: DataFrame, percent: float, least_points: int = 3) -> DataFrame:
    """Offers well below their median: rule, saving."""
    rows = offers.filter((F.col("median") > 0) & (F.col("points") >= least_points) & (F.col("percent_vs_median") <= -percent))
    return rows.withColumns({"rule": F.lit("below_median"), "saving": F.col("median") - F.col("price")})


def gap_alerts(offers: DataFrame, group: list[str], percent: float, confidence: Column | None = None, least_confidence: float = 0.8) -> DataFrame:
    """The lowest offer of each group against the cheapest one of another family: second_store, gap_percent, landed.

    Landed prices count where every offer of the group has a shipping cost.
    """
    rows = offers.filter(F.col("price") > 0)
    if confidence is not None:
        rows = rows.filter(confidence >= least_confidence)
    landed = F.bool_and(F.col("shipping_cost").isNotNull()).over(Window.partitionBy(*group))
    rows = rows.withColumn("landed", landed).withColumn("value", F.when(F.col("landed"), landed_price(F.col("price"), F.col("shipping_cost"))).otherwise(F.col("price")))
    best = rows.groupBy(*group, "family").agg(F.min_by(F.struct("value", "store", "price", "landed"), F.struct("value", "store")).alias("b"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("b.value", "b.store"))
    two = best.withColumn("_n", place).filter("_n <= 2").groupBy(*group).agg(F.max(F.when(F.col("_n") == 1, F.col("b"))).alias("one"), F.max(F.when(F.col("_n") == 2, F.col("b"))).alias("two"))
    gap = (F.col("two.value") - F.col("one.value")) * 100 / F.col("two.value")
    out = two.filter(F.col("two").isNotNull() & (gap >= percent))
    return out.select(*group, F.col("one.store").alias("store"), F.col("one.value").alias("value"), F.col("two.store").alias("second_store"), F.col("two.value").alias("second_value"), F.round(gap, 2).alias("gap_percent"), F.col("one.landed").alias("landed"))


def watch_alerts(best: DataFrame, watches: DataFrame, group: list[str]) -> DataFrame:
    """Watches (group, target, last_seen; no target: any change) that the best price of their group satisfies: rule, reference."""
    x = watches.join(best, group)
    any_change = F.col("target").isNull()
    changed = any_change & F.col("last_seen").isNotNull() & (F.col("last_seen") != F.col("price"))
    reached = ~any_change & (F.col("price") <= F.col("target"))
    out = x.withColumn("rule", F.when(changed, "watch_change").when(reached, "watch_target")).filter("rule is not null")
    return out.withColumn("reference", F.when(any_change, F.col("last_seen")).otherwise(F.col("target")))


def strongest(alerts: DataFrame, entity: list[str], order: list[Column]) -> DataFrame:
    """The strongest alert of each entity."""
    return alerts.withColumn("_n", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).filter("_n = 1").drop("_n")


def should_send(last_sent: Column, last_price: Column, price: Column, now: Column, days: int = 5) -> Column:
    """Never sent, sent days ago, or now strictly cheaper than what was sent."""
    return last_sent.isNull() | (now >= last_sent + F.expr(f"INTERVAL {days} DAYS")) | (price < last_price)


def throttled(changes: DataFrame, key: list[str], order: list[str], days: int = 5) -> DataFrame:
    """Changes (key, ts, price) that are sent, in order: each depends on the last one sent.

    One key's changes are folded natively; a key is one receiver and one product.
    """
    rows = changes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "price"))).alias("_c"))
    sent_type = "array<struct<ts:timestamp,price:bigint>>"
    start = F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("price"), F.array().cast(sent_type).alias("sent"))

    def step(acc: Column, c: Column) -> Column:
        send = acc["at"].isNull() | (c["ts"] >= acc["at"] + F.expr(f"INTERVAL {days} DAYS")) | (c["price"] < acc["price"])
        one = F.struct(c["ts"].alias("ts"), c["price"].alias("price"))
        return F.struct(F.when(send, c["ts"]).otherwise(acc["at"]).alias("at"), F.when(send, c["price"]).otherwise(acc["price"]).alias("price"), F.when(send, F.array_append(acc["sent"], one)).otherwise(acc["sent"]).alias("sent"))

    return rows.select(*key, F.explode(F.aggregate("_c", start, step, lambda a: a["sent"])).alias("s")).select(*key, "s.ts", "s.price")


def quota(alerts: DataFrame, users: DataFrame, limits: dict[str, int] = QUOTAS) -> DataFrame:
    """user_id, tier, active, most, left: alerts that a user has and may still make."""
    most = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    n = alerts.groupBy("user_id").agg(F.count("*").alias("active"))
    out = users.join(n, "user_id", "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long"))).withColumn("most", most[F.col("tier")])
    return out.select("user_id", "tier", "active", "most", F.greatest(F.lit(0).cast("long"), F.col("most") - F.col("active")).alias("left"))


def not_stored(alerts: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Alerts whose identity was never stored (null-safe)."""
    s = stored.select(*(F.col(c).alias(f"_{c}") for c in identity)).distinct()
    on = None
    for c in identity:
        e = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = e if on is None else on & e
    return alerts.join(s, on, "left_anti")
