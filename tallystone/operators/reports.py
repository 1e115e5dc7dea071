"""Reports over alerts, carts, searches and deals: metrics, samples, orders of deals, alert families, matrices with totals, refreshes that are due."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import fold

from . import rules
from .catalog import latest, quota
from .usage import calendar


def metrics(tables: dict[str, tuple[DataFrame, Column]], sums: dict[str, Column]) -> DataFrame:
    """section, key, value: rows of each table by a key, and sums over the first table."""
    out = None
    for name, (df, key) in tables.items():
        one = df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("section"), "key", "value")
        out = one if out is None else out.unionByName(one)
    first = next(iter(tables.values()))[0]
    total = first.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in sums))).alias("s")
    return out.unionByName(total.select(each).select(F.lit("sums").alias("section"), "s.*"))


def group_analysis(offers: DataFrame, group: list[str], offer: list[str], exact: Column) -> DataFrame:
    """group, offers (each once), stores, exact (offers of the very quantity), lowest."""
    one = offers.withColumn("_e", exact).groupBy(*group, *offer).agg(F.max("_e").alias("_e"), F.min("price").alias("price"))
    return one.groupBy(*group).agg(F.count("*").alias("offers"), F.countDistinct("store").alias("stores"), F.count(F.when(F.col("_e"), 1)).alias("exact"), F.min("price").alias("lowest"))


def sampled_groups(rows: DataFrame, key: list[str], by: Column, size: int, limit: int, seed: int = 21) -> DataFrame:
    """grp, n: the largest groups in a sample of ``size`` rows that depends on a seed and the key alone."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))
    sample = rows.select(by.alias("grp"), order.alias("_o"), *key).orderBy("_o", *key).limit(size)
    return sample.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "grp").limit(limit)


def of_category(products: DataFrame, category: str, also: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Priced products of a category by its folded name. also: category -> (other names of it, phrases one of which must stand in a product's name or category)."""
    wanted = fold(F.lit(category))
    same = fold(F.col("category")) == wanted
    for name, (names, telling) in also.items():
        if category.lower() == name:
            hay = fold(F.concat_ws(" ", "name", "category"))
            told = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(t)) for t in telling])
            same = (same | fold(F.col("category")).isin(*names)) & told
    return products.filter((F.col("price") > 0) & same)


def tiered_candidates(seeds: DataFrame, products: DataFrame, limit: int) -> DataFrame:
    """id, product_id, tier: products that share a word with a seed (1), else its category or brand (2), each once; the cheapest of the first tiers."""
    # the cheapest of each word, category and brand are ranked once: a seed needs no more of a word than the limit and itself,
    # and no more of a category than that and the products that a word gave already
    cheapest = [F.col("price"), F.col("product_id")]
    of_word = quota(products.select("product_id", "price", F.explode("words").alias("_w")), ["_w"], cheapest, limit + 1)
    by_word = seeds.select("id", F.explode("words").alias("_w")).join(of_word, "_w").select("id", "product_id", "price", F.lit(1).alias("tier"))
    wide = lambda c: seeds.select("id", c).join(quota(products.select("product_id", "price", c).filter(F.col(c).isNotNull()), [c], cheapest, 2 * limit + 1), c).select("id", "product_id", "price", F.lit(2).alias("tier"))
    x = by_word.union(wide("category")).union(wide("brand")).filter("id <> product_id").groupBy("id", "product_id", "price").agg(F.min("tier").alias("tier"))
    return quota(x, ["id"], [F.col("tier"), F.col("price"), F.col("product_id")], limit)


def alert_families(offers: DataFrame, key: list[str], group: list[str], drop: float, amount: int, median: float, gap: float) -> DataFrame:
    """key, rule, saving of the three families of rules: falls, prices below the median, and gaps to other retailers."""
    fell = rules.drop_alerts(offers, drop, amount, skip_fake=False).select(*key, "rule", F.col("drop").alias("saving"))
    low = rules.median_alerts(offers, median).select(*key, "rule", "saving")
    apart = rules.gap_alerts(offers, group, gap).select(*key, F.lit("cross_store_gap").alias("rule"), (F.col("second_value") - F.col("value")).alias("saving"))
    return fell.unionByName(low).unionByName(apart)


def daily_counts(rows: DataFrame, day: Column, today: Column, days: int) -> DataFrame:
    """day, n of each of the last days, 0 where nothing came."""
    per = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return calendar(rows.sparkSession, today, days).join(per, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


DEAL_ORDERS = {
    "saving": [F.col, "saving", False], "discount": [F.col, "discount", False], "price_asc": [F.col, "price", True], "price_desc": [F.col, "price", False], "name": [F.col, "name", True], "recent": [F.col, "ts", False],
}


def deal_orders(deals: DataFrame, tie: list[str], limit: int) -> DataFrame:
    """sort, place and the key of the first deals in each named order; nulls last."""
    out = None
    for name, (column, c, rising) in DEAL_ORDERS.items():
        first = column(c).asc_nulls_last() if rising else column(c).desc_nulls_last()
        top = deals.orderBy(first, *tie).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(first, *tie)))  # of limit rows
        one = top.select(F.lit(name).alias("sort"), "place", *tie)
        out = one if out is None else out.unionByName(one)
    return out


def new_deals(alerts: DataFrame, identity: list[str], day: Column, order: list[Column]) -> DataFrame:
    """A day's alerts, one an identity in this order, without identities of earlier days, each with the saving of all."""
    today = latest(alerts.filter(F.col("day") == day), identity, order)
    fresh = today.join(alerts.filter(F.col("day") < day).select(*identity).distinct(), identity, "left_anti")
    return fresh.crossJoin(fresh.agg(F.coalesce(F.sum("saving"), F.lit(0)).alias("total_saving")))


def matrix_report(grid: DataFrame) -> DataFrame:
    """store, usable, unusable, missing, total of usable cells, complete, best_items (where the store is the cheapest). grid: item, store, quantity, state, price."""
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.col("price").asc_nulls_last(), "store")) == 1
    x = grid.withColumn("_best", best & F.col("price").isNotNull())
    n = lambda *states: F.count(F.when(F.col("state").isin(*states), 1))
    return x.groupBy("store").agg(n("usable").alias("usable"), n("unusable").alias("unusable"), n("no_match", "no_catalog").alias("missing"), F.coalesce(F.sum(F.col("price") * F.col("quantity")), F.lit(0)).alias("total"), (n("usable") == F.count("*")).alias("complete"), F.count(F.when(F.col("_best"), 1)).alias("best_items"))


def refresh_due(points: DataFrame, last: DataFrame, key: list[str], now: Column, changes: int = 8, hours: int = 6) -> DataFrame:
    """key, since, due: a forecast is made anew after enough observations since the last one, or after some hours with any."""
    l = last.select(*key, F.col("at").alias("_at"))  # noqa: E741
    x = points.join(l, key, "left").filter(F.col("_at").isNull() | (F.col("ts") > F.col("_at")))
    a = x.groupBy(*key, "_at").agg(F.count("*").alias("since"))
    return a.select(*key, "since", (F.col("_at").isNull() | (F.col("since") >= changes) | (F.col("_at") < now - F.expr(f"INTERVAL {hours} HOURS"))).alias("due"))


def notification_offers(offers: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """key, rule, saving of every alert without thresholds, for accounts to apply their own; also any discount off the list price."""
    families = alert_families(offers, key, group, 0, 0, 0, 0)
    cut = (F.col("price") > 0) & (F.col("price_normal") > F.col("price"))
    return families.unionByName(offers.filter(cut).select(*key, F.lit("common_discount").alias("rule"), (F.col("price_normal") - F.col("price")).cast("double").alias("saving")))
