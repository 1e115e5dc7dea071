"""Offers of one product across stores: prices that compare, peers, collapses, false discounts, integrity, scores.

An offer has store, family (the retailer: sister stores share one), product_id
(the comparison group) and prices. Peers meet in equi-joins or windows on the
group, never in pairs of the whole catalog; where only the best peer counts, a
window ranks the group once, so a group of any size costs its rows, not its
pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as S

#: Fixed values of the offer rules.
SAME_PRICE_RATIO, FULL_PRICE_RATIO, MIN_GAP_RATIO, SUPER_PERCENT, MIN_CONFIDENCE = 0.03, 0.95, 0.10, 50, 0.80
PRICE_TOLERANCE = 1


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def payment_restricted(price: Column, all_payment: Column, card: Column, basis: Column | None = None) -> Column:
    """No price for all means of payment, and the published one is a card's or a coupon's."""
    by_basis = F.lower(F.trim(basis)).isin("card", "coupon", "cupon", "tarjeta") if basis is not None else F.lit(False)
    by_card = positive(card).isNotNull() & (positive(price).isNull() | (price == card))
    return positive(all_payment).isNull() & (F.coalesce(by_basis, F.lit(False)) | by_card)


def comparable_price(price: Column, all_payment: Column, card: Column, basis: Column | None = None) -> Column:
    """The price for all means of payment; 0 where only a card's price is known."""
    return F.coalesce(positive(all_payment), F.when(payment_restricted(price, all_payment, card, basis), F.lit(0).cast("long")), positive(price), F.lit(0).cast("long"))


def discount_percent(price: Column, normal: Column) -> Column:
    return F.when((price > 0) & (normal > price), F.round((normal - price) * 100 / normal, 1)).otherwise(F.lit(0.0).cast("double"))


def shelf_discount(price: Column, normal: Column, declared: Column | None = None) -> Column:
    """A list price above the price, or a declared percentage."""
    said = (F.abs(declared) > 0) & (F.abs(declared) < 100) if declared is not None else F.lit(False)
    return (price > 0) & F.coalesce((normal > price + PRICE_TOLERANCE) | said, F.lit(False))


def same_price(a: Column, b: Column, ratio: float = SAME_PRICE_RATIO) -> Column:
    high = F.greatest(a, b)
    return (a > 0) & (b > 0) & ((high - F.least(a, b)) / high <= ratio)


def landed_price(price: Column, shipping: Column) -> Column:
    return F.when(price > 0, price + F.greatest(F.lit(0).cast("long"), F.coalesce(shipping, F.lit(0).cast("long"))))


def shipping_comparable(offers: DataFrame, group: list[str]) -> DataFrame:
    """group, comparable: every shipping cost known, and of one region at most."""
    region = F.countDistinct("shipping_region") if "shipping_region" in offers.columns else F.lit(0)
    return offers.groupBy(*group).agg((F.bool_and(F.col("shipping_cost").isNotNull()) & (region <= 1)).alias("comparable"))


def sold_out(stock: Column, *texts: Column) -> Column:
    words = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(stock <= 0, F.lit(False)) | words.contains("agotado") | words.contains("sin stock")


def cheapest_of_others(offers: DataFrame, group: list[str], family: str, price: str, tie: list[str], available: Column) -> DataFrame:
    """offers with rival_store and rival_price: the cheapest available peer of another family.

    Two rankings of a group suffice: the cheapest offer of all, and the cheapest
    outside that one's family.
    """
    by_family = offers.filter(available & (F.col(price) > 0)).groupBy(*group, family).agg(F.min_by(F.struct(F.col("store").alias("rival_store"), F.col(price).alias("rival_price")), F.struct(price, *tie)).alias("r"))
    rank = Window.partitionBy(*group).orderBy("r.rival_price", *(f"r.{'rival_store' if t == 'store' else t}" for t in tie))
    best = by_family.withColumn("_n", F.row_number().over(rank)).filter("_n <= 2")
    two = best.groupBy(*group).agg(F.max(F.when(F.col("_n") == 1, F.struct(F.col(family).alias("f"), F.col("r").alias("r")))).alias("one"), F.max(F.when(F.col("_n") == 2, F.col("r"))).alias("two"))
    rival = F.when(F.col("one.f") != F.col(family), F.col("one.r")).otherwise(F.col("two"))
    return offers.join(two, group, "left").withColumn("_r", rival).withColumns({"rival_store": F.col("_r.rival_store"), "rival_price": F.col("_r.rival_price")}).drop("_r", "one", "two")


def cheaper_elsewhere(offers: DataFrame, group: list[str], min_ratio: float = 0.03) -> DataFrame:
    """Offers that a store of another family undercuts by min_ratio: rival_store, rival_price, gap, gap_percent."""
    out = cheapest_of_others(offers, group, "family", "price", ["store"], ~F.coalesce(F.col("stock") <= 0, F.lit(False)))
    out = out.withColumn("gap", F.col("price") - F.col("rival_price")).filter((F.col("gap") > 0) & (F.col("gap") / F.col("price") >= min_ratio))
    return out.withColumn("gap_percent", F.round(F.col("gap") * 100 / F.col("price"), 1))


def false_list_discounts(offers: DataFrame, group: list[str]) -> DataFrame:
    """Offers with a shelf discount while another family sells at the same price or less without one; witness is that store."""
    full = ~shelf_discount(F.col("price"), F.col("price_normal"))
    out = cheapest_of_others(offers, group, "family", "price", ["store"], full)
    out = out.filter(shelf_discount(F.col("price"), F.col("price_normal")) & (F.col("rival_price") <= F.col("price") + PRICE_TOLERANCE))
    return out.withColumnRenamed("rival_store", "witness").withColumnRenamed("rival_price", "witness_price")


def peers_at_list(offers: DataFrame, group: list[str], list_ratio: float = 0.9, gap: float = 0.10) -> DataFrame:
    """group, store, peers: peers of another family at list_ratio of the own list price or more, and well above the own price.

    An equi-join on the group with a range condition: pairs of one product's stores.
    """
    peer = offers.select(*group, F.col("store").alias("_s"), F.col("family").alias("_f"), F.col("price").alias("_p"))
    hit = (F.col("_f") != F.col("family")) & (F.col("_p") >= F.col("price_normal") * list_ratio) & (F.col("_p") >= F.col("price") * (1 + gap))
    return offers.join(peer, group).filter(hit).groupBy(*group, "store").agg(F.count("*").alias("peers"), F.min("_p").alias("least_peer"))


def anchored(offers: DataFrame, group: list[str], ratio: float = SAME_PRICE_RATIO) -> DataFrame:
    """Priced offers that have peers in other stores, with the minimum and median of those, gaps and whether the offer is like the market; a group is gathered once."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])
    all_ = F.sort_array(F.collect_list(F.struct(F.col("price").alias("p"), F.col("store").alias("s"))).over(Window.partitionBy(*group)))
    x = offers.filter(known & (F.col("price") > 0)).withColumn("_all", all_)
    x = x.withColumn("_peers", F.transform(F.filter("_all", lambda q: q["s"] != F.col("store")), lambda q: q["p"])).filter(F.size("_peers") > 0)
    x = x.withColumns({"peer_min": F.get("_peers", F.lit(0)), "peer_median": S.round_even(S.middle(F.col("_peers")))}).drop("_all", "_peers")
    over = F.col("peer_median") - F.col("price")
    similar = (F.col("price") >= F.col("peer_min") * (1 - ratio)) | (F.col("price") >= F.col("peer_median") * (1 - ratio))
    return x.withColumns({"gap_vs_min": F.col("peer_min") - F.col("price"), "gap_vs_median": over, "real_savings_percent": F.when(over > 0, F.round(over * 100 / F.col("peer_median"), 1)).otherwise(F.lit(0.0).cast("double")), "similar_to_market": similar})


def cross_store_anchor(offers: DataFrame, group: list[str], ratio: float = SAME_PRICE_RATIO) -> DataFrame:
    """Per group, store and price: minimum and median of the other stores' prices, gaps and whether it is like the market."""
    return anchored(offers, group, ratio).select(*group, "store", "price", "peer_min", "peer_median", "gap_vs_min", "gap_vs_median", "real_savings_percent", "similar_to_market").distinct()


def collapse(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order; rows without a key pass through untouched."""
    no_key = F.lit(False)
    for c in by:
        no_key = no_key | F.col(c).isNull()
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter((F.col("_n") == 1) | no_key).drop("_n")


def collapse_variants(rows: DataFrame, name: str = "name") -> DataFrame:
    """Per store and folded name: the cheapest row with variants, min_price and max_price."""
    rows = rows.withColumn("_name", F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))))
    w = Window.partitionBy("store", "_name")
    out = rows.withColumns({"variants": F.count("*").over(w), "min_price": F.min("price").over(w), "max_price": F.max("price").over(w), "_n": F.row_number().over(w.orderBy("price", "product_id"))})
    return out.filter("_n = 1").drop("_n", "_name")


def collapse_families(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group and family: the cheapest row, with mirrors (the family's other stores in order)."""
    w = Window.partitionBy(*group, "family")
    first = w.orderBy("price", "store")
    all_ = F.collect_list("store").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumn("_n", F.row_number().over(first)).withColumn("mirrors", F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(1))))
    return out.filter("_n = 1").drop("_n")


def group_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """group: lowest price (landed where every shipping cost is known), its store, counts, comparable, order of groups."""
    known = F.bool_and(F.col("shipping_cost").isNotNull()).over(Window.partitionBy(*group))
    rows = rows.filter("price > 0").withColumn("_known", known)
    rows = rows.withColumn("_value", F.when(F.col("_known"), landed_price(F.col("price"), F.col("shipping_cost"))).otherwise(F.col("price")))
    return rows.groupBy(*group).agg(
        F.min("_value").alias("lowest"),
        F.min_by("store", F.struct("_value", "store")).alias("lowest_store"),
        F.count("*").alias("offers"),
        F.countDistinct("family").alias("retailers"),
        (F.countDistinct("family") >= 2).alias("comparable"),
        F.bool_and("_known").alias("landed"),
    )


def offer_score(best: Column, savings: Column, confidence: Column, stock: Column, points: Column, suspicious: Column, similar: Column) -> Column:
    """0 to 100: 40 for the best price, up to 30 for savings, 15 confidence, 0/5/10 stock, up to 5 history, -25 suspicious, -15 like the market."""
    zero, one = F.lit(0.0).cast("double"), F.lit(1.0).cast("double")
    have = F.when(stock > 0, 10.0).when(stock.isNull(), 5.0).otherwise(0.0).cast("double")
    s = F.when(best, 40.0).otherwise(0.0).cast("double") + 30 * F.least(one, F.greatest(zero, savings / 30)) + 15 * confidence + have + 5 * F.least(one, points / 5.0)
    s = s - F.when(suspicious, 25.0).otherwise(0.0).cast("double") - F.when(similar, 15.0).otherwise(0.0).cast("double")
    return F.greatest(zero, F.least(F.lit(100.0).cast("double"), s))


def super_offer(kinds: Column, gap: Column, discount: Column, verified: Column, threshold: int = SUPER_PERCENT) -> Column:
    named = F.arrays_overlap(kinds, F.array(F.lit("comparison"), F.lit("history")))
    return named & ((gap > threshold) | (F.greatest(discount, verified) > threshold))


def latest_before(events: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Keys first seen on each day: rows whose key was on no earlier day (an anti-join against the first day of each key)."""
    first = events.groupBy(*keys).agg(F.min(day).alias("_first"))
    return events.join(first, keys).filter(F.col(day) == F.col("_first")).drop("_first")


def best_card(cards: DataFrame, group: list[str]) -> DataFrame:
    """The card of each group with the highest score, then gap, then gap_percent."""
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("gap").desc_nulls_last(), F.col("gap_percent").desc_nulls_last(), "store")
    return cards.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
