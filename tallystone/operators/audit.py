"""Audits: agreement of reviewers, frequency terciles, stratified samples, field checks, baskets of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, observed, expected, kappa of labels a and b (Cohen). Labels are counted first, so only totals meet."""
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col("a").alias("label")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(*by, F.col("b").alias("label")).agg(F.sum("c").alias("y"))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = total.join(chance, by, "left") if by else total.join(chance)
    observed, expected = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    k = F.when(expected == 1, F.when(observed == 1, F.lit(1.0).cast("double"))).otherwise((observed - expected) / F.when(expected == 1, F.lit(None)).otherwise(1 - expected))
    return out.select(*by, "n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(k, 6).alias("kappa"))


def terciles(counts: DataFrame) -> DataFrame:
    """key, n with bucket low, medium or high; equal counts share a bucket. Cut values come from the histogram of counts, one row a distinct count."""
    hist = counts.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n")
    cum = hist.withColumns({"_to": F.sum("c").over(w), "_all": F.sum("c").over(Window.partitionBy())})
    at = lambda q: F.greatest(F.lit(1), F.floor((F.col("_all") * q + 2) / 3))
    cuts = cum.agg(F.min(F.when(F.col("_to") >= at(1), F.col("n"))).alias("low"), F.min(F.when(F.col("_to") >= at(2), F.col("n"))).alias("high"))  # one row
    x = counts.join(F.broadcast(cuts))
    return x.select(*counts.columns, F.when(F.col("n") <= F.col("low"), "low").when(F.col("n") <= F.col("high"), "medium").otherwise("high").alias("bucket"))


def allocation(strata: DataFrame, size: int) -> DataFrame:
    """strata (stratum, n) with take: size shared in proportion by largest remainder, ties by stratum. One row a stratum."""
    everything = Window.partitionBy()
    x = strata.withColumn("_all", F.sum("n").over(everything)).withColumn("_target", F.least(F.lit(size).cast("long"), F.col("_all")))
    x = x.withColumn("_exact", F.col("_target") * F.col("n") / F.col("_all")).withColumn("_floor", F.floor("_exact"))
    x = x.withColumn("_rest", F.col("_target") - F.sum("_floor").over(everything))
    rank = F.row_number().over(Window.orderBy((F.round(F.col("_exact") - F.col("_floor"), 9)).desc(), "stratum"))
    return x.select("stratum", "n", (F.col("_floor") + F.when(rank <= F.col("_rest"), 1).otherwise(0)).cast("long").alias("take"))


def stratified(rows: DataFrame, size: int, seed: int = 21) -> DataFrame:
    """A seeded sample of rows (id, stratum), shared over strata in proportion; the same rows on every run."""
    plan = allocation(rows.groupBy("stratum").agg(F.count("*").alias("n")), size)
    order = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id"))
    return rows.join(plan.select("stratum", "take"), "stratum").withColumn("_n", order).filter(F.col("_n") <= F.col("take")).drop("_n", "take")


def field_checks(checks: DataFrame, fields: list[str]) -> DataFrame:
    """field: comparable, different, not_verified and mean absolute and relative differences of expected_f and observed_f columns, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").cast("double").alias("e"), F.col(f"observed_{f}").cast("double").alias("o")) for f in fields))).alias("c")
    x = checks.select(each).select("c.*").withColumn("d", F.abs(F.col("o") - F.col("e")))
    both = F.col("d").isNotNull()
    return x.groupBy("field").agg(F.count(F.when(both, 1)).alias("comparable"), F.count(F.when(F.col("d") > 0, 1)).alias("different"), F.count(F.when(~both, 1)).alias("not_verified"), F.round(F.avg("d"), 4).alias("mean_abs"), F.round(F.avg(F.try_divide(F.col("d"), F.col("e"))), 6).alias("mean_relative"))


def basket(items: DataFrame, stores: DataFrame, matches: DataFrame) -> DataFrame:
    """items (item, quantity) by stores (store): the best usable match, or the reason there is none.

    matches: item, store, price, usable, confidence. A store with any match has
    no_match for the rest, one without has no_catalog. The grid has a row for each
    item and store by its meaning; stores are a dimension.
    """
    best = F.min_by(F.struct("price", "confidence"), F.struct(~F.col("usable"), -F.col("confidence"), F.col("price")))
    one = matches.groupBy("item", "store").agg(F.max("usable").alias("usable"), best.alias("b"))
    known = matches.select("store").distinct().withColumn("_known", F.lit(True))
    grid = items.crossJoin(stores).join(one, ["item", "store"], "left").join(known, "store", "left")
    state = F.when(F.col("usable"), "usable").when(F.col("b").isNotNull(), "unusable").when(F.col("_known"), "no_match").otherwise("no_catalog")
    return grid.select("item", "store", "quantity", state.alias("state"), F.when(F.col("usable"), F.col("b.price")).alias("price"))


def basket_totals(grid: DataFrame) -> DataFrame:
    """store: total, found, missing, complete, place among baskets (complete ones first, most found, cheapest)."""
    t = grid.groupBy("store").agg(F.sum(F.col("price") * F.col("quantity")).alias("total"), F.count("price").alias("found"), F.count(F.when(F.col("price").isNull(), 1)).alias("missing"))
    t = t.withColumn("complete", F.col("missing") == 0)
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.col("found").desc(), F.col("total").asc_nulls_last(), "store")))


def savings(grid: DataFrame) -> DataFrame:
    """item, cheapest store and price, saving against the dearest usable offer."""
    return grid.filter("price is not null").groupBy("item").agg(F.min_by("store", F.struct("price", "store")).alias("store"), F.min("price").alias("price"), (F.max("price") - F.min("price")).alias("saving"))


def pivoted(reviews: DataFrame, key: str, reviewer: Column, label: str) -> DataFrame:
    """One row a key, the labels of reviewers A and B in columns."""
    x = reviews.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(reviewer)))
    return x.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(label))).alias("label_a"), F.max(F.when(F.col("_r") == 2, F.col(label))).alias("label_b"))
