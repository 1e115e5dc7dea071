"""Catalog queries: browsing, facets, analysis, latest per group, related products, plans of work, set updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import fold, tokens
from tallystone.sources.storage import stored


def sort_columns(name: str) -> list[Column]:
    """Columns of a named order; an unknown name counts as updated."""
    tie = [F.col("store"), F.col("product_id")]
    first = {
        "price_asc": F.col("price").asc_nulls_last(),
        "price_desc": F.col("price").desc_nulls_last(),
        "discount": ((F.col("price_normal") - F.col("price")) / F.col("price_normal")).desc_nulls_last(),
        "saving": (F.col("price_normal") - F.col("price")).desc_nulls_last(),
        "name": F.col("name").asc_nulls_last(),
    }.get(name, F.col("ts").desc_nulls_last())
    return [first, *tie]


def browse(products: DataFrame, text: str = "", category: str | None = None, store: str | None = None, brand: str | None = None, low: int | None = None, high: int | None = None, discounted: bool = False, sort: str = "updated", page: int = 1, size: int = 24) -> DataFrame:
    """One page of the products that satisfy every condition: each word of text in name or brand, folded equality elsewhere."""
    rows = products.filter(F.col("price") > 0)
    hay = fold(F.concat_ws(" ", "name", "brand"), separators=True)
    for word in text.split():
        rows = rows.filter(hay.contains(word.lower()))
    for column, value in (("category", category), ("brand", brand)):
        if value is not None:
            rows = rows.filter(fold(F.col(column)) == fold(F.lit(value)))
    if store is not None:
        rows = rows.filter(F.col("store") == store)
    if low is not None:
        rows = rows.filter(F.col("price") >= low)
    if high is not None:
        rows = rows.filter(F.col("price") <= high)
    if discounted:
        rows = rows.filter(F.col("price") < F.coalesce("price_normal", "price"))
    return rows.orderBy(*sort_columns(sort)).offset((max(1, page) - 1) * max(1, size)).limit(max(1, size))


def analysis(products: DataFrame, by: str, limit: int) -> DataFrame:
    """by, products, average, least, most, stores: the largest groups."""
    agg = products.groupBy(by).agg(F.count("*").alias("products"), F.round(F.avg("price")).cast("long").alias("average"), F.min("price").alias("least"), F.max("price").alias("most"), F.countDistinct("store").alias("stores"))
    return agg.orderBy(F.col("products").desc(), by).limit(limit)


def facets(products: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """facet, key (folded), label (the most frequent spelling), n: the top values of each column, in one pass over the products."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns))).alias("p")
    per = products.select(pairs).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("c"))
    merged = per.groupBy("facet", fold(F.col("value")).alias("key")).agg(F.sum("c").alias("n"), F.min_by("value", F.struct(-F.col("c"), "value")).alias("label"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "key"))
    return merged.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def quota(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def interleaved(rows: DataFrame, origin: str, order: list[Column]) -> DataFrame:
    """rows with turn: round-robin over origins, each in its own order, origins by their first row."""
    w = Window.partitionBy(origin).orderBy(*order)
    return rows.withColumns({"turn": F.row_number().over(w), "first_seen": F.min("position").over(Window.partitionBy(origin))})


def related(seed: DataFrame, products: DataFrame, limit: int) -> DataFrame:
    """For each seed (id, words, brand, grp): the best candidates by 3 a shared word, 4 for the brand, 5 for the group.

    A seed and a candidate meet in what they share: a number of words, and the brand
    or the group or both. Under each of these, for each set of words, only the first
    ``limit`` and one (the seed may be among them) are kept: whatever they precede,
    they precede in the result too, as they score as much or more.
    """
    order = [F.col("price").asc_nulls_last(), F.col("product_id")]
    kept = quota(products.select("product_id", "price", "name", "brand", "category"), ["name", "brand", "category"], order, limit + 1)
    pool = kept.select("product_id", "price", F.array_sort(F.array_distinct(tokens(F.col("name")))).alias("_has"), F.col("brand").alias("_b"), F.col("category").alias("_g"))
    # 1 of _m is the brand, 2 the group
    brand, group = F.col("_m").bitwiseAND(1) != 0, F.col("_m").bitwiseAND(2) != 0
    shares = lambda df, *c: df.select(*c, "_b", "_g", F.explode(F.array(*(F.lit(m) for m in range(4)))).alias("_m")).filter((~brand | F.col("_b").isNotNull()) & (~group | F.col("_g").isNotNull())).withColumns({"_b": F.when(brand, F.col("_b")).otherwise(""), "_g": F.when(group, F.col("_g")).otherwise("")})
    key = ["_m", "_b", "_g"]
    first = lambda df, *by: quota(df, [*by, *key], order, limit + 1).drop("place")
    of_set = stored(first(shares(pool, "product_id", "price", "_has"), "_has"))
    asked = shares(seed.select("id", F.array_sort(F.array_distinct("words")).alias("_words"), F.col("brand").alias("_b"), F.col("grp").alias("_g")), "id", "_words")
    words = lambda df, c: df.select(c).distinct().select(c, F.explode(c).alias("_k"))
    shared = words(asked, "_words").join(words(of_set, "_has"), "_k").groupBy("_words", "_has").agg(F.count("*").alias("_n"))
    with_words = asked.join(first(shared.join(of_set, "_has"), "_words", "_n"), ["_words", *key])
    without = asked.join(first(of_set.filter("_m > 0")), key).withColumn("_n", F.lit(0).cast("long"))
    score = 3 * F.col("_n") + F.when(brand, 4).otherwise(0) + F.when(group, 5).otherwise(0)
    columns = ["id", "product_id", score.cast("int").alias("score"), "price"]
    x = with_words.select(*columns).union(without.select(*columns)).filter("id <> product_id").groupBy("id", "product_id", "price").agg(F.max("score").alias("score"))
    return quota(x.select("id", "product_id", "score", "price"), ["id"], [F.col("score").desc(), *order], limit)


def due_plan(products: DataFrame, priorities: DataFrame, now: Column, grace_hours: int = 6) -> DataFrame:
    """products (id, position) with score and due: no priority counts as due with 50, the others within the grace of their next_due_at."""
    x = products.join(priorities, "id", "left")
    due = F.col("next_due_at").isNull() | (F.col("next_due_at") <= now + F.expr(f"INTERVAL {grace_hours} HOURS"))
    return x.withColumns({"score": F.coalesce("score", F.lit(50)), "due": due})


def merged_sets(old: DataFrame, new: DataFrame, key: str, array: str, keep: list[str], overwrite: list[str]) -> DataFrame:
    """An idempotent update: new keys come in, arrays are united, ``keep`` columns stay as they were, ``overwrite`` columns take the new value."""
    o, n = old.alias("o"), new.alias("n")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    none = F.array().cast(old.schema[array].dataType)
    return out.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key),
        F.array_sort(F.array_union(F.coalesce(f"o.{array}", none), F.coalesce(f"n.{array}", none))).alias(array),
        *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep),
        *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in overwrite),
    )


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, name) that are nobody's parent, one a folded name."""
    parents = tree.select(F.col("parent_id").alias("id")).filter("id is not null").distinct()
    free = tree.join(parents, "id", "left_anti")
    return latest(free.withColumn("_k", fold(F.col("name"))), ["_k"], [F.col("id")]).drop("_k")


def price_band(prices: DataFrame, by: list[str], want: str | None = None, span: float = 2.5, compact: float = 8.0, least: int = 3) -> DataFrame:
    """by, low, high, typical: the densest cloud of prices of a query, or the cheapest (low) or dearest (high) dense enough one.

    Each distinct price is a centre, and its cloud the prices within span of it.
    Prices are counted first; the bounds of all clouds are sorted among the prices
    of their query, and running sums at the bounds give what lies between. Nothing
    for few or compact prices.
    """
    hist = prices.filter("price > 0").groupBy(*by, "price").agg(F.count("*").alias("_c"))
    at = F.col("price").cast("double")
    # at one place the lower bound comes before the prices and the upper one after them
    marks = F.array(
        F.struct((at / span).alias("pos"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s")),
        F.struct(at.alias("pos"), F.lit(1).alias("kind"), F.col("_c").alias("c"), (F.col("_c") * F.col("price")).alias("s")),
        F.struct((at * span).alias("pos"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s")),
    )
    line = hist.select(*by, F.col("price").alias("_price"), F.explode(marks).alias("m")).select(*by, "_price", "m.*")
    so_far = Window.partitionBy(*by).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumns({"_count": F.sum("c").over(so_far), "_sum": F.sum("s").over(so_far)})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    x = line.groupBy(*by, F.col("_price").alias("_centre")).agg((of(2, "_count") - of(0, "_count")).alias("_m"), (of(2, "_sum") - of(0, "_sum")).alias("_total"), of(1, "_count").alias("_upto"))
    whole = Window.partitionBy(*by)
    x = x.withColumns({"_lo": F.min("_centre").over(whole), "_hi": F.max("_centre").over(whole), "_n": F.max("_upto").over(whole)})
    x = x.withColumn("_med", F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col("_centre"))).over(whole)).filter(F.col("_n") >= least)
    if want is None:
        x = x.filter(F.col("_hi") / F.col("_lo") > compact)
    x = x.withColumn("typical", F.bround(F.col("_total") / F.col("_m")).cast("long"))
    x = x.withColumn("_v", F.col("_m") >= F.greatest(F.lit(least), F.floor((F.col("_n") + 2) / 4)))
    x = x.withColumn("_any", F.max("_v").over(whole)).filter(F.col("_v") | ~F.col("_any"))
    order = {"low": [F.col("typical"), -F.col("_m")], "high": [-F.col("typical"), -F.col("_m")]}.get(want, [-F.col("_m"), F.abs(F.col("typical") - F.col("_med"))])
    one = latest(x, by, [*order, F.col("_centre")]).filter(F.col("_m") >= least)
    out = one.withColumns({"low": F.greatest(F.lit(1).cast("long"), F.floor(F.col("typical") / span)), "high": F.floor(F.col("typical") * span)})
    if want is None:
        out = out.filter(~((F.col("_lo") >= F.col("low")) & (F.col("_hi") <= F.col("high"))))
    return out.select(*by, "low", "high", "typical")
