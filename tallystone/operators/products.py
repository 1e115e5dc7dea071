"""Product rows from raw fields, groups with their offers and histories, relevance of results, lists of a product, pages with priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.sinks import renumbered

from tallystone.functions import commerce
from tallystone.functions.money import money, sane_discount
from tallystone.functions.text import fold

from . import series as S
from .catalog import latest, quota


def product_rows(raw: DataFrame) -> DataFrame:
    """Normalized rows of raw ones (store, product_id, name, description, condition, price, price_normal, price_card, discount, stock, availability; all prices as texts).

    The price is for all means of payment unless only a card's price is known; a
    declared discount counts where it is sane; condition, shipping and financing are
    read from name and description.
    """
    prose = F.concat_ws(" ", "name", "description")
    price, normal, card = (money(F.col(c)) for c in ("price", "price_normal", "price_card"))
    now = F.coalesce(price, card)
    basis = F.when(price.isNotNull(), "all_payment").when(card.isNotNull(), "card")
    ship, fin = commerce.shipping(prose), commerce.financing(prose)
    state = commerce.stock_state(F.col("stock"), F.col("availability"))
    return raw.select(
        F.lower(F.trim("store")).alias("store"), F.trim("product_id").alias("product_id"), F.trim("name").alias("name"), now.alias("price"), F.when(normal >= now, normal).alias("price_normal"), card.alias("price_card"), basis.alias("price_basis"),
        sane_discount(F.col("discount"), normal, now).alias("discount"), commerce.condition(F.col("condition"), prose).alias("condition"), ship["cost"].alias("shipping_cost"), fin["instalments"].alias("instalments"), state.alias("stock_state"),
    )


def json_text(c: Column) -> Column:
    """All text values inside a JSON document, by spaces, in order."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r'(?:[:\[,]\s*)"((?:[^"\\]|\\.)*)"(?=\s*[,\]}])'), F.lit(1)), " ")


def differences(expected: Column, observed: Column, fields: list[str], verified: Column, same_region: Column) -> Column:
    """A map of fields to same, different or not_verified; stock compares if both sides are verified, shipping within one region."""
    status = lambda f: F.when(expected[f].isNull() | observed[f].isNull(), "not_verified").when(expected[f] == observed[f], "same").otherwise("different")
    gate = {"stock": verified, "shipping": same_region}
    return F.create_map(*(x for f in fields for x in (F.lit(f), F.when(~gate[f], "not_verified").otherwise(status(f)) if f in gate else status(f))))


def with_history(offers: DataFrame, points: DataFrame, key: list[str], order: list[str], n: int = 12) -> DataFrame:
    """offers with points, low, previous (the last other price), delta and the last n prices, oldest first."""
    h = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_h"))
    prices = F.transform("_h", lambda x: x["price"])
    x = offers.join(h, key, "left").withColumn("_p", F.coalesce(prices, F.array().cast("array<bigint>")))
    other = F.filter("_p", lambda v: v != F.col("price"))
    x = x.withColumns({"points": F.size("_p"), "low": F.array_min("_p"), "previous": F.get(other, F.size(other) - 1), "spark": F.slice("_p", F.greatest(F.lit(1), F.size("_p") - (n - 1)), n)})
    return x.withColumn("delta", F.col("price") - F.col("previous")).drop("_h", "_p")


def compared(offers: DataFrame, group: list[str]) -> DataFrame:
    """group, lowest, stores, comparable, offers (store:price in order) and place: comparable groups first, more stores, cheaper, by group."""
    x = offers.filter("price > 0").groupBy(*group).agg(F.min("price").alias("lowest"), F.countDistinct("family").alias("stores"), F.array_sort(F.collect_list(F.struct("price", "store"))).alias("_o"))
    x = x.withColumn("comparable", F.col("stores") >= 2).withColumn("offers", F.transform("_o", lambda o: F.concat(o["store"], F.lit(":"), o["price"].cast("string")))).drop("_o")
    return x


def relevant(scored: DataFrame, band: tuple[int, int] | None = None, share: float = 0.7) -> DataFrame:
    """Accepted rows (query_id, product_id, price, score, semantic, accepted) inside a band of prices, by the blend of both scores, then price."""
    x = scored.filter("accepted")
    if band:
        x = x.filter(F.col("price").between(*band))
    x = x.withColumn("blend", F.round(F.when(F.col("semantic").isNull(), F.col("score")).otherwise(share * F.col("score") + (1 - share) * F.col("semantic")), 6))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("blend").desc(), F.col("price").asc_nulls_last(), "product_id")))


def prioritized_page(rows: DataFrame, first: DataFrame, key: str, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows: those whose key is among the first keys (key, rank) before all others, in their rank."""
    x = rows.join(first.select(key, F.col("rank").alias("_k")), key, "left")
    return x.orderBy(F.col("_k").asc_nulls_last(), *order).offset((max(1, page) - 1) * size).limit(size).drop("_k")


def recent_sends(sends: DataFrame, by: list[str], now: Column, days: int = 5) -> DataFrame:
    """by, recent: the distinct entities that were sent to each receiver since some days, sorted."""
    x = sends.filter(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return x.groupBy(*by).agg(F.array_sort(F.collect_set("entity")).alias("recent"))


def list_keys(items: DataFrame, history: DataFrame, lists: list[str]) -> DataFrame:
    """Distinct product keys of these lists, from their items or their history."""
    pick = lambda df: df.filter(F.col("list_id").isin(*lists)).select("store", "product_id")
    return pick(items).unionByName(pick(history)).distinct()


def first_changes(history: DataFrame, items: DataFrame) -> DataFrame:
    """query, price, ts: the first change of each query of the history's items, which may be gone (the list and number are the query then)."""
    x = history.join(items.select("list_id", "n", "query"), ["list_id", "n"], "left").withColumn("query", F.coalesce("query", F.concat_ws(":", "list_id", F.col("n").cast("string"))))
    return latest(x, ["query"], [F.col("ts"), F.col("id")]).select("query", "price", "ts")


def peers_of(anchors: DataFrame, products: DataFrame, code: str, most: int = 24) -> DataFrame:
    """anchor, product_id, store: each anchor and the cheapest others of its code. Each code is ranked once; anchors meet its first ``most + 1`` only."""
    order = [F.col("price"), F.col("store"), F.col("product_id")]
    first = quota(products.filter(F.col(code).isNotNull()), [code], order, most + 1).select(F.col(code).alias("_c"), "product_id", "store", "price")
    a = anchors.select(F.col("product_id").alias("anchor"), F.col("store").alias("_s"), F.col(code).alias("_c"), "price").filter("_c is not null")
    others = a.drop("price").join(first, "_c").filter((F.col("product_id") != F.col("anchor")) | (F.col("store") != F.col("_s")))
    others = quota(others, ["anchor", "_s"], order, most)
    own = a.select("anchor", F.col("_s").alias("anchor_store"), F.col("anchor").alias("product_id"), F.col("_s").alias("store"))
    return own.unionByName(others.select("anchor", F.col("_s").alias("anchor_store"), "product_id", "store"))


def flattened(groups: DataFrame, offers: DataFrame, group: list[str]) -> DataFrame:
    """offers with lowest_price, comparable and kind of their group, and place: comparable groups first, then by price (none or 0 last) and store."""
    x = offers.join(groups.select(*group, "lowest_price", "comparable", "kind"), group)
    order = [(~F.coalesce("comparable", F.lit(False))).cast("int").alias("_o1"), F.col("price").isNull().cast("int").alias("_o2"), F.coalesce(F.nullif("price", F.lit(0)), F.lit(10**12)).alias("_o3"), F.coalesce("store", F.lit("")).alias("_o4"), *(F.col(c) for c in group)]
    return renumbered(x.select("*", *order[:4]), ["_o1", "_o2", "_o3", "_o4", *group]).drop("_o1", "_o2", "_o3", "_o4").withColumnRenamed("n", "place")


def stores_ranking(drops: DataFrame, stores: DataFrame, now: Column) -> DataFrame:
    """stores with drops, inflated, fake_percent, last_seen, days_silent and place, 0 for stores never seen. drops: store, inflated, ts."""
    a = drops.groupBy("store").agg(F.count("*").alias("drops"), F.count(F.when(F.col("inflated"), 1)).alias("inflated"), F.max("ts").alias("last_seen"))
    zero = F.lit(0).cast("long")
    x = stores.join(a, "store", "left").withColumns({"drops": F.coalesce("drops", zero), "inflated": F.coalesce("inflated", zero)})
    x = x.withColumns({"fake_percent": F.round(F.try_divide(F.col("inflated") * 100, F.col("drops")), 1), "days_silent": S.periods(now, F.col("last_seen"))})
    order = [F.col("drops").desc(), F.col("fake_percent").asc_nulls_last(), F.col("inflated"), F.col("last_seen").desc_nulls_last(), F.col("store")]
    return x.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row a store


def weighted_kappa(by_pair: DataFrame) -> DataFrame:
    """One row: pairs of reviewers, items, and the mean of their kappas weighted by items."""
    known = by_pair.filter("kappa is not null")
    return known.agg(F.count("*").alias("pairs"), F.sum("n").alias("items"), F.round(F.sum(F.col("kappa") * F.col("n")) / F.sum("n"), 6).alias("kappa"))


def name_tokens_left(query: Column, claimed: Column) -> Column:
    """Words of a query that no alias claimed, in order."""
    return F.array_except(query, claimed)


def counted_request(path: Column, method: Column, pages: list[str], api: list[str]) -> Column:
    """Whether a request counts as use: a page that is got, or a call of a listed interface."""
    page = (F.upper(method) == "GET") & path.isin(*pages)
    call = F.lit(False)
    for p in api:
        call = call | path.startswith(p)
    return page | call


def matches_all(name: Column, query: Column, soft: list[str]) -> Column:
    """Every word of the query that is not soft stands in the name."""
    hay = fold(name, separators=True)
    return F.forall(F.filter(query, lambda w: ~w.isin(*soft)), lambda w: F.contains(hay, w))
