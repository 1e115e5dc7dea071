"""Lists of watched queries during a sales event: what each query's offers say, what changed, where the price goes, what to do.

Items are (list_id, n, query); their offers and observations meet them by key.
Every function works by key, so a list's size is that of its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as S
from .catalog import latest, quota

#: Days of an event, the change that makes one wait or buy, and how near its low a price is at it.
EVENT_DAYS, TURN_PERCENT, NEAR_LOW_PERCENT = 3, 2.0, 3.0


def match_stats(offers: DataFrame, by: list[str]) -> DataFrame:
    """by, stores, bounds of list prices, the highest price, the lowest one and its store (the first by store on ties)."""
    priced = offers.filter("price > 0")
    return priced.groupBy(*by).agg(F.countDistinct("store").alias("stores"), F.min("price_normal").alias("min_normal"), F.max("price_normal").alias("max_normal"), F.max("price").alias("max_offer"), F.min("price").alias("min_offer"), F.min_by("store", F.struct("price", "store")).alias("best_store"))


def signatures(offers: DataFrame, by: list[str]) -> DataFrame:
    """by, last_matches: a map of store:product to price:normal:card."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.struct(F.concat_ws(":", "store", F.col("product_id").cast("string")).alias("key"), F.concat_ws(":", text("price"), text("price_normal"), text("price_card")).alias("value"))
    return offers.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("last_matches"))


def stats_from_signatures(items: DataFrame, by: list[str]) -> DataFrame:
    """match_stats of items (by, last_matches)."""
    x = items.select(*by, F.explode("last_matches").alias("key", "value"))
    part = lambda i: F.nullif(F.split_part("value", F.lit(":"), F.lit(i)), F.lit("")).try_cast("long")
    return match_stats(x.select(*by, F.split_part("key", F.lit(":"), F.lit(1)).alias("store"), part(1).alias("price"), part(2).alias("price_normal")), by)


def signature_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """by, key, before, after, previous_price, price of offers whose signature is another one; a first sight is silent. Both: by, last_matches."""
    flat = lambda df, name: df.select(*by, F.explode("last_matches").alias("key", name))
    x = flat(new, "after").join(flat(old, "before"), [*by, "key"]).filter("before <> after")
    price = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).try_cast("long")
    return x.select(*by, "key", "before", "after", F.coalesce(price("before"), price("after")).alias("previous_price"), price("after").alias("price"))


def evolution(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by: first and current price, change, lowest and highest with their moments and stores, best and worst discount, average."""
    at = F.struct(*order)
    discount = F.when(F.col("price_normal") > F.col("price"), F.round((F.col("price_normal") - F.col("price")) * 100 / F.col("price_normal"), 1)).otherwise(F.lit(0.0).cast("double"))
    place = lambda price: F.struct(price, *order)
    x = points.withColumn("_d", discount)
    a = x.groupBy(*by).agg(
        F.min_by("price", at).alias("first"), F.max_by("price", at).alias("current"), F.count("*").alias("points"), F.min("price").alias("low"), F.min_by(F.struct("ts", "store"), place("price")).alias("_l"),
        F.max("price").alias("high"), F.min_by(F.struct("ts", "store"), place(-F.col("price"))).alias("_h"), F.max("_d").alias("best_discount"), F.min("_d").alias("worst_discount"), F.round(F.avg("price"), 2).alias("average"),
    )
    return a.withColumns({"change": F.col("current") - F.col("first"), "low_at": F.col("_l.ts"), "low_store": F.col("_l.store"), "high_at": F.col("_h.ts"), "high_store": F.col("_h.store")}).drop("_l", "_h")


def dashboard(items: DataFrame, drops: int = 10, stores: int = 8) -> DataFrame:
    """section, place, key, value of items (n, price, previous_price, best_store, advice): counts, the largest drops and rises, the stores with most wins, coverage."""
    delta = F.when(F.col("previous_price").isNotNull() & (F.col("price") != F.col("previous_price")), F.col("price") - F.col("previous_price"))
    x = items.withColumn("delta", delta)
    n = lambda c: F.count(F.when(c, 1))
    totals = {"total": F.count("*"), "with_price": n(F.col("price") > 0), "down": n(F.col("delta") < 0), "up": n(F.col("delta") > 0), "unchanged": n(F.col("delta").isNull())}
    counts = x.agg(*(c.cast("long").alias(k) for k, c in totals.items()))
    counts = counts.withColumn("coverage_percent", F.bround(F.try_divide(F.col("with_price") * 100, F.col("total"))).cast("long"))
    as_rows = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in counts.columns))).alias("r")).select(F.lit("counts").alias("section"), F.lit(0).alias("place"), "r.key", "r.value")
    top = lambda rows, section, order, key, value: quota(rows.withColumn("_all", F.lit(1)), ["_all"], order, drops).select(F.lit(section).alias("section"), "place", F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    first = lambda rows, order, k: rows.orderBy(*order).limit(k)
    down, up = [F.col("delta"), F.col("n")], [F.col("delta").desc(), F.col("n")]
    wins = x.filter("price > 0").groupBy("best_store").agg(F.count("*").alias("wins"))
    won = [F.col("wins").desc(), F.col("best_store")]
    advice = x.filter("advice is not null").groupBy("advice").agg(F.count("*").alias("value")).select(F.lit("advice").alias("section"), F.lit(0).alias("place"), F.col("advice").alias("key"), "value")
    out = as_rows.unionByName(top(first(x.filter("delta < 0"), down, drops), "drops", down, "n", "delta")).unionByName(top(first(x.filter("delta > 0"), up, drops), "rises", up, "n", "delta"))
    return out.unionByName(top(first(wins, won, stores), "stores", won, "best_store", "wins")).unionByName(advice)


def event_days(points: DataFrame, by: list[str], days: int = EVENT_DAYS) -> DataFrame:
    """by, distinct: local days with points, remaining: days of the event that are still to come, today included."""
    x = points.groupBy(*by).agg(F.countDistinct(S.local_day("ts")).cast("int").alias("distinct"))
    return x.withColumn("remaining", F.greatest(F.lit(1), F.least(F.lit(days), F.lit(days + 1) - F.col("distinct"))))


def projected(points: DataFrame, by: list[str], order: list[str], horizon: int) -> DataFrame:
    """by, step, price: the last price and the least-squares slope by observation times observations a day, 1 at least.

    A day counts an hour at least; one observation repeats itself.
    """
    rows = points.withColumn("_i", F.row_number().over(S.ordered(by, order)) - 1)
    x, y = F.col("_i").cast("double"), F.col("price").cast("double")
    a = rows.groupBy(*by).agg(F.max_by("price", "_i").cast("double").alias("_last"), F.count("*").cast("double").alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / F.lit(86_400_000_000)).alias("_days"))
    run = F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")
    slope = F.coalesce(F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), run), F.lit(0.0))
    daily = slope * F.greatest(F.col("_n") / F.greatest(F.col("_days"), F.lit(1 / 24)), F.lit(1.0))
    steps = a.withColumn("_d", daily).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*by, "step", F.greatest(F.lit(1.0), F.round(F.col("_last") + F.col("_d") * F.col("step"), 2)).alias("price"))


def advice(current: Column, low: Column, expected: Column, points: Column) -> Column:
    """comprar, esperar or observar: wait for a projected fall, buy at or near the low or before a rise."""
    change = (expected - current) * 100 / current
    return F.when((points == 0) | (current <= 0) | current.isNull(), "observar").when(change <= -TURN_PERCENT, "esperar").when((current <= low) | ((current - low) * 100 / low <= NEAR_LOW_PERCENT), "comprar").when(change >= TURN_PERCENT, "comprar").otherwise("observar")


def event_advice(points: DataFrame, by: list[str], order: list[str], horizon: int = EVENT_DAYS) -> DataFrame:
    """by, current, low, expected, advice of each item's observations in the event."""
    expected = projected(points, by, order, horizon).groupBy(*by).agg(F.avg("price").alias("expected"))
    a = points.groupBy(*by).agg(F.max_by("price", F.struct(*order)).alias("current"), F.min("price").alias("low"), F.count("*").alias("points"))
    return a.join(expected, by).withColumn("advice", advice(F.col("current"), F.col("low"), F.col("expected"), F.col("points"))).withColumn("expected", F.round("expected", 2)).drop("points")


def lap_samples(points: DataFrame, by: list[str], order: list[str], laps: Column) -> DataFrame:
    """by, day, lap, price: the last price of each lap of a day, whether it changed or not."""
    x = points.withColumns({"day": F.to_date("ts"), "lap": laps})
    return x.groupBy(*by, "day", "lap").agg(F.max_by("price", F.struct(*order)).alias("price"))


def tracker_changes(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, ts, previous_price, price, store where the best price or, both being known, its store changed; a first sight is none."""
    w = S.ordered(by, order)
    old_price, old_store = F.lag("price").over(w), F.lag("store").over(w)
    x = points.withColumns({"previous_price": old_price, "previous_store": old_store})
    moved = (F.col("previous_price") != F.col("price")) | F.coalesce(F.col("previous_store") != F.col("store"), F.lit(False))
    return x.filter(F.col("previous_price").isNotNull() & F.col("price").isNotNull() & moved)


def appended(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Points that the history keeps: the first of a day, and those whose price, store or list price differs from the day's point before."""
    x = points.withColumn("day", S.local_day("ts"))
    return S.value_changes(x, [*by, "day"], order, ["price", "store", "price_normal"])


def price_deltas(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, previous_price, price and their list prices where a known price is another one now; first sights are left out."""
    o = old.select(*key, F.col("price").alias("previous_price"), F.col("price_normal").alias("previous_normal"))
    return new.join(o, key).filter("previous_price <> price").select(*key, "previous_price", "price", "previous_normal", "price_normal")


def ranked_matches(offers: DataFrame, by: list[str], limit: int = 6) -> DataFrame:
    """The first offers of each query: cheapest, then most discounted, store, product."""
    discount = F.coalesce((F.col("price_normal") - F.col("price")) / F.col("price_normal"), F.lit(0.0))
    return quota(offers.filter("price > 0"), by, [F.col("price"), discount.desc(), F.col("store"), F.col("product_id")], limit)


def deduplicated(items: DataFrame, query: Column, best: list[Column]) -> DataFrame:
    """One item of each folded query, the best by this order, with place: 1 and up by n over all lists that are kept."""
    x = latest(items.withColumn("_q", query), ["list_id", "_q"], best).drop("_q")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy("n")))


def rotated(items: DataFrame, list_id: str, n: str, start: Column) -> DataFrame:
    """items with turn: each list from its start on, then from its beginning."""
    return items.withColumn("turn", F.row_number().over(Window.partitionBy(list_id).orderBy((F.col(n) < start).cast("int"), n)))


def following(lists: DataFrame, slug: str) -> DataFrame:
    """lists with next: the running list that follows it by slug, the first one after the last."""
    w = Window.orderBy(slug)  # one row a list
    running = lists.filter("running").select(F.col(slug)).withColumn("next", F.coalesce(F.lead(slug).over(w), F.first(slug).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return lists.join(running, slug, "left")


def prioritized(stores: DataFrame, cap: int) -> DataFrame:
    """stores (store, preferred, optional, position) with turn, up to cap: preferred, the others, the optional ones last with room kept for them."""
    room = F.lit(cap) - F.count(F.when(F.col("optional"), 1)).over(Window.partitionBy())  # one row a store
    first = F.row_number().over(Window.partitionBy("optional").orderBy(F.col("preferred").desc(), "position"))
    x = stores.withColumns({"_room": F.greatest(F.lit(0).cast("long"), room), "_k": first}).filter(F.col("optional") | (F.col("_k") <= F.col("_room")))
    return x.withColumn("turn", F.row_number().over(Window.orderBy(F.col("optional"), "_k"))).filter(F.col("turn") <= cap).drop("_room", "_k")


def personalized(offers: DataFrame, groups: str, favorites: DataFrame, excluded: DataFrame) -> DataFrame:
    """A user's view of groups: offers of excluded stores go and with them emptied groups; favourites first in their order; lowest and stores anew."""
    x = offers.join(excluded.select("store"), "store", "left_anti").join(favorites.select("store", F.col("rank").alias("_f")), "store", "left")
    w = Window.partitionBy(groups)
    x = x.withColumns({"turn": F.row_number().over(w.orderBy(F.col("_f").asc_nulls_last(), "price", "store")), "lowest": F.min("price").over(w), "comparable": F.size(F.collect_set("family").over(w)) >= 2})
    return x.drop("_f")
