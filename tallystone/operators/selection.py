"""Which offers of a product are real: integrity against history and market, the best card of each group, and user alerts.

offers: group columns, store, family, price, price_normal and what the detectors
of history found (verified, list_inflation, fake, pre_event, was_full, points),
joined by key beforehand, so that every rule here is a column or a window over
one group's offers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.sinks import renumbered

from . import offers as O
from .catalog import latest, quota

OWN_DISCOUNT = 10


def integrity(offers: DataFrame) -> DataFrame:
    """offers with flags, suspicious and real_savings_percent.

    They have commercial and verified discounts, list_savings (of the list
    inflation, null without), fake, pre_event, similar and market_savings.
    """
    zero = F.lit(0.0).cast("double")
    inflated = F.col("list_savings").isNotNull()
    flags = F.array_compact(F.array(F.when(inflated, F.lit("list_inflation")), F.when(F.col("fake"), F.lit("fake_discount")), F.when(F.col("pre_event"), F.lit("pre_event_inflation")), F.when(F.col("similar"), F.lit("similar_to_market"))))
    real = F.when(F.coalesce(F.col("similar"), F.lit(True)), F.col("verified")).otherwise(F.greatest(F.col("verified"), F.col("market_savings")))
    real = F.when(inflated, F.least(real, F.col("list_savings"))).otherwise(real)
    real = F.when(F.col("fake"), F.least(real, zero)).otherwise(real)
    own = F.col("commercial") >= OWN_DISCOUNT
    suspicious = inflated | F.col("fake") | (F.coalesce(F.col("similar"), F.lit(False)) & own) | (F.col("pre_event") & own & (F.col("verified") < OWN_DISCOUNT))
    return offers.withColumns({"flags": flags, "suspicious": suspicious, "real_savings_percent": F.round(real, 1)})


def real_offers(offers: DataFrame, group: list[str], aggregators: list[str], confidence: float = 0.9) -> DataFrame:
    """The best card of each group: store, kinds, gap, gap_percent, score, flags.

    Aggregators, sold-out and payment-restricted offers take no part. A family
    shows its cheapest store. Two families at least must sell; a card needs its own
    or a verified discount, must pass the integrity rules, be undercut by no other
    family unless history speaks for it, and have a kind: comparison (others sell
    near its list price) or history.
    """
    w = Window.partitionBy(*group)
    x = offers.filter(~F.col("store").isin(*aggregators) & ~O.sold_out(F.col("stock"), F.col("name")))
    x = x.filter((F.col("price") > 0) & ~O.payment_restricted(F.col("price"), F.col("price_all_payment"), F.col("price_card")))
    x = latest(x, [*group, "family"], [F.col("price"), F.col("store")])
    x = x.withColumn("_families", F.count("*").over(w)).filter("_families >= 2")
    # a row is its family's only one, so peers are the other rows of its group; few, as families are
    peers = F.filter("_all", lambda p: p["family"] != F.col("family"))
    x = x.withColumn("_all", F.sort_array(F.collect_list(F.struct("price", "store", "family")).over(w))).withColumn("_peers", peers)
    prices = F.transform("_peers", lambda p: p["price"])
    n = F.size(prices)
    middle = (F.get(prices, F.floor((n - 1) / 2).cast("int")) + F.get(prices, F.floor(n / 2).cast("int"))) / 2
    x = x.withColumns({"peer_min": F.get(prices, F.lit(0)), "peer_median": F.bround(middle).cast("long"), "rival_store": F.get("_peers", F.lit(0))["store"]})
    near = lambda c: F.col("price") >= F.col(c) * (1 - O.SAME_PRICE_RATIO)
    over = F.col("peer_median") - F.col("price")
    x = x.withColumns({"similar": near("peer_min") | near("peer_median"), "market_savings": F.when(over > 0, F.round(over * 100 / F.col("peer_median"), 1)).otherwise(F.lit(0.0).cast("double")), "commercial": O.discount_percent(F.col("price"), F.col("price_normal"))})
    x = integrity(x)
    own, told = F.col("commercial") >= OWN_DISCOUNT, F.col("verified") >= OWN_DISCOUNT
    doubt = F.col("list_savings").isNotNull() | F.col("fake") | F.col("pre_event")
    genuine = (F.col("real_savings_percent") >= OWN_DISCOUNT) & ~F.col("similar") & ~F.col("fake")
    x = x.filter((own | told) & (~doubt | genuine) & (~F.col("similar") | told))
    at_list = F.exists("_peers", lambda p: (p["price"] >= F.col("price_normal") * 0.9) & (p["price"] >= F.col("price") * (1 + O.MIN_GAP_RATIO)))
    history = (F.coalesce(F.col("was_full"), F.lit(False)) & F.col("list_savings").isNull() & ~F.col("fake")) | told
    kinds = F.array_compact(F.array(F.when(at_list & ~F.col("similar"), F.lit("comparison")), F.when(history, F.lit("history"))))
    gap = F.col("peer_min") - F.col("price")
    x = x.withColumns({"kinds": kinds, "gap": gap, "gap_percent": F.round(gap * 100 / F.col("peer_min"), 1)}).filter((F.size("kinds") > 0) & ((F.col("gap") > 0) | F.array_contains("kinds", "history")))
    score = O.offer_score(F.col("price") <= F.col("peer_min"), F.col("real_savings_percent"), F.lit(confidence).cast("double"), F.col("stock"), F.col("points").cast("double"), F.col("suspicious"), F.col("similar"))
    one = O.best_card(x.withColumn("score", F.round(score, 2)), group)
    return one.drop("_all", "_peers", "_families")


def group_confidence(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, confidence: the least, over its items, of an item's best pair. pairs: group, a, b, confidence."""
    each = pairs.select(*group, F.explode(F.array("a", "b")).alias("item"), "confidence")
    return each.groupBy(*group, "item").agg(F.max("confidence").alias("c")).groupBy(*group).agg(F.min("c").alias("confidence"))


def identity_pairs(offers: DataFrame, group: list[str], id: str, least: float, limit: int, seed: int = 21) -> DataFrame:
    """A seeded sample of pairs of different stores inside groups with confidence ``least`` at least, from the ``3 * limit`` most confident.

    A pair is as confident as its weaker side, so a group's best rows make the pairs:
    up to the first row of a second store and as many more as pairs are wanted, each
    making one at least, ties kept. Of one store's rows with one confidence the first
    by id suffice, as they make the earlier pairs.
    """
    n = 3 * limit
    best = Window.partitionBy(*group).orderBy(F.col("confidence").desc(), "store", "id")
    o = offers.select(*group, F.col(id).alias("id"), "store", "confidence").filter(F.col("confidence") >= least).distinct()
    o = o.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "store", "confidence").orderBy("id"))).filter(F.col("_k") <= n)
    o = o.withColumns({"_r": F.row_number().over(best), "_s": F.first("store").over(best)})
    second = o.groupBy(*group).agg(F.min(F.when(F.col("store") != F.col("_s"), F.col("_r"))).alias("_p")).filter("_p is not null")
    floor = o.join(second, group).filter(F.col("_r") <= F.col("_p") + n).groupBy(*group).agg(F.min("confidence").alias("_floor"))
    o = o.join(floor, group).filter(F.col("confidence") >= F.col("_floor")).select(*group, "id", "store", "confidence")
    other = o.select(*group, F.col("id").alias("b"), F.col("store").alias("_s"), F.col("confidence").alias("_c"))
    x = o.withColumnRenamed("id", "a").join(other, group).filter((F.col("a") < F.col("b")) & (F.col("store") != F.col("_s")))
    x = x.select("a", "b", F.least("confidence", "_c").alias("score")).distinct()
    top = x.orderBy(F.col("score").desc(), "a", "b").limit(n)
    return top.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))).limit(limit)


def display_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, shown (rows after variants and families were collapsed), stores (families), comparable, lowest."""
    variants = O.collapse_variants(rows)
    shown = O.collapse_families(variants, group)
    return shown.groupBy(*group).agg(F.count("*").alias("shown"), F.countDistinct("family").alias("stores"), (F.countDistinct("family") >= 2).alias("comparable"), F.min("price").alias("lowest"))


def marks_with_products(marks: DataFrame, products: DataFrame, key: list[str], kinds: list[str], hidden: list[str]) -> DataFrame:
    """Marks of these kinds whose product is still there at the price that was judged, none of hidden stores."""
    p = products.select(*key, F.col("price").alias("_now"))
    fresh = marks.join(p, key).filter((F.col("_now") == F.col("evaluated")) & ~F.col("store").isin(*hidden)).drop("_now")
    return fresh.filter(F.arrays_overlap("kinds", F.array(*(F.lit(k) for k in kinds))))


def seeded_sample(rows: DataFrame, key: list[Column], n: int, seed: int = 21) -> DataFrame:
    """n rows in an order that depends on a seed and the key alone, with the total of all."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))
    return rows.orderBy(order).limit(n).crossJoin(rows.agg(F.count("*").alias("total")))


# --- alerts and users ---------------------------------------------------------


def fits_person(basis: Column, card: Column, only_extremes: Column, sizes: Column, prefs: Column) -> Column:
    """Whether an offer is for a person's payment cards and sizes (struct payment_cards, preferred_sizes, arrays).

    A price of a named card needs that card; where only the extreme sizes are left,
    one of them must be preferred. Case and outer spaces do not count.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    listed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), plain)
    by_card = F.coalesce(basis == "card", F.lit(False)) & (plain(card) != "")
    card_ok = ~by_card | F.array_contains(listed(prefs["payment_cards"]), plain(card))
    return card_ok & (~F.coalesce(only_extremes, F.lit(False)) | F.arrays_overlap(listed(sizes), listed(prefs["preferred_sizes"])))


def wants(kind: Column, stock: Column, own: Column, other: Column, category: Column, prefs: Column, channel: str | None = None) -> Column:
    """Whether preferences (struct kinds, email_categories, min_self, min_other, min_real) let an alert through.

    Nothing sold out, and only kinds asked for; a watch passes then. By e-mail also
    only categories asked for, and real offers from a discount on. Else one of the
    known discounts must reach its floor; without any, floors must be zero.
    """
    ok = ~F.coalesce(stock <= 0, F.lit(False)) & F.array_contains(prefs["kinds"], kind)
    rest = F.lit(True)
    if channel == "email":
        rest = (F.size(prefs["email_categories"]) == 0) | F.array_contains(prefs["email_categories"], category)
        best = F.greatest(F.coalesce(own, F.lit(0.0)), F.coalesce(other, F.lit(0.0)))
        rest = rest & (~kind.isin("real", "super") | (prefs["min_real"] == 0) | (best >= prefs["min_real"]))
    none = own.isNull() & other.isNull()
    floors = F.coalesce(own >= prefs["min_self"], F.lit(False)) | F.coalesce(other >= prefs["min_other"], F.lit(False))
    return ok & ((kind == "watch") | (rest & F.when(none, (prefs["min_self"] == 0) & (prefs["min_other"] == 0)).otherwise(floors)))


def alert_discount(*values: Column) -> Column:
    """The largest of an alert's discounts without their signs, 0 without any."""
    return reduce(lambda a, b: F.greatest(a, b), (F.coalesce(F.abs(v.cast("double")), F.lit(0.0).cast("double")) for v in values)) if len(values) > 1 else F.coalesce(F.abs(values[0].cast("double")), F.lit(0.0).cast("double"))


def subscribers(changes: DataFrame, subscriptions: DataFrame, users: DataFrame, key: list[str]) -> DataFrame:
    """changes of subscribed keys with each approved user once, whether by a watch or by an alert."""
    s = subscriptions.select(*key, "user_id").distinct()
    return changes.join(s, key).join(users.filter("approved").select("user_id"), "user_id", "left_semi")


def watched_keys(watches: DataFrame, alerts: DataFrame, users: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that approved users watch or have alerts on."""
    both = watches.select("user_id", *key).unionByName(alerts.select("user_id", *key))
    return both.join(users.filter("approved").select("user_id"), "user_id", "left_semi").select(*key).distinct()


def boosted(feeds: list[tuple[DataFrame, int, int]], key: str) -> DataFrame:
    """key, score, interval_hours: the highest score of the feeds (keys, score, hours) that have it."""
    out = None
    for df, score, hours in feeds:
        one = df.select(key, F.lit(score).alias("score"), F.lit(hours).alias("interval_hours"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.max_by(F.struct("score", "interval_hours"), "score").alias("b")).select(key, "b.*")


def watchers(alerts: DataFrame, entity: list[str]) -> DataFrame:
    """entity, users: one row an entity with the set of its watchers, and how many."""
    x = alerts.groupBy(*entity).agg(F.array_sort(F.collect_set("user_id")).alias("users"))
    return x.withColumn("n", F.size("users"))


def host_alerts(hosts: DataFrame, limits: dict[str, tuple[float, float]], now: Column, stale_minutes: int = 10) -> DataFrame:
    """host, metric, level: a host without recent data has that alert only; else one for each metric over its warning or critical limit."""
    stale = F.col("seen").isNull() | (F.col("seen") < now - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    level = lambda m, w, c: F.when(F.col(m) >= c, "critical").when(F.col(m) >= w, "warning")
    found = F.array(*(F.struct(F.lit(m).alias("metric"), level(m, w, c).alias("level")) for m, (w, c) in limits.items()))
    offline = F.array(F.struct(F.lit("data").alias("metric"), F.when(F.col("seen").isNull(), "none").otherwise("stale").alias("level")))
    return hosts.select("host", F.explode(F.when(stale, offline).otherwise(found)).alias("a")).select("host", "a.*").filter("level is not null")


def worse(now: DataFrame, before: DataFrame, order: list[str]) -> DataFrame:
    """Alerts (host, metric, level) that are new or of a higher level than before; levels in rising order."""
    rank = lambda c: F.array_position(F.array(*(F.lit(x) for x in order)), c)
    b = before.select("host", "metric", rank(F.col("level")).alias("_b"))
    return now.join(b, ["host", "metric"], "left").filter(F.col("_b").isNull() | (rank(F.col("level")) > F.col("_b"))).drop("_b")


# --- adaptive visits ----------------------------------------------------------


def assessed(profiles: DataFrame) -> DataFrame:
    """profiles (observations, changes, volatility, unchanged_days, likely_drop, confirmed) with score 0 to 100, tier and interval_hours."""
    moving = F.when((F.col("changes") >= 4) | (F.col("volatility") >= 0.08), 25).when(F.col("changes") >= 2, 10).otherwise(0)
    still = F.when((F.col("observations") >= 60) & (F.col("unchanged_days") >= 90), -30).when((F.col("observations") >= 30) & (F.col("unchanged_days") >= 45), -20).otherwise(0)
    score = F.lit(50) + moving + still + F.when(F.col("likely_drop"), 35).otherwise(0) + F.when(F.col("confirmed"), 10).otherwise(0)
    x = profiles.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    step = lambda a, b, c, d: F.when(F.col("score") >= 75, a).when(F.col("score") >= 45, b).when(F.col("score") >= 25, c).otherwise(d)
    return x.withColumns({"tier": step("high", "normal", "low", "dormant"), "interval_hours": step(12, 24, 72, 168)})


def catalog_priorities(rows: DataFrame, now: Column, patterns: int = 5) -> DataFrame:
    """catalog_id: score, tier and interval of its first product by score, last_seen, next_due_at, products, and distinct patterns by score."""
    a = rows.filter("catalog_id is not null").groupBy("catalog_id").agg(F.min_by(F.struct("score", "tier", "interval_hours"), F.struct(-F.col("score"), F.col("id"))).alias("b"), F.max("last_seen").alias("last_seen"), F.count("*").alias("products"))
    p = rows.select("catalog_id", "score", F.explode("patterns").alias("pattern")).groupBy("catalog_id", "pattern").agg(F.max("score").alias("s"))
    p = quota(p, ["catalog_id"], [F.col("s").desc(), F.col("pattern")], patterns).groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("place", "pattern"))).alias("p"))
    x = a.join(p, "catalog_id", "left").select("catalog_id", "b.*", "last_seen", "products", F.transform(F.coalesce("p", F.array().cast("array<struct<place:int,pattern:string>>")), lambda e: e["pattern"]).alias("patterns"))
    return x.withColumn("next_due_at", F.coalesce(F.col("last_seen") + F.make_dt_interval(hours=F.col("interval_hours")), now))


# --- changes from several feeds -----------------------------------------------


def merged_changes(feeds: dict[str, DataFrame], query: Column) -> DataFrame:
    """key, query, price, previous_price, store, at, source, sources, n: one row a folded query.

    The feed's row with the latest change wins; what it does not know comes from the
    next one that does; sources are united, and rows numbered by the newest change.
    """
    fields = ["query", "price", "previous_price", "store", "at", "source"]
    out = None
    for name, df in feeds.items():
        one = df.withColumn("source", F.lit(name)).select(*fields)
        out = one if out is None else out.unionByName(one)
    x = out.withColumn("key", query).filter("key <> ''")
    order = F.struct(F.col("at").isNotNull(), F.col("at"), F.col("source"), F.coalesce("price", F.lit(0).cast("long")))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    a = x.groupBy("key").agg(*(newest(c) for c in ("query", "price", "previous_price", "store")), F.max("at").alias("at"), F.max_by("source", order).alias("source"), F.array_sort(F.collect_set("source")).alias("sources"))
    return a


def numbered(changes: DataFrame) -> DataFrame:
    """changes with n: 1 for the newest change, those without a time last."""
    return renumbered(changes, [F.col("at").desc_nulls_last(), F.col("query").desc()])


# --- quotes -------------------------------------------------------------------


def quote_candidates(lines: DataFrame, products: DataFrame, now: Column, least: float = 0.8, hours: int = 48) -> DataFrame:
    """lines (quote_id, i, item, quantity, unit_price) with their selected product's price, stock and issues; usable without any.

    products: item, price, stock, confidence, seen. A product that several lines of
    a quote select needs stock for all of them.
    """
    x = lines.withColumn("_need", F.sum("quantity").over(Window.partitionBy("quote_id", "item"))).join(products, "item", "left")
    issue = lambda c, name: F.when(c, F.lit(name))
    issues = F.array_compact(F.array(
        issue(F.col("confidence").isNull() | (F.col("confidence") < least), "match"), issue(F.col("seen") < now - F.expr(f"INTERVAL {hours} HOURS"), "stale"), issue(F.coalesce(F.col("stock") <= 0, F.lit(False)), "stock"),
        issue(F.col("price").isNull(), "price"), issue((F.col("_need") > F.col("quantity")) & (F.coalesce("stock", F.lit(0).cast("long")) < F.col("_need")), "total_stock"), issue(F.col("unit_price").isNull(), "reference"),
    ))
    return x.withColumn("issues", issues).withColumn("comparable", F.size("issues") == 0).drop("_need")


def quote_report(rows: DataFrame) -> DataFrame:
    """quote_id: items, compared, pending, reference and market subtotals and saving of the comparable lines, complete."""
    c = F.col("comparable")
    sum_ = lambda v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    reference, market = F.col("unit_price") * F.col("quantity"), F.col("price") * F.col("quantity")
    a = rows.groupBy("quote_id").agg(F.count("*").alias("items"), F.count(F.when(c, 1)).alias("compared"), sum_(reference).alias("reference_subtotal"), sum_(market).alias("market_subtotal"))
    return a.withColumns({"pending": F.col("items") - F.col("compared"), "saving": F.col("reference_subtotal") - F.col("market_subtotal"), "complete": F.col("items") == F.col("compared")})
