"""Registered queries on offers across stores. The comparison group is the product."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import offers as O
from tallystone.operators import series as S
from tallystone.operators import stats as T
from tallystone.registry import query

from .series import points
from .views import KEY, NOW, OFF, ORD, ORDER, SER, WIN, marked_observations, observations, of_parts, offers

G = ["product_id"]


@query(f"""WITH {OFF}, p AS (SELECT o.store, o.product_id, o.price, q.store AS rs, q.price AS rp FROM off o JOIN off q ON o.product_id = q.product_id AND o.family <> q.family AND q.price > 0 AND q.stock > 0),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY store, product_id ORDER BY rp, rs) = 1)
SELECT store, product_id, price, rs AS rival_store, rp AS rival_price, price - rp AS gap, round((price - rp) * 100 / price, 1) AS gap_percent FROM b WHERE price > rp AND (price - rp) / price >= 0.03""")
def cheaper_elsewhere(spark, sf_dir):
    return O.cheaper_elsewhere(offers(spark, sf_dir), G).select(*KEY, "price", "rival_store", "rival_price", "gap", "gap_percent")


@query(f"""WITH {OFF}, b AS (SELECT *, price_normal > price + 1 AS shelf FROM off),
p AS (SELECT o.store, o.product_id, q.store AS witness, q.price AS witness_price FROM b o JOIN b q ON o.product_id = q.product_id AND o.family <> q.family WHERE o.shelf AND NOT q.shelf AND q.price <= o.price + 1 QUALIFY row_number() OVER (PARTITION BY o.store, o.product_id ORDER BY q.price, q.store) = 1)
SELECT * FROM p""")
def false_list_discounts(spark, sf_dir):
    return O.false_list_discounts(offers(spark, sf_dir), G).select(*KEY, "witness", "witness_price")


@query(f"""WITH {OFF} SELECT o.store, o.product_id, count(*) AS peers, min(q.price) AS least_peer FROM off o JOIN off q ON o.product_id = q.product_id AND o.family <> q.family AND q.price >= o.price_normal * 0.9::DOUBLE AND q.price >= o.price * 1.1::DOUBLE GROUP BY ALL""")
def peers_at_list(spark, sf_dir):
    return O.peers_at_list(offers(spark, sf_dir), G)


@query(f"""WITH {OFF}, a AS (SELECT o.store, o.product_id, o.price, min(q.price) AS peer_min, round_even(median(q.price), 0)::BIGINT AS peer_median FROM off o JOIN off q ON o.product_id = q.product_id AND o.store <> q.store GROUP BY ALL)
SELECT *, peer_min - price AS gap_vs_min, peer_median - price AS gap_vs_median, CASE WHEN peer_median > price THEN round((peer_median - price) * 100 / peer_median, 1) ELSE 0.0::DOUBLE END AS real_savings_percent,
  price >= peer_min * 0.97::DOUBLE OR price >= peer_median * 0.97::DOUBLE AS similar_to_market FROM a""")
def cross_store_anchor(spark, sf_dir):
    return O.cross_store_anchor(offers(spark, sf_dir), G)


@query(f"""WITH {OFF}, f AS (SELECT *, lower(name) AS fn FROM off), r AS (SELECT store, product_id, price, count(*) OVER w AS variants, min(price) OVER w AS min_price, max(price) OVER w AS max_price, row_number() OVER (PARTITION BY store, fn ORDER BY price, product_id) AS n FROM f WINDOW w AS (PARTITION BY store, fn))
SELECT * EXCLUDE n FROM r WHERE n = 1""")
def collapse_variants(spark, sf_dir):
    return O.collapse_variants(offers(spark, sf_dir)).select(*KEY, "price", "variants", "min_price", "max_price")


@query(f"""WITH {OFF}, g AS (SELECT product_id, family, list(store ORDER BY price, store) AS s, min(price) AS price FROM off GROUP BY ALL) SELECT product_id, family, s[1] AS store, price, array_to_string(s[2:], ',') AS mirrors FROM g""")
def collapse_mirrors(spark, sf_dir):
    out = O.collapse_families(offers(spark, sf_dir), G)
    return out.select("product_id", "family", "store", "price", F.array_join("mirrors", ",").alias("mirrors"))


@query(f"WITH {OFF} SELECT store, brand, arg_min(product_id, (price, product_id)) AS product_id, min(price) AS price FROM off GROUP BY store, brand")
def collapse_per_store(spark, sf_dir):
    return O.collapse(offers(spark, sf_dir), ["store", "brand"], [F.col("price"), F.col("product_id")]).select("store", "brand", "product_id", "price")


@query(f"""WITH {OFF}, v AS (SELECT *, price + greatest(0, shipping_cost) AS value FROM off) SELECT product_id, min(value) AS lowest, arg_min(store, (value, store)) AS lowest_store, count(*) AS offers, count(DISTINCT family) AS retailers, count(DISTINCT family) >= 2 AS comparable, true AS landed FROM v GROUP BY product_id""")
def comparison_groups(spark, sf_dir):
    return O.group_summary(offers(spark, sf_dir), G)


@query(f"""WITH {OFF}, c AS (SELECT *, price_all_payment IS NULL AS restricted, coalesce(price_all_payment, 0) AS comparable FROM off)
SELECT store, product_id, restricted, comparable, CASE WHEN restricted THEN 0.0::DOUBLE WHEN price_normal > comparable THEN round((price_normal - comparable) * 100 / price_normal, 1) ELSE 0.0::DOUBLE END AS own_discount, price + shipping_cost AS landed, stock <= 0 AS sold_out,
  price || ':' || price_normal || ':' || coalesce(price_card::VARCHAR, '') AS signature FROM c""")
def offer_prices(spark, sf_dir):
    o = offers(spark, sf_dir)
    price = O.comparable_price(F.col("price"), F.col("price_all_payment"), F.col("price_card"))
    signature = F.concat_ws(":", F.col("price").cast("string"), F.col("price_normal").cast("string"), F.coalesce(F.col("price_card").cast("string"), F.lit("")))
    return o.select(*KEY, O.payment_restricted(F.col("price"), F.col("price_all_payment"), F.col("price_card")).alias("restricted"), price.alias("comparable"), O.discount_percent(price, F.col("price_normal")).alias("own_discount"), O.landed_price(F.col("price"), F.col("shipping_cost")).alias("landed"), O.sold_out(F.col("stock"), F.col("name")).alias("sold_out"), signature.alias("signature"))


_ANCHOR = "anc AS (SELECT o.store, o.product_id, min(q.price) AS pm, round_even(median(q.price), 0)::BIGINT AS pd FROM off o JOIN off q ON o.product_id = q.product_id AND o.store <> q.store GROUP BY ALL)"
_VERIFIED = f"""cu AS (SELECT store, product_id, arg_max(price, ({ORD})) AS c FROM ser GROUP BY ALL), pt AS (SELECT store, product_id, count(*) AS points FROM ser GROUP BY ALL),
ot AS (SELECT ser.store, ser.product_id, c, price, row_number() OVER (PARTITION BY ser.store, ser.product_id ORDER BY {', '.join(x + ' DESC' for x in ORDER)}) AS k FROM ser JOIN cu USING (store, product_id) WHERE price <> c),
vf AS (SELECT store, product_id, CASE WHEN count(*) >= 2 AND median(price) > any_value(c) THEN round((median(price) - any_value(c)) * 100 / median(price), 1) ELSE 0.0::DOUBLE END AS verified FROM ot WHERE k <= 30 GROUP BY ALL)"""


def _scored(spark, sf_dir):
    last = T.last_with_history(marked_observations(spark, sf_dir), KEY, ORDER, F.col("_kept"))
    x = O.anchored(of_parts(spark, sf_dir, last, "verified_discount", "points"), G)
    best = F.col("price") <= F.col("peer_min")
    score = O.offer_score(best, F.col("real_savings_percent"), F.lit(0.9).cast("double"), F.col("stock"), F.col("points").cast("double"), F.lit(False), F.col("similar_to_market"))
    verified_ = F.col("verified_discount")
    kinds = F.array_compact(F.array(F.when(F.col("real_savings_percent") >= 10, F.lit("comparison")), F.when(verified_ >= 10, F.lit("history"))))
    gap_percent = F.round(F.greatest(F.lit(0).cast("long"), F.col("gap_vs_min")) * 100 / F.col("peer_min"), 1)
    x = x.withColumns({"score": F.round(score, 2), "kinds": kinds, "gap": F.greatest(F.lit(0).cast("long"), F.col("gap_vs_min")), "gap_percent": gap_percent, "verified": verified_})
    return x.withColumn("is_super", O.super_offer(F.col("kinds"), F.col("gap_percent"), O.discount_percent(F.col("price"), F.col("price_normal")), F.col("verified")))


@query(f"""WITH {OFF}, flagged AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs), ser AS (SELECT * FROM flagged WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment')), {_ANCHOR}, {_VERIFIED},
x AS (SELECT off.*, pm, coalesce(verified, 0.0::DOUBLE) AS verified, coalesce(points, 0) AS points, CASE WHEN pd > price THEN round((pd - price) * 100 / pd, 1) ELSE 0.0::DOUBLE END AS sav, price >= pm * 0.97::DOUBLE OR price >= pd * 0.97::DOUBLE AS sim FROM off JOIN anc USING (store, product_id) LEFT JOIN vf USING (store, product_id) LEFT JOIN pt USING (store, product_id)),
s AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (CASE WHEN price <= pm THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END) + 30 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, sav / 30)) + 15 * 0.9::DOUBLE + (CASE WHEN stock > 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END) + 5 * least(1.0::DOUBLE, points::DOUBLE / 5.0::DOUBLE) - (CASE WHEN sim THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END))), 2) AS score, greatest(0, pm - price) AS gap, round(greatest(0, pm - price) * 100 / pm, 1) AS gap_percent FROM x)
SELECT product_id, store, score, gap, gap_percent, verified, concat_ws('+', CASE WHEN sav >= 10 THEN 'comparison' END, CASE WHEN verified >= 10 THEN 'history' END) AS kinds,
  (sav >= 10 OR verified >= 10) AND (gap_percent > 50 OR greatest(CASE WHEN price_normal > price THEN round((price_normal - price) * 100 / price_normal, 1) ELSE 0.0::DOUBLE END, verified) > 50) AS is_super
FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, gap DESC, gap_percent DESC, store) = 1""")
def best_offer_cards(spark, sf_dir):
    out = O.best_card(_scored(spark, sf_dir), G)
    return out.select("product_id", "store", "score", "gap", "gap_percent", "verified", F.array_join("kinds", "+").alias("kinds"), "is_super")


@query(f"""WITH {SER}, d AS (SELECT *, lag(price) OVER w AS b FROM ser {WIN}), e AS (SELECT store, product_id, ts::DATE AS day, max(round((b - price) * 100 / b, 1)) AS percent, min(price) AS price FROM d WHERE b > price AND (b - price) * 100 / b >= 40 GROUP BY ALL),
f AS (SELECT *, min(day) OVER (PARTITION BY store, product_id) AS first FROM e) SELECT store, product_id, day, percent, price FROM f WHERE day = first""")
def deals_new_today(spark, sf_dir):
    drops = S.drop_events(points(spark, sf_dir), KEY, ORDER).filter((F.col("previous_price") - F.col("price")) * 100 / F.col("previous_price") >= 40)
    daily = drops.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.max("percent").alias("percent"), F.min("price").alias("price"))
    return O.latest_before(daily, KEY, "day")


@query(f"""WITH {OFF}, m AS (SELECT store, product_id, ts::DATE AS day, price AS evaluated FROM obs QUALIFY row_number() OVER (PARTITION BY store, product_id, ts::DATE ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) = 1)
SELECT m.store, count(*) AS fresh, (SELECT count(*) FROM m z WHERE z.store = m.store) AS marks FROM m JOIN off o ON m.store = o.store AND m.product_id = o.product_id AND m.evaluated = o.price GROUP BY m.store""")
def real_offers_fresh(spark, sf_dir):
    """Daily marks whose evaluated price is still the product's price; the others are stale."""
    o = observations(spark, sf_dir)
    marks = o.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct(*ORDER)).alias("evaluated"))
    now = offers(spark, sf_dir).select(*KEY, "price")
    joined = marks.join(now, KEY, "left").groupBy("store").agg(F.count(F.when(F.col("evaluated") == F.col("price"), 1)).alias("fresh"), F.count("*").alias("marks"))
    return joined.filter("fresh > 0")


@query("SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def orphan_relations(spark, sf_dir):
    from .views import table

    kept = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(kept, "l_orderkey", "left_anti").agg(F.count("*").alias("orphans"))
