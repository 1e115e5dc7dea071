"""Registered queries on reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.text import tokens
from tallystone.operators import reports as R
from tallystone.operators import rules
from tallystone.registry import query

from .decisions import _BASKET, _PREV, _grid, _offers_with_stats
from .series import points
from .store import _ALERTS, _WORDS, alerts
from .views import KEY, NOW, OFF, ORD, ORDER, SER, as_of, observations, offers, table


@query("""SELECT 'orders' AS section, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'sums', 'exported', coalesce(sum(round(o_totalprice)) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT FROM orders""")
def purchasing_metrics(spark, sf_dir):
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    return R.metrics({"orders": (orders, F.col("o_orderstatus")), "events": (events, F.col("event_type"))}, {"exported": F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice"))})


@query("""WITH o AS (SELECT o_custkey, 's' || (l_suppkey % 5) AS store, l_partkey, max(l_quantity = 10) AS e, min(round(l_extendedprice)::BIGINT) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_custkey, count(*) AS offers, count(DISTINCT store) AS stores, count(*) FILTER (WHERE e) AS exact, min(price) AS lowest FROM o GROUP BY 1""")
def product_analysis(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    x = line.select("o_custkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("store"), "l_partkey", "l_quantity", F.round("l_extendedprice").cast("long").alias("price"))
    return R.group_analysis(x, ["o_custkey"], ["store", "l_partkey"], F.col("l_quantity") == 10)


@query("WITH s AS (SELECT lower(event_type) AS grp FROM events ORDER BY md5('21:' || event_id), event_id LIMIT 800) SELECT grp, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, grp LIMIT 3")
def sampled_categories(spark, sf_dir):
    return R.sampled_groups(table(spark, sf_dir, "events"), ["event_id"], F.lower("event_type"), 800, 3)


@query("SELECT p_partkey AS product_id FROM part WHERE p_retailprice > 0 AND lower(p_type) IN ('promo', 'standard') AND (contains(lower(p_name || ' ' || p_type), 'red') OR contains(lower(p_name || ' ' || p_type), 'small'))")
def category_with_synonyms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    return R.of_category(p, "promo", {"promo": (["standard"], ["red", "small"])}).select("product_id")


@query(f"""WITH p AS (SELECT p_partkey AS product_id, round(p_retailprice)::BIGINT AS price, p_brand AS brand, p_type AS category, {_WORDS.format('p_name')} AS w FROM part), s AS (SELECT * FROM p WHERE product_id % 100 = 0),
x AS (SELECT s.product_id AS id, p.product_id, p.price, CASE WHEN len(list_intersect(s.w, p.w)) > 0 THEN 1 WHEN s.category = p.category OR s.brand = p.brand THEN 2 END AS tier FROM s, p WHERE s.product_id <> p.product_id)
SELECT id, product_id, tier::INT AS tier, row_number() OVER (PARTITION BY id ORDER BY tier, price, product_id)::INT AS place FROM x WHERE tier IS NOT NULL QUALIFY place <= 12""")
def tiered_candidates(spark, sf_dir):
    """Seeds: every part whose id is divisible by 100, against all parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.round("p_retailprice").cast("long").alias("price"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.array_distinct(tokens(F.col("p_name"))).alias("words"))
    return R.tiered_candidates(p.filter("product_id % 100 = 0").withColumnRenamed("product_id", "id"), p, 12).select("id", "product_id", "tier", "place")


@query(f"""WITH {OFF}, fl AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs), ser AS (SELECT * FROM fl WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment')), {_PREV},
d AS (SELECT store, product_id, price, previous_price, previous_price - price AS f, (previous_price - price) * 100 / previous_price AS pc FROM cur JOIN prev USING (store, product_id) WHERE price < previous_price),
o AS (SELECT cur.store, cur.product_id, cur.price, family, shipping_cost FROM cur JOIN off ON off.store = cur.store AND off.product_id = cur.product_id), b AS (SELECT product_id, family, min(price + shipping_cost) AS v, arg_min(store, (price + shipping_cost, store)) AS store FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY v, store) AS n FROM b)
SELECT store, product_id, concat_ws('+', CASE WHEN pc >= 40 THEN 'price_drop_percent' END, CASE WHEN f >= 20000 THEN 'price_drop_amount' END) AS rule, f AS saving FROM d WHERE pc >= 40 OR f >= 20000 UNION ALL SELECT store, product_id, 'below_median', median - price FROM cur WHERE points >= 3 AND round((price - median) * 100 / median, 1) <= -40
UNION ALL SELECT a.store, a.product_id, 'cross_store_gap', z.v - a.v FROM r a JOIN r z ON a.product_id = z.product_id AND a.n = 1 AND z.n = 2 WHERE (z.v - a.v) * 100 / z.v >= 40""")
def alert_families(spark, sf_dir):
    return R.alert_families(_offers_with_stats(spark, sf_dir), KEY, ["product_id"], rules.RULES["drop_percent"], rules.RULES["drop_amount"], rules.RULES["below_median_percent"], rules.RULES["gap_percent"])


@query("""WITH c AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '1999-01-30', INTERVAL 1 DAY))::DATE AS day) SELECT c.day, count(o_orderkey) AS n FROM c LEFT JOIN orders ON o_orderdate::DATE = c.day AND o_orderstatus <> 'P' GROUP BY 1""")
def searches_daily(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return R.daily_counts(o, F.to_date("o_orderdate"), F.lit("1999-01-30").cast("date"), 30)


_ORDERS = [("saving", "saving DESC NULLS LAST"), ("discount", "discount DESC NULLS LAST"), ("price_asc", "price NULLS LAST"), ("price_desc", "price DESC NULLS LAST"), ("name", "name NULLS LAST"), ("recent", "ts DESC NULLS LAST")]


@query(f"WITH {OFF}, d AS (SELECT store, product_id, CASE WHEN product_id % 9 <> 0 THEN price END AS price, name, ts, price_normal - price AS saving, (price_normal - price) / price_normal AS discount FROM off WHERE price_normal > price) " + " UNION ALL ".join(f"(SELECT '{n}' AS sort, row_number() OVER (ORDER BY {o}, store, product_id)::INT AS place, store, product_id FROM d QUALIFY place <= 5)" for n, o in _ORDERS))
def deal_orders(spark, sf_dir):
    o = offers(spark, sf_dir).filter("price_normal > price")
    d = o.select(*KEY, F.when(F.col("product_id") % 9 != 0, F.col("price")).alias("price"), "name", "ts", (F.col("price_normal") - F.col("price")).alias("saving"), ((F.col("price_normal") - F.col("price")) / F.col("price_normal")).alias("discount"))
    return R.deal_orders(d, KEY, 5)


@query(f"WITH {_ALERTS}, t AS (SELECT * FROM al WHERE day = DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY category, user_id ORDER BY saving DESC, id) = 1), f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM al z WHERE z.day < DATE '2024-01-20' AND z.day >= DATE '2024-01-15' AND z.category = t.category AND z.user_id = t.user_id)) SELECT id, category, user_id, saving, (SELECT coalesce(sum(saving), 0)::BIGINT FROM f) AS total_saving FROM f")
def new_deals_of_day(spark, sf_dir):
    a = alerts(spark, sf_dir).filter("day >= '2024-01-15'")
    return R.new_deals(a, ["category", "user_id"], F.lit("2024-01-20").cast("date"), [F.col("saving").desc(), F.col("id")]).select("id", "category", "user_id", "saving", "total_saving")


@query(f"""WITH {_BASKET}, m2 AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY price NULLS LAST, store) = 1 AND price IS NOT NULL AS best FROM g)
SELECT store, count(*) FILTER (WHERE state = 'usable') AS usable, count(*) FILTER (WHERE state = 'unusable') AS unusable, count(*) FILTER (WHERE state IN ('no_match', 'no_catalog')) AS missing, coalesce(sum(price * quantity), 0)::BIGINT AS total, count(*) FILTER (WHERE state = 'usable') = count(*) AS complete, count(*) FILTER (WHERE best) AS best_items FROM m2 GROUP BY 1""")
def matrix_report(spark, sf_dir):
    return R.matrix_report(_grid(spark, sf_dir))


@query(f"""WITH {SER}, l AS (SELECT store, product_id, max(ts) AS at_ FROM ser WHERE ts < TIMESTAMP '1998-01-01' GROUP BY ALL) SELECT store, product_id, count(*) AS since, any_value(at_) IS NULL OR count(*) >= 8 OR any_value(at_) < TIMESTAMP '2001-08-01 18:00:00' - INTERVAL 40000 HOUR + INTERVAL 6 HOUR AS due FROM ser LEFT JOIN l USING (store, product_id) WHERE at_ IS NULL OR ts > at_ GROUP BY ALL""")
def refreshes_due(spark, sf_dir):
    p = points(spark, sf_dir)
    last = p.filter("ts < '1998-01-01'").groupBy(*KEY).agg(F.max("ts").alias("at"))
    return R.refresh_due(p, last, KEY, as_of(), changes=8, hours=40000)
