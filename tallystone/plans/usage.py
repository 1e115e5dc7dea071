"""Registered queries on usage (the events table) and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.text import fold, tokens
from tallystone.operators import catalog as C
from tallystone.operators import usage as U
from tallystone.registry import query

from .views import KEY, OFF, offers, table

TODAY = "2024-01-30"
_D = "timezone('America/Santiago', timezone('UTC', ts))"


def hits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("visitor"), "event_type", F.get_json_object("props", "$.k").alias("k"), "value")


def today():
    return F.lit(TODAY).cast("date")


@query(f"""WITH h AS (SELECT {_D}::DATE AS day, user_id FROM events), c AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '{TODAY}', INTERVAL 1 DAY))::DATE AS day)
SELECT c.day, count(h.user_id) AS requests, count(DISTINCT h.user_id) AS visitors FROM c LEFT JOIN h USING (day) GROUP BY c.day""")
def usage_requests_daily(spark, sf_dir):
    return U.daily_usage(hits(spark, sf_dir), today(), 30)


@query(f"""WITH h AS (SELECT {_D}::DATE AS day, user_id FROM events) SELECT w AS "window", count(*) AS requests, count(DISTINCT user_id) AS visitors FROM h, (SELECT unnest([1, 7, 30]) AS w) WHERE day BETWEEN DATE '{TODAY}' - (w - 1) AND DATE '{TODAY}' GROUP BY w""")
def usage_visitors(spark, sf_dir):
    return U.window_visitors(hits(spark, sf_dir), today())


@query(f"""WITH h AS (SELECT {_D}::DATE AS day, hour({_D}) AS hour FROM events WHERE {_D}::DATE BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}'), a AS (SELECT unnest(range(24))::INT AS hour)
SELECT a.hour, count(day) FILTER (WHERE day = DATE '{TODAY}') AS today, round(count(day) FILTER (WHERE day < DATE '{TODAY}') / 30::DOUBLE, 4) AS average FROM a LEFT JOIN h ON a.hour = h.hour GROUP BY a.hour""")
def usage_hours(spark, sf_dir):
    return U.hours(hits(spark, sf_dir), today(), 30)


@query("SELECT user_id AS visitor, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, visitor LIMIT 12")
def usage_origins_top(spark, sf_dir):
    return U.top(hits(spark, sf_dir), ["visitor"], 12)


@query("SELECT lower(k) AS folded, count(*) AS n, arg_max(k, (ts, event_id)) AS query FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view') WHERE k IS NOT NULL GROUP BY 1 ORDER BY n DESC, folded LIMIT 15")
def usage_searches_top(spark, sf_dir):
    s = hits(spark, sf_dir).filter("event_type = 'view' and k is not null").select(F.col("k").alias("query"), "ts", F.col("event_id").alias("id"))
    return U.top_queries(s, fold(F.col("query")), 15)


_KINDS = ["click", "view", "purchase", "share"]


@query(f"""WITH k AS (SELECT unnest(['click', 'view', 'purchase', 'share']) AS kind), h AS (SELECT event_type AS kind, {_D}::DATE AS day FROM events)
SELECT k.kind, count(day) FILTER (WHERE day = DATE '{TODAY}') AS days_1, count(day) FILTER (WHERE day BETWEEN DATE '{TODAY}' - 6 AND DATE '{TODAY}') AS days_7, count(day) FILTER (WHERE day BETWEEN DATE '{TODAY}' - 29 AND DATE '{TODAY}') AS days_30 FROM k LEFT JOIN h USING (kind) GROUP BY k.kind""")
def usage_clicks(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumnRenamed("event_type", "kind")
    return U.window_counts(rows, "kind", spark.createDataFrame([(k,) for k in _KINDS], "kind string"), today())


@query(f"""WITH k AS (SELECT unnest(['view', 'click', 'purchase']) AS step, unnest([1, 2, 3]) AS place), h AS (SELECT event_type AS step, {_D}::DATE AS day FROM events),
c AS (SELECT k.step, place, count(day) FILTER (WHERE day = DATE '{TODAY}') AS days_1, count(day) FILTER (WHERE day BETWEEN DATE '{TODAY}' - 6 AND DATE '{TODAY}') AS days_7, count(day) FILTER (WHERE day BETWEEN DATE '{TODAY}' - 29 AND DATE '{TODAY}') AS days_30 FROM k LEFT JOIN h USING (step) GROUP BY ALL)
SELECT step, place::INT AS place, days_1, days_7, days_30, round(days_30::DOUBLE / nullif(lag(days_30) OVER (ORDER BY place), 0), 4) AS share FROM c""")
def usage_funnel(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumnRenamed("event_type", "step")
    return U.funnel(rows, spark.createDataFrame([("view", 1), ("click", 2), ("purchase", 3)], "step string, place int"), today())


@query("""WITH n AS (SELECT * FROM events WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10'), o AS (SELECT * FROM events WHERE user_id % 2 = 1)
SELECT event_type, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE ts < (SELECT min(ts) FROM n)) GROUP BY 1""")
def merged_search_logs(spark, sf_dir):
    h = hits(spark, sf_dir)
    return U.merged_logs(h.filter("visitor % 2 = 1"), h.filter("visitor % 2 = 0 and ts >= '2024-01-10'")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {OFF} SELECT store, product_id, price, price_normal FROM off WHERE price > 0 AND lower(category) LIKE '%promo%' AND price BETWEEN 1000 AND 60000 AND price < price_normal ORDER BY (price_normal - price) / price_normal DESC, store, product_id LIMIT 24 OFFSET 24")
def browse_page(spark, sf_dir):
    o = offers(spark, sf_dir).filter(fold(F.col("category")).contains("promo"))
    return C.browse(o, low=1000, high=60000, discounted=True, sort="discount", page=2, size=24).select(*KEY, "price", "price_normal")


@query(f"WITH {OFF} SELECT brand, count(*) AS products, round(avg(price))::BIGINT AS average, min(price) AS least, max(price) AS most, count(DISTINCT store) AS stores FROM off GROUP BY brand ORDER BY products DESC, brand LIMIT 10")
def catalog_analysis(spark, sf_dir):
    return C.analysis(offers(spark, sf_dir), "brand", 10)


@query(f"""WITH {OFF}, p AS (SELECT 'brand' AS facet, brand AS value FROM off UNION ALL SELECT 'category', category FROM off UNION ALL SELECT 'store', store FROM off), c AS (SELECT facet, value, count(*) AS c FROM p WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT facet, trim(lower(value)) AS key, sum(c)::BIGINT AS n, arg_min(value, (-c, value)) AS label FROM c GROUP BY ALL) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) <= 5""")
def browse_facets(spark, sf_dir):
    return C.facets(offers(spark, sf_dir), ["brand", "category", "store"], 5)


@query("SELECT event_type, user_id AS visitor, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_group(spark, sf_dir):
    return C.latest(hits(spark, sf_dir), ["event_type", "visitor"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "visitor", "event_id")


@query(f"WITH {OFF} SELECT store, category, product_id, row_number() OVER (PARTITION BY store, category ORDER BY price, product_id)::INT AS place FROM off QUALIFY place <= 3")
def store_quota(spark, sf_dir):
    return C.quota(offers(spark, sf_dir), ["store", "category"], [F.col("price"), F.col("product_id")], 3).select("store", "category", "product_id", "place")


@query("""SELECT p_partkey AS id, p_brand AS origin, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS turn, min(p_partkey) OVER (PARTITION BY p_brand) AS first_seen FROM part""")
def interleaved_origins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("origin"), F.col("p_partkey").alias("position"))
    return C.interleaved(p, "origin", [F.col("position")]).select("id", "origin", "turn", "first_seen")


@query("""WITH t AS (SELECT p_partkey, p_retailprice, p_brand, p_type, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('un','la','de','el','the','of','and'))) AS w FROM part), s AS (SELECT * FROM t WHERE p_partkey % 100 = 0),
x AS (SELECT s.p_partkey AS id, t.p_partkey AS product_id, round(t.p_retailprice)::BIGINT AS price, 3 * len(list_intersect(s.w, t.w)) + CASE WHEN s.p_brand = t.p_brand THEN 4 ELSE 0 END + CASE WHEN s.p_type = t.p_type THEN 5 ELSE 0 END AS score FROM s, t WHERE s.p_partkey <> t.p_partkey)
SELECT id, product_id, score::INT AS score, price, row_number() OVER (PARTITION BY id ORDER BY score DESC, price, product_id)::INT AS place FROM x WHERE score > 0 QUALIFY place <= 6""")
def related_products(spark, sf_dir):
    """Query parts: every id divisible by 100, against all parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.round("p_retailprice").cast("long").alias("price"))
    seed = p.filter("product_id % 100 = 0").select(F.col("product_id").alias("id"), F.array_distinct(tokens(F.col("name"))).alias("words"), "brand", F.col("category").alias("grp"))
    return C.related(seed, p, 6)


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 101)::INT END AS s, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-30' + to_hours((c_custkey % 24 - 10)::INT) END AS d FROM customer)
SELECT id, coalesce(s, 50) AS score, d IS NULL OR d <= TIMESTAMP '2024-01-30 06:00:00' AS due FROM p""")
def due_plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    pri = c.filter("id % 4 <> 0").select("id", (F.col("id") % 101).cast("int").alias("score"), F.expr("timestamp'2024-01-30 00:00:00' + make_dt_interval(0, cast(id % 24 - 10 as int))").alias("next_due_at"))
    return C.due_plan(c, pri, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("id", "score", "due")


@query(f"""WITH {OFF}, v AS (SELECT category, price FROM off WHERE price > 0), s AS (SELECT category, list_sort(list(price)) AS p FROM v GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT category, p, p[1] AS lo, p[-1] AS hi, len(p) AS n, p[len(p) // 2 + 1] AS med, unnest(p) AS c FROM s WHERE p[-1] / p[1] > 8),
i AS (SELECT *, list_filter(p, lambda x: x >= c / 2.5::DOUBLE AND x <= c * 2.5::DOUBLE) AS m FROM k), t AS (SELECT *, len(m) AS sz, round_even(list_sum(m) / len(m), 0)::BIGINT AS typical FROM i), u AS (SELECT *, sz >= greatest(3, (n + 2) // 4) AS ok FROM t), a AS (SELECT *, max(ok) OVER (PARTITION BY category) AS any_ok FROM u),
b AS (SELECT * FROM a WHERE ok OR NOT any_ok QUALIFY row_number() OVER (PARTITION BY category ORDER BY sz DESC, abs(typical - med), c) = 1)
SELECT category, greatest(1, floor(typical / 2.5::DOUBLE)::BIGINT) AS low, floor(typical * 2.5::DOUBLE)::BIGINT AS high, typical FROM b WHERE sz >= 3 AND NOT (lo >= greatest(1, floor(typical / 2.5::DOUBLE)::BIGINT) AND hi <= floor(typical * 2.5::DOUBLE)::BIGINT)""")
def price_bands(spark, sf_dir):
    return C.price_band(offers(spark, sf_dir), ["category"])


@query("""WITH o AS (SELECT n_regionkey AS id, list_sort(list(n_name)) AS names FROM nation WHERE n_nationkey < 15 GROUP BY 1), n AS (SELECT n_regionkey AS id, list_sort(list(n_name)) AS names FROM nation WHERE n_nationkey >= 8 GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.names, []), coalesce(n.names, [])))), ',') AS names, CASE WHEN o.id IS NOT NULL THEN 'old' ELSE 'new' END AS title, CASE WHEN n.id IS NOT NULL THEN 2 ELSE 1 END AS place FROM o FULL JOIN n ON o.id = n.id""")
def merged_category_sets(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.filter("n_nationkey < 15").groupBy(F.col("n_regionkey").alias("id")).agg(F.collect_list("n_name").alias("names")).withColumns({"title": F.lit("old"), "place": F.lit(1)})
    new = n.filter("n_nationkey >= 8").groupBy(F.col("n_regionkey").alias("id")).agg(F.collect_list("n_name").alias("names")).withColumns({"title": F.lit("new"), "place": F.lit(2)})
    return C.merged_sets(old, new, "id", "names", ["title"], ["place"]).withColumn("names", F.array_join("names", ","))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)")
def category_leaves(spark, sf_dir):
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return C.leaves(tree).select("id", "name")
