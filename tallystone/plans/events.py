"""Registered queries on lists of watched queries: the parts are their items, the lines their observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import events as E
from tallystone.operators import forecast as P
from tallystone.operators import series as S
from tallystone.registry import query

from .series import points
from .views import DAY, KEY, NOW, OBS, OFF, ORD, ORDER, SER, WIN, as_of, observations, offers, table

ITEM = ["product_id"]
#: Observations of an item, in all stores, in order.
IORDER = [*ORDER, "store"]
_IORD = f"{ORD}, store"
_STATS = "count(DISTINCT store) AS stores, min(price_normal) AS min_normal, max(price_normal) AS max_normal, max(price) AS max_offer, min(price) AS min_offer, arg_min(store, (price, store)) AS best_store"


@query(f"WITH {OFF} SELECT product_id, {_STATS} FROM off WHERE price > 0 GROUP BY 1")
def event_match_stats(spark, sf_dir):
    return E.match_stats(offers(spark, sf_dir), ITEM)


@query(f"WITH {OFF} SELECT product_id, {_STATS} FROM off WHERE price > 0 GROUP BY 1")
def event_stats_from_signatures(spark, sf_dir):
    """The same from maps of encoded prices."""
    return E.stats_from_signatures(E.signatures(offers(spark, sf_dir), ITEM), ITEM)


@query(f"""WITH {OFF}, o AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS k FROM obs WHERE ts < TIMESTAMP '1999-01-01'),
a AS (SELECT store || ':' || product_id AS key, product_id, price || ':' || price_normal || ':' AS s, price FROM o WHERE k = 1), b AS (SELECT store || ':' || product_id AS key, product_id, price || ':' || price_normal || ':' || coalesce(price_card::VARCHAR, '') AS s, price FROM off)
SELECT b.product_id, b.key, a.s AS before, b.s AS after, a.price AS previous_price, b.price FROM a JOIN b USING (key) WHERE a.s <> b.s""")
def event_signature_changes(spark, sf_dir):
    o = observations(spark, sf_dir).filter("ts < '1999-01-01'").withColumn("price_card", F.lit(None).cast("long"))
    old = o.groupBy(*KEY).agg(F.max_by(F.struct("price", "price_normal", "price_card"), F.struct(*ORDER)).alias("l")).select(*KEY, "l.*")
    return E.signature_changes(E.signatures(old, ITEM), E.signatures(offers(spark, sf_dir), ITEM), ITEM)


_DISC = "CASE WHEN price_normal > price THEN round((price_normal - price) * 100 / price_normal, 1) ELSE 0.0::DOUBLE END"


@query(f"""WITH {SER} SELECT product_id, arg_min(price, ({_IORD})) AS first, arg_max(price, ({_IORD})) AS current, count(*) AS points, min(price) AS low, max(price) AS high, max({_DISC}) AS best_discount, min({_DISC}) AS worst_discount, round(avg(price), 2) AS average,
  arg_max(price, ({_IORD})) - arg_min(price, ({_IORD})) AS change, arg_min(ts, (price, {_IORD}))::TIMESTAMP AS low_at, arg_min(store, (price, {_IORD})) AS low_store, arg_min(ts, (-price, {_IORD}))::TIMESTAMP AS high_at, arg_min(store, (-price, {_IORD})) AS high_store FROM ser GROUP BY 1""")
def event_evolution(spark, sf_dir):
    return E.evolution(points(spark, sf_dir), ITEM, IORDER)


_BEST = f"""bst AS (SELECT product_id, arg_max(price, ({_IORD})) AS price, arg_max(store, ({_IORD})) AS best_store FROM ser GROUP BY 1), prv AS (SELECT product_id, price AS previous_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {', '.join(c + ' DESC' for c in IORDER)}) AS k FROM ser) WHERE k = 2),
itm AS (SELECT product_id AS n, price, previous_price, best_store, CASE WHEN product_id % 3 = 0 THEN 'comprar' WHEN product_id % 3 = 1 THEN 'esperar' END AS advice FROM bst LEFT JOIN prv USING (product_id)), dlt AS (SELECT *, CASE WHEN price <> previous_price THEN price - previous_price END AS delta FROM itm)"""


@query(f"""WITH {SER}, {_BEST}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE price > 0) AS with_price, count(*) FILTER (WHERE delta < 0) AS down, count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta IS NULL) AS unchanged FROM dlt),
u AS (UNPIVOT (SELECT *, round_even(with_price * 100 / total, 0)::BIGINT AS coverage_percent FROM c) ON total, with_price, down, up, unchanged, coverage_percent INTO NAME key VALUE value)
SELECT 'counts' AS section, 0 AS place, key, value FROM u UNION ALL SELECT 'drops', row_number() OVER (ORDER BY delta, n)::INT, n::VARCHAR, delta FROM (SELECT * FROM dlt WHERE delta < 0 ORDER BY delta, n LIMIT 10) UNION ALL SELECT 'rises', row_number() OVER (ORDER BY delta DESC, n)::INT, n::VARCHAR, delta FROM (SELECT * FROM dlt WHERE delta > 0 ORDER BY delta DESC, n LIMIT 10)
UNION ALL SELECT 'stores', row_number() OVER (ORDER BY w DESC, best_store)::INT, best_store, w FROM (SELECT best_store, count(*) AS w FROM dlt WHERE price > 0 GROUP BY 1 ORDER BY w DESC, best_store LIMIT 8) UNION ALL SELECT 'advice', 0, advice, count(*) FROM dlt WHERE advice IS NOT NULL GROUP BY 3""")
def event_dashboard(spark, sf_dir):
    p = points(spark, sf_dir)
    w = S.ordered(ITEM, IORDER)
    last = p.withColumn("previous_price", F.lag("price").over(w)).groupBy(*ITEM).agg(F.max_by(F.struct("price", "previous_price", F.col("store").alias("best_store")), F.struct(*IORDER)).alias("l"))
    items = last.select(F.col("product_id").alias("n"), "l.*", F.when(F.col("product_id") % 3 == 0, "comprar").when(F.col("product_id") % 3 == 1, "esperar").alias("advice"))
    return E.dashboard(items)


@query(f"WITH {SER} SELECT store, year(ts)::INT AS y, count(DISTINCT {DAY})::INT AS distinct, greatest(1, least(200, 201 - count(DISTINCT {DAY})))::INT AS remaining FROM ser GROUP BY ALL")
def event_days_left(spark, sf_dir):
    return E.event_days(points(spark, sf_dir).withColumn("y", F.year("ts")), ["store", "y"], 200)


_PROJ = f"""ip AS (SELECT product_id, price::DOUBLE AS y, (row_number() OVER (PARTITION BY product_id ORDER BY {_IORD}) - 1)::DOUBLE AS x, ts FROM ser), ag AS (SELECT product_id, arg_max(y, x) AS l, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000 AS d, min(y)::BIGINT AS low FROM ip GROUP BY 1),
dl AS (SELECT *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0.0::DOUBLE) * greatest(n / greatest(d, 1::DOUBLE / 24), 1.0::DOUBLE) AS dd FROM ag), pj AS (SELECT product_id, l, low, step::INT AS step, greatest(1.0::DOUBLE, round(l + dd * step, 2)) AS price FROM dl, unnest(generate_series(1, 3)) t(step))"""


@query(f"WITH {SER}, {_PROJ} SELECT product_id, step, price FROM pj")
def event_daily_projection(spark, sf_dir):
    return E.projected(points(spark, sf_dir), ITEM, IORDER, 3)


@query(f"""WITH {SER}, {_PROJ}, e AS (SELECT product_id, any_value(l)::BIGINT AS current, any_value(low) AS low, avg(price) AS expected FROM pj GROUP BY 1)
SELECT product_id, current, low, round(expected, 2) AS expected, CASE WHEN (expected - current) * 100 / current <= -2 THEN 'esperar' WHEN current <= low OR (current - low) * 100 / low <= 3 THEN 'comprar' WHEN (expected - current) * 100 / current >= 2 THEN 'comprar' ELSE 'observar' END AS advice FROM e""")
def event_advice(spark, sf_dir):
    return E.event_advice(points(spark, sf_dir), ITEM, IORDER)


@query(f"WITH {SER} SELECT product_id, ts::DATE AS day, (l_linenumber % 3)::INT AS lap, arg_max(price, ({_IORD})) AS price FROM ser GROUP BY ALL")
def event_lap_samples(spark, sf_dir):
    return E.lap_samples(points(spark, sf_dir), ITEM, IORDER, F.col("l_linenumber") % 3)


@query(f"WITH {SER}, l AS (SELECT *, lag(price) OVER v AS previous_price, lag(store) OVER v AS ps FROM ser WINDOW v AS (PARTITION BY product_id ORDER BY {_IORD})) SELECT product_id, ts::TIMESTAMP AS ts, previous_price, price, store, l_orderkey, l_linenumber FROM l WHERE previous_price IS NOT NULL AND (price <> previous_price OR store <> ps)")
def event_best_price_changes(spark, sf_dir):
    return E.tracker_changes(points(spark, sf_dir), ITEM, IORDER).select(*ITEM, "ts", "previous_price", "price", "store", "l_orderkey", "l_linenumber")


@query(f"""WITH {OBS}, o AS (SELECT *, l_suppkey % 10 AS item, {DAY} AS day FROM obs), l AS (SELECT *, row_number() OVER v AS k, lag(price) OVER v AS p, lag(store) OVER v AS s, lag(price_normal) OVER v AS n FROM o WINDOW v AS (PARTITION BY item, day ORDER BY {_IORD}, product_id))
SELECT item, count(*) AS kept FROM l WHERE k = 1 OR price IS DISTINCT FROM p OR store IS DISTINCT FROM s OR price_normal IS DISTINCT FROM n GROUP BY 1""")
def event_observations_kept(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("item", F.col("l_suppkey") % 10)
    return E.appended(o, ["item"], [*IORDER, "product_id"]).groupBy("item").agg(F.count("*").alias("kept"))


@query(f"""WITH {OFF}, o AS (SELECT store, product_id, arg_max(price, ({ORD})) AS price, arg_max(price_normal, ({ORD})) AS price_normal FROM obs WHERE ts < TIMESTAMP '1999-01-01' GROUP BY ALL)
SELECT off.store, off.product_id, o.price AS previous_price, off.price, o.price_normal AS previous_normal, off.price_normal FROM off JOIN o USING (store, product_id) WHERE o.price <> off.price""")
def price_deltas(spark, sf_dir):
    old = observations(spark, sf_dir).filter("ts < '1999-01-01'").groupBy(*KEY).agg(F.max_by(F.struct("price", "price_normal"), F.struct(*ORDER)).alias("l")).select(*KEY, "l.*")
    return E.price_deltas(old, offers(spark, sf_dir), KEY)


@query(f"WITH {OFF} SELECT product_id, store, price, row_number() OVER (PARTITION BY product_id ORDER BY price, (price_normal - price) / price_normal DESC, store)::INT AS place FROM off WHERE price > 0 QUALIFY place <= 3")
def event_ranked_matches(spark, sf_dir):
    return E.ranked_matches(offers(spark, sf_dir), ITEM, 3).select(*ITEM, "store", "price", "place")


@query("""WITH i AS (SELECT p_brand AS list_id, p_partkey AS n, lower(p_type) AS q, p_size FROM part), d AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY list_id, q ORDER BY p_size DESC, n) = 1)
SELECT list_id, n, row_number() OVER (PARTITION BY list_id ORDER BY n)::INT AS place FROM d""")
def event_items_deduplicated(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("n"), "p_type", "p_size")
    return E.deduplicated(items, F.lower("p_type"), [F.col("p_size").desc(), F.col("n")]).select("list_id", "n", "place")


@query("SELECT p_brand AS list_id, p_partkey AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey < 77, p_partkey)::INT AS turn FROM part")
def event_items_rotated(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("n"))
    return E.rotated(items, "list_id", "n", F.lit(77))


@query("""WITH r AS (SELECT n_name AS slug, coalesce(lead(n_name) OVER (ORDER BY n_name), first_value(n_name) OVER (ORDER BY n_name)) AS next FROM nation WHERE n_nationkey % 3 = 0) SELECT n_name AS slug, n_nationkey % 3 = 0 AS running, next FROM nation LEFT JOIN r ON slug = n_name""")
def event_next_lists(spark, sf_dir):
    return E.following(table(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), (F.col("n_nationkey") % 3 == 0).alias("running")), "slug")


@query("""WITH s AS (SELECT n_name AS store, n_nationkey % 4 = 0 AS preferred, n_nationkey % 11 = 5 AS optional, n_nationkey AS position FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY optional ORDER BY preferred DESC, position) AS k, greatest(0, 10 - count(*) FILTER (WHERE optional) OVER ()) AS room FROM s)
SELECT store, row_number() OVER (ORDER BY optional, k)::INT AS turn FROM k WHERE optional OR k <= room QUALIFY turn <= 10""")
def prioritized_stores(spark, sf_dir):
    k = F.col("n_nationkey")
    stores = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store"), (k % 4 == 0).alias("preferred"), (k % 11 == 5).alias("optional"), k.alias("position"))
    return E.prioritized(stores, 10).select("store", "turn")


@query(f"""WITH {OFF}, x AS (SELECT *, CASE store WHEN 's3' THEN 1 WHEN 's0' THEN 2 END AS f FROM off WHERE store <> 's2')
SELECT product_id, store, row_number() OVER (PARTITION BY product_id ORDER BY f NULLS LAST, price, store)::INT AS turn, min(price) OVER (PARTITION BY product_id) AS lowest, (SELECT count(DISTINCT z.family) FROM x z WHERE z.product_id = x.product_id) >= 2 AS comparable FROM x""")
def personalized_groups(spark, sf_dir):
    favorites = spark.createDataFrame([("s3", 1), ("s0", 2)], "store string, rank int")
    return E.personalized(offers(spark, sf_dir), "product_id", favorites, spark.createDataFrame([("s2",)], "store string")).select("product_id", "store", "turn", "lowest", "comparable")


# --- forecasts ---------------------------------------------------------------


_FORE = f"""fo AS (SELECT store, product_id, list(price::DOUBLE ORDER BY {ORD}) AS p, count(*) AS n FROM ser GROUP BY ALL HAVING count(*) >= 5), fp AS (SELECT *, p[n] AS current, p[1:3] AS points, list_transform(p[1:3], lambda x: x * 1.05) AS upper FROM fo)"""


def _projected(spark, sf_dir):
    p = points(spark, sf_dir).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("o")).filter(F.size("o") >= 5)
    price = F.transform("o", lambda x: x["price"].cast("double"))
    x = p.select(*KEY, price.alias("p")).withColumn("n", F.size("p"))
    first = F.slice("p", 1, 3)
    return x.select(*KEY, "n", F.element_at("p", -1).alias("current"), first.alias("points"), F.create_map(F.lit("0.1"), F.transform(first, lambda v: v * 0.95), F.lit("0.8"), first, F.lit("0.9"), F.transform(first, lambda v: v * 1.05)).alias("quantiles"))


@query(f"""WITH {SER}, {_FORE}, m AS (SELECT *, list_sum(points) / 3 AS mean, list_min(list_transform(points, lambda x: x * 0.95)) AS low, list_max(upper) AS high FROM fp)
SELECT store, product_id, round(mean, 2) AS mean, CASE WHEN mean <= current * 0.98 THEN 'down' WHEN mean >= current * 1.02 THEN 'up' ELSE 'stable' END AS trend, CASE WHEN n >= 8 THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence, mean <= current * 0.98 AND len(list_filter(upper, lambda x: x < current)) / 3 >= 0.6 AS supported,
  CASE WHEN current < low THEN 'exceptional' WHEN current > high THEN 'above_expected' ELSE 'within_expected' END AS status, round((current - mean) * 100 / mean, 1) + 0.0::DOUBLE AS difference_percent FROM m""")
def forecast_signals(spark, sf_dir):
    """The first three prices of a product as the forecast of its last one."""
    f = _projected(spark, sf_dir).withColumn("upper", P.upper_quantile(F.col("quantiles")))
    s = P.summary(F.col("points"), F.col("current"), F.col("n"), high=8, medium=6)
    signal = P.price_signal(F.col("points"), F.col("quantiles"), F.col("current"))
    return f.select(*KEY, s["mean"].alias("mean"), s["trend"].alias("trend"), s["confidence"].alias("confidence"), P.supported_drop(F.col("points"), F.col("upper"), F.col("current")).alias("supported"), signal["status"].alias("status"), signal["difference_percent"].alias("difference_percent"))


@query(f"""WITH {SER}, {_FORE}, e AS (SELECT *, CASE WHEN points[1] BETWEEN current * 0.9 AND current * 1.1 OR points[1] <= current * 0.5 * 0.98 THEN 1 WHEN points[2] BETWEEN current * 0.9 AND current * 1.1 OR points[2] <= current * 0.5 * 0.98 THEN 2 ELSE 3 END AS eta FROM fp)
SELECT store, product_id, eta::INT AS eta, current AS repeated FROM e""")
def forecast_etas(spark, sf_dir):
    f = _projected(spark, sf_dir)
    eta = P.eta_days(F.col("points"), F.lit("down"), F.col("current") * 0.9, F.col("current") * 1.1, F.col("current") * 0.5, 3)
    return f.select(*KEY, eta.alias("eta"), P.repeated(F.col("points"), F.col("current"), 3)[2].alias("repeated"))


@query(f"""WITH {OFF}, h AS (SELECT store, product_id, count(*) AS n, count(DISTINCT {DAY}) AS days, max({DAY}) - min({DAY}) + 1 AS span FROM obs WHERE price > 0 GROUP BY ALL)
SELECT store, product_id, CASE WHEN product_id % 13 = 0 THEN 'identity' WHEN stock <= 0 THEN 'stock' WHEN days < 6 THEN 'days' WHEN span < 1500 THEN 'span' ELSE 'ready' END AS gate FROM off JOIN h USING (store, product_id)""")
def forecast_gates(spark, sf_dir):
    o = offers(spark, sf_dir).withColumn("compare_code", F.when(F.col("product_id") % 13 != 0, F.col("brand")))
    return P.prepared(o, observations(spark, sf_dir), KEY, least_days=6, least_span=1500).select(*KEY, "gate")


@query("""WITH u AS (SELECT c_custkey AS id, 1 AS priority FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 3 FROM customer), k AS (SELECT id, min(priority)::INT AS priority FROM u GROUP BY 1) SELECT * FROM k ORDER BY priority, id LIMIT 60""")
def forecast_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return P.by_priority([c.filter("id % 7 = 0"), c.filter("id % 5 = 0"), c], ["id"], 60)


@query("SELECT o_orderpriority AS model, count(*) AS series, count(*) >= 30 AND round(avg(o_totalprice) / 1000, 4) >= 5 AND true AS passes FROM orders GROUP BY 1")
def forecast_gate(spark, sf_dir):
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("series"), F.round(F.avg("o_totalprice") / 1000, 4).alias("i"))
    return x.select("model", "series", P.gate(F.col("series"), F.col("i"), F.lit(0.6)).alias("passes"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0")
def forecast_unseen(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return P.unseen(c, c.filter("id % 4 = 0"), ["id", "c_mktsegment"]).select("id")


@query(f"""WITH {OFF}, f AS (SELECT store, product_id, 'm' || (l_suppkey % 3) AS model, ts, l_orderkey, (price * 1.1)::DOUBLE AS e FROM obs WHERE product_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY CASE model WHEN 'm0' THEN 1 WHEN 'm1' THEN 2 ELSE 3 END, ts DESC, l_orderkey DESC, e DESC) AS k FROM f)
SELECT off.store, off.product_id, model, round(e, 2) AS expected FROM off LEFT JOIN r ON r.store = off.store AND r.product_id = off.product_id AND k = 1""")
def offers_with_forecasts(spark, sf_dir):
    """The forecast of each offer by preference of model, then the newest."""
    o = observations(spark, sf_dir).filter("product_id % 2 = 0")
    f = o.select(*KEY, F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), "ts", "l_orderkey", F.round(F.col("price") * 1.1, 2).alias("expected"))
    return P.attached(offers(spark, sf_dir).select(*KEY), f, KEY, ["m0", "m1"], [F.col("ts").desc(), F.col("l_orderkey").desc(), F.col("expected").desc()]).select(*KEY, "model", "expected")


@query(f"WITH {SER} SELECT product_id, string_agg(price_normal::VARCHAR, ',' ORDER BY {_IORD}) AS normals, string_agg(price::VARCHAR, ',' ORDER BY {_IORD}) AS both FROM ser WHERE price_normal > 0 GROUP BY 1")
def normal_price_series(spark, sf_dir):
    """List prices in order, and the histories of all stores of a product merged."""
    p = points(spark, sf_dir).filter("price_normal > 0")
    half = p.filter("l_linenumber % 2 = 0").unionByName(p.filter("l_linenumber % 2 <> 0"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*IORDER, "price_normal"))), lambda x: x[c].cast("string")), ",")
    return half.groupBy("product_id").agg(ordered("price_normal").alias("normals"), ordered("price").alias("both"))
