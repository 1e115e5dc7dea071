"""Registered queries on neighbours in a span of time, measures, quality of outcomes, people's searches, store groups and personal offers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystone.functions import keys as Y
from tallystone.operators import forecast as P
from tallystone.operators import products as R
from tallystone.operators import records, reports, usage
from tallystone.operators import search as V
from tallystone.operators import selection as X
from tallystone.operators import rules
from tallystone.operators import stats as T
from tallystone.registry import ORACLES, query

from .decisions import _PREV, _offers_with_stats
from .stats import buy_or_wait  # noqa: F401  (its SQL is a part of another)
from .views import KEY, OFF, ORDER, as_of, marked_observations, offers, table

_ASKED = "q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)"


def _embedded(spark, sf_dir):
    """Stored queries with the day on which they were asked."""
    return table(spark, sf_dir, "embeddings").withColumn("day", (F.col("vec_id") % 30).cast("int"))


@query(f"""WITH {_ASKED}, s AS (SELECT query_id, vec_id, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id % 30 BETWEEN 10 AND 24)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS place FROM s QUALIFY place <= 5""")
def similar_queries(spark, sf_dir):
    """Of every vec_id divisible by 100, the five nearest of all vectors of a span of days, exactly."""
    v = _embedded(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.top_k(v.filter("day between 10 and 24").drop("day"), asked, 5)


@query()
def similar_queries_indexed(spark, sf_dir):
    """The same by the coarse index; a test measures its recall against the exact query. These vectors lie in no clusters, so many lists are looked into."""
    v = _embedded(spark, sf_dir)
    index = V.VectorIndex(v.select("vec_id", "embedding", "day"), lists=64)
    return index.search(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, probes=56, within=F.col("day").between(10, 24))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'litro' WHEN 1 THEN 'litro' WHEN 2 THEN 'kg' WHEN 5 THEN NULL ELSE 'metro' END AS measure, CASE p_partkey % 6 WHEN 0 THEN p_size * 0.25 WHEN 1 THEN p_size * 0.001 WHEN 2 THEN p_size * 0.5 WHEN 3 THEN p_size * 0.01 WHEN 4 THEN p_size * 1.5 END::DOUBLE AS amount,
  CASE p_partkey % 6 WHEN 0 THEN round(round(p_retailprice * 100)::BIGINT / round(p_size * 0.25, 6)) WHEN 2 THEN round(round(p_retailprice * 100)::BIGINT / round(p_size * 0.5, 6)) WHEN 3 THEN round(round(p_retailprice * 100)::BIGINT / round(p_size * 0.01, 6)) WHEN 4 THEN round(round(p_retailprice * 100)::BIGINT / round(p_size * 1.5, 6)) WHEN 1 THEN round(round(p_retailprice * 100)::BIGINT / round(p_size * 0.001, 6)) END::BIGINT AS unit_price FROM part""")
def measured_unit_prices(spark, sf_dir):
    """Measures told in names or specs of the parts, volumes before masses before lengths, and the price of one unit of them."""
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    number = lambda by: F.replace((n * by).cast("decimal(12,3)").cast("string"), F.lit("."), F.lit(","))
    name = F.concat_ws(" ", "p_name", F.when(k == 0, F.concat(number(0.25), F.lit(" Lts. x 20 cm"))).when(k == 1, F.concat(n.cast("string"), F.lit("cc"))).when(k == 2, F.concat(F.lit("bolsa "), number(0.5), F.lit(" kg de 3 m"))).when(k == 3, F.concat(n.cast("string"), F.lit("cm"))))
    specs = F.when(k == 4, F.create_map(F.lit("Largo"), F.concat(number(1.5), F.lit(" metros")))).otherwise(F.create_map(F.lit("color"), F.lit("rojo")))
    m = Y.catalog_measure(name, F.col("p_brand"), specs)
    x = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    u = Y.unit_price(F.col("m.measure"), F.col("price"), F.col("m.measure"), F.col("m.amount"))
    return x.select("p_partkey", F.col("m.measure").alias("measure"), F.col("m.amount").alias("amount"), u["price"].alias("unit_price"))


@query("""SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND NOT (event_type = 'click' AND event_id % 3 = 0)""")
def quality_outcomes(spark, sf_dir):
    """Outcomes made from the events: clicks are hits, views are misses."""
    e = F.col("event_id")
    o = table(spark, sf_dir, "events").select(e, F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "view", "miss").otherwise("pending").alias("status"), F.when(e % 5 == 0, "Naive").otherwise("M1").alias("model"), F.when(e % 7 == 0, True).alias("fallback"), F.when((F.col("event_type") == "click") & (e % 3 == 0), "stable").alias("hit_reason"))
    return P.counts_for_quality(o, ["naive"]).select("event_id")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND turn % 4 <> 3 AND regexp_matches(coalesce(text, ''), '[^ ]') AND conv_id % 6 <> 1")
def people_searches(spark, sf_dir):
    """Turns of conversations as searches; some come from a batch."""
    c = table(spark, sf_dir, "conversations")
    s = c.select("conv_id", "turn", F.col("text").alias("query"), (F.col("role") == "system").alias("background"), F.when(F.col("turn") % 4 == 3, "run-1").alias("batch_run_id"), F.when(F.col("conv_id") % 6 == 1, F.lit(1)).otherwise(0).alias("batch"))
    return usage.people_searches(s.withColumn("batch", F.nullif("batch", F.lit(0))), ["batch_run_id", "batch"]).select("conv_id", "turn")


@query(f"""WITH {OFF} SELECT DISTINCT product_id, CASE WHEN product_id % 4 = 0 THEN 'brand' WHEN product_id % 3 = 0 THEN 'tech,home' WHEN product_id % 5 <> 0 THEN 'retail' ELSE '' END AS groups FROM off""")
def product_store_groups(spark, sf_dir):
    """Groups of products by their own fields, by what their words resolve to, or by a store of theirs."""
    o = offers(spark, sf_dir).groupBy("product_id").agg(F.min("store").alias("store"))
    k = F.col("product_id")
    p = o.select("product_id", F.when(k % 5 != 0, " S ").otherwise("unlisted").alias("store"), F.when(k % 4 == 0, F.array(F.lit("Brand "), F.lit("other"), F.lit("brand"))).alias("groups"), F.when(k % 4 == 1, "nothing").alias("category"))
    resolved = o.filter("product_id % 3 = 0").select("product_id", F.array(F.lit("tech"), F.lit("x"), F.lit("home")).alias("groups"))
    stores = spark.createDataFrame([("s", "retail")], "store string, grp string")
    out = records.groups_of_product(p, ["groups", "category"], ["brand", "tech", "home", "retail"], resolved, stores)
    return out.select("product_id", F.array_join("groups", ",").alias("groups"))


@query("SELECT DISTINCT o_custkey AS search_id, n_name AS store FROM orders, nation WHERE n_name NOT IN (SELECT n_name FROM nation x JOIN orders y ON n_nationkey = y.o_orderkey % 25 WHERE y.o_custkey = orders.o_custkey)")
def remaining_stores(spark, sf_dir):
    """Nations as stores that a customer's orders did not ask."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # the store dimension
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.lower("n_name")).alias("store"), "n_nationkey")
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search_id"), (F.col("o_orderkey") % 25).cast("int").alias("n_nationkey")).join(n, "n_nationkey").select("search_id", "store")
    left = records.remaining([x.lower() for x in names], chosen)
    return left.select("search_id", F.upper("store").alias("store"))


@query(f"""WITH {OFF}, g AS (SELECT product_id, min(price) AS lowest_price, count(*) >= 4 AS comparable FROM off GROUP BY 1), x AS (SELECT off.store, product_id, CASE WHEN product_id % 7 = 0 THEN NULL WHEN product_id % 11 = 0 THEN 0 ELSE price END AS price, lowest_price, comparable FROM off JOIN g USING (product_id))
SELECT store, product_id, price, lowest_price, comparable, row_number() OVER (ORDER BY NOT comparable, price IS NULL, coalesce(nullif(price, 0), 1000000000000), store, product_id) AS place FROM x""")
def flattened_offers(spark, sf_dir):
    o = offers(spark, sf_dir)
    groups = o.groupBy("product_id").agg(F.min("price").alias("lowest_price"), (F.count("*") >= 4).alias("comparable")).withColumn("kind", F.lit("same"))
    k = F.col("product_id")
    shown = o.select(*KEY, F.when(k % 7 == 0, F.lit(None).cast("long")).when(k % 11 == 0, F.lit(0).cast("long")).otherwise(F.col("price")).alias("price"))
    return R.flattened(groups, shown, ["product_id"]).select(*KEY, "price", "lowest_price", "comparable", "place")


@query("""WITH e AS (SELECT event_id, 'L' || (user_id % 7) AS list_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts FROM events WHERE user_id % 9 <> 0) SELECT event_id, list_id, row_number() OVER (PARTITION BY list_id ORDER BY ts NULLS FIRST, event_id)::INT AS place FROM e""")
def event_points_by_list(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    x = table(spark, sf_dir, "events").select("event_id", F.when(u % 9 == 0, " ").otherwise(F.concat(F.lit(" L"), (u % 7).cast("string"))).alias("list_id"), F.when(e % 13 != 0, F.col("ts")).alias("ts"))
    return records.points_of_lists(x, ["event_id"]).select("event_id", "list_id", "place")


@query(f"""WITH {OFF}, fl AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs), ser AS (SELECT * FROM fl WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment')), {_PREV},
o AS (SELECT cur.*, previous_price, family, shipping_cost, price_normal FROM cur LEFT JOIN prev USING (store, product_id) JOIN (SELECT store, product_id, family, shipping_cost, price_normal FROM off) USING (store, product_id)),
b AS (SELECT product_id, family, min(price + shipping_cost) AS v, arg_min(store, (price + shipping_cost, store)) AS store FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY v, store) AS n FROM b)
SELECT store, product_id, 'price_drop_percent+price_drop_amount' AS rule, (previous_price - price)::DOUBLE AS saving FROM o WHERE price < previous_price UNION ALL SELECT store, product_id, 'below_median', (median - price)::DOUBLE FROM o WHERE points >= 3 AND round((price - median) * 100 / median, 1) <= 0
UNION ALL SELECT a.store, a.product_id, 'cross_store_gap', (z.v - a.v)::DOUBLE FROM r a JOIN r z ON a.product_id = z.product_id AND a.n = 1 AND z.n = 2 UNION ALL SELECT store, product_id, 'common_discount', (price_normal - price)::DOUBLE FROM o WHERE price_normal > price""")
def notification_offers(spark, sf_dir):
    """Every alert without thresholds."""
    return reports.notification_offers(_offers_with_stats(spark, sf_dir), KEY, ["product_id"]).withColumn("saving", F.col("saving").cast("double"))


@query(f"""WITH {OFF} SELECT store, product_id, NOT (product_id % 3 = 0 AND product_id % 4 <> 0 AND product_id % 2 = 0) AND NOT (product_id % 5 = 0 AND size % 3 <> 0) AS fits FROM off""")
def personal_offers(spark, sf_dir):
    """Offers for the cards and sizes of a person."""
    k = F.col("product_id")
    prefs = F.struct(F.array(F.lit("Visa "), F.lit("CMR")).alias("payment_cards"), F.array(F.lit("xl"), F.lit("36")).alias("preferred_sizes"))
    basis = F.when(k % 3 == 0, "card").otherwise("all_payment")
    card = F.when(k % 4 == 0, "visa").when(k % 2 == 0, "Other").otherwise("")
    sizes = F.when(F.col("size") % 3 == 0, F.array(F.lit(" XL"), F.lit("XS"))).otherwise(F.array(F.lit("XS")))
    return offers(spark, sf_dir).select(*KEY, X.fits_person(basis, card, k % 5 == 0, sizes, prefs).alias("fits"))


@query(f"""WITH b AS ({ORACLES['buy_or_wait']}), {OFF}, r AS (SELECT a.store, a.product_id, max(a.price - b.price) AS cheaper FROM off a JOIN off b ON a.product_id = b.product_id AND a.family <> b.family GROUP BY ALL)
SELECT b.store, b.product_id, CASE WHEN advice = 'buy' AND cheaper > 0 THEN 'wait' ELSE advice END AS advice FROM b LEFT JOIN r ON r.store = b.store AND r.product_id = b.product_id""")
def advice_with_rivals(spark, sf_dir):
    """Advice to buy, unless a store of another family sells for less."""
    last = T.timing(marked_observations(spark, sf_dir), KEY, ORDER, as_of(), F.col("_kept")).select(*KEY, "family", "price", "n", "advice")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.lit(True).alias("_offer"))
    # a family's lowest offer, and of each product the lowest family and the lowest of the others
    x = last.join(part, "product_id", "left").withColumn("_low", F.min(F.when(F.col("_offer"), F.col("price"))).over(Window.partitionBy("product_id", "family")))
    g = Window.partitionBy("product_id")
    x = x.withColumn("_one", F.min(F.when(F.col("_low").isNotNull(), F.struct("_low", "family"))).over(g))
    x = x.withColumn("_two", F.min(F.when(F.col("family") != F.col("_one.family"), F.col("_low"))).over(g))
    rival = F.when(F.col("family") != F.col("_one.family"), F.col("_one._low")).otherwise(F.col("_two"))
    return x.filter("n > 0").select(*KEY, T.blocked_by_cheaper(F.col("advice"), F.when(F.col("_offer"), F.col("price") - rival)).alias("advice"))


@query(f"""WITH {OFF}, l AS (SELECT *, CASE WHEN product_id % 4 <> 0 THEN ts - to_days((product_id % 9)::INT) END AS sent, price + product_id % 3 - 1 AS was FROM off) SELECT store, product_id FROM l WHERE sent IS NULL OR ts >= sent + INTERVAL 5 DAY OR price < was""")
def due_sends(spark, sf_dir):
    """Offers worth a message now: never sent, sent days ago, or cheaper than what was sent."""
    k = F.col("product_id")
    sent = F.when(k % 4 != 0, F.col("ts") - F.make_dt_interval(days=(k % 9).cast("int")))
    return offers(spark, sf_dir).filter(rules.should_send(sent, F.col("price") + k % 3 - 1, F.col("price"), F.col("ts"))).select(*KEY)
