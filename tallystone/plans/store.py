"""Registered queries on the stored catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import store as K
from tallystone.registry import query
from tallystone.sources.storage import stored

from .series import points
from .views import KEY, NOW, OBS, OFF, ORD, ORDER, SER, as_of, last_observations, observations, offers, table

_DESC = ", ".join(c + " DESC" for c in ORDER)


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.round("p_retailprice").cast("long").alias("price"), F.col("p_size").alias("size"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 200")
def scan_page(spark, sf_dir):
    return K.scan_after(table(spark, sf_dir, "customer"), "c_custkey", 20, 200, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100 LIMIT 1")
def id_at_offset(spark, sf_dir):
    return K.at_offset(table(spark, sf_dir, "customer"), "c_custkey", 100)


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('un', 'la', 'de', 'el', 'the', 'of', 'and')))"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, CASE p_partkey // 100 % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_name) WHEN 2 THEN p_partkey::VARCHAR ELSE lower(substr(p_name, 2, 2)) || ' ' || lower(substr(p_name, 4, 2)) END AS q FROM part WHERE p_partkey % 100 = 0),
qw AS (SELECT *, {_WORDS.format('q')} AS w FROM q), p AS (SELECT p_partkey AS product_id, p_size AS updated, lower(p_type) AS l, lower(p_name) AS name, {_WORDS.format('p_name')} AS h FROM part),
t2 AS (SELECT query_id, product_id, updated, len(list_intersect(w, h)) AS n FROM qw, p WHERE len(list_intersect(w, h)) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, product_id) <= 60),
f AS (SELECT query_id, product_id, updated, 1 AS tier FROM qw JOIN p ON q = l UNION ALL SELECT query_id, product_id, updated, 2 FROM t2 UNION ALL SELECT query_id, product_id, updated, 3 FROM qw JOIN p ON q = product_id::VARCHAR),
r AS (SELECT * FROM f UNION ALL SELECT query_id, product_id, updated, 4 FROM qw, p WHERE query_id NOT IN (SELECT query_id FROM f) AND len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(name, x))) = 0),
o AS (SELECT query_id, product_id, updated, min(tier) AS tier FROM r GROUP BY ALL)
SELECT query_id, product_id, tier FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY updated DESC, product_id) <= 60""")
def find_by_query(spark, sf_dir):
    """Queries made from every part whose id is divisible by 100, against all parts."""
    p = _parts(spark, sf_dir)
    k, name = F.col("product_id"), F.lower("name")
    text = F.when(F.floor(k / 100) % 4 == 0, F.lower("category")).when(F.floor(k / 100) % 4 == 1, name).when(F.floor(k / 100) % 4 == 2, k.cast("string")).otherwise(F.concat_ws(" ", F.substring(name, 2, 2), F.substring(name, 4, 2)))
    queries = p.filter("product_id % 100 = 0").select(k.alias("query_id"), text.alias("text"))
    return K.find_by_query(queries, p.select("product_id", "name", F.col("category").alias("last_query"), F.col("size").alias("updated")))


@query("""WITH p AS (SELECT p_partkey AS product_id, (p_partkey * 7919 + 10000000000)::VARCHAR AS d FROM part), f AS (SELECT product_id, CASE product_id % 3 WHEN 0 THEN d WHEN 1 THEN lpad(d, 14, '0') ELSE '00' || d || '-' END AS sku FROM p),
w AS (SELECT '000' || (p_partkey * 7919 + 10000000000)::VARCHAR AS code FROM part WHERE p_partkey % 100 = 0)
SELECT DISTINCT code, product_id FROM w JOIN f ON ltrim(code, '0') = ltrim(regexp_replace(sku, '[^0-9]', '', 'g'), '0') UNION SELECT code, product_id FROM w JOIN f ON ltrim(code, '0') = product_id::VARCHAR""")
def find_by_code(spark, sf_dir):
    """Codes of every part whose id is divisible by 100, against the ids and codes of all parts in three spellings."""
    k = F.col("product_id")
    digits = (k * 7919 + 10000000000).cast("string")
    p = _parts(spark, sf_dir).withColumn("sku", F.when(k % 3 == 0, digits).when(k % 3 == 1, F.lpad(digits, 14, "0")).otherwise(F.concat(F.lit("00"), digits, F.lit("-"))))
    wanted = p.filter("product_id % 100 = 0").select(F.concat(F.lit("000"), digits).alias("code"))
    return K.find_by_code(wanted, p, [F.col("sku"), k])


@query(f"WITH {OFF} SELECT store, product_id, name, price, price_normal, stock FROM off WHERE store = 's1' AND product_id = 42")
def product_detail(spark, sf_dir):
    return offers(spark, sf_dir).filter((F.col("store") == "s1") & (F.col("product_id") == 42)).select(*KEY, "name", "price", "price_normal", "stock")


@query(f"WITH {OFF} SELECT brand AS code, store, product_id, price, row_number() OVER (PARTITION BY brand ORDER BY price, store, product_id)::INT AS place FROM off QUALIFY place <= 30")
def by_compare_code(spark, sf_dir):
    return K.quota(offers(spark, sf_dir), ["brand"], [F.col("price"), F.col("store"), F.col("product_id")], 30).select(F.col("brand").alias("code"), *KEY, "price", "place")


@query(f"WITH {SER}, r AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY {_DESC}) AS n FROM ser WHERE product_id % 100 = 0) SELECT store, product_id, string_agg(price::VARCHAR, ',' ORDER BY n DESC) AS prices FROM r WHERE n <= 5 GROUP BY ALL")
def price_histories(spark, sf_dir):
    """The last five points of every product whose id is divisible by 100."""
    p = points(spark, sf_dir)
    out = K.histories(p, p.filter("product_id % 100 = 0"), KEY, ORDER, 5)
    return out.select(*KEY, F.array_join(F.transform("points", lambda x: x["price"].cast("string")), ",").alias("prices"))


@query(f"""WITH {OFF}, old AS (SELECT * FROM obs WHERE ts < TIMESTAMP '1996-06-01'), l AS (SELECT store, product_id, arg_max(price, ({ORD})) AS price, arg_max(price_normal, ({ORD})) AS price_normal FROM old GROUP BY ALL)
SELECT store, product_id, CASE WHEN l.store IS NOT NULL THEN l.price ELSE off.price END AS price, CASE WHEN l.store IS NOT NULL THEN l.price_normal ELSE off.price_normal END AS price_normal, l.store IS NOT NULL AS recorded FROM off LEFT JOIN l USING (store, product_id)""")
def last_points(spark, sf_dir):
    """The last points of an early part of the history; products without any have their own price."""
    return K.last_points(offers(spark, sf_dir), observations(spark, sf_dir).filter("ts < '1996-06-01'"), KEY, ORDER)


@query(f"WITH {SER} SELECT store, product_id, count(*) AS n FROM ser GROUP BY ALL HAVING count(*) >= 8")
def products_with_history(spark, sf_dir):
    return K.with_points(points(spark, sf_dir), KEY, 8)


@query("SELECT n_nationkey AS id, n_regionkey AS parent_id, n_name AS name FROM nation WHERE n_regionkey = 1 AND contains(lower(n_name), 'a') ORDER BY name, id LIMIT 3")
def list_categories(spark, sf_dir):
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return K.categories(tree, text="a", parent=1, limit=3)


@query("""SELECT n_name AS store, CASE WHEN r_regionkey IS NOT NULL THEN n_regionkey::VARCHAR ELSE 'otros' END AS grp, coalesce(r_name, 'Otros') AS title, coalesce(r_regionkey, 999)::INT AS place FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def store_groups(spark, sf_dir):
    stores = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store"), F.col("n_regionkey").cast("string").alias("grp"))
    groups = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("grp"), F.col("r_name").alias("title"), F.col("r_regionkey").alias("place"))
    return K.grouped_stores(stores, groups)


@query("SELECT 's' || n_nationkey AS id, n_name AS title FROM nation ORDER BY id")
def list_stores(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title")).orderBy("id")


@query(f"WITH {OFF} SELECT 's' || n_nationkey AS store, count(off.store) AS n FROM nation LEFT JOIN off ON off.store = 's' || n_nationkey GROUP BY 1")
def store_catalog_counts(spark, sf_dir):
    stores = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("store"))
    return K.counts_for(stores, offers(spark, sf_dir), "store")


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS kept, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return K.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT 'products' AS name, count(*) AS n FROM part UNION ALL SELECT 'searches', count(*) FROM orders UNION ALL SELECT 'alerts', count(*) FROM events UNION ALL SELECT 'users', count(*) FROM customer")
def stats_overview(spark, sf_dir):
    return K.table_sizes({name: table(spark, sf_dir, t) for name, t in (("products", "part"), ("searches", "orders"), ("alerts", "events"), ("users", "customer"))})


@query("SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_type LIKE 'PROMO%'")
def filtered_count(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size >= 10 and p_type like 'PROMO%'").agg(F.count("*").alias("n"))


_ALERTS = """al AS (SELECT event_id AS id, event_type AS category, 's' || (user_id % 5) AS store, user_id, ts, ts::DATE AS day, CASE event_id % 4 WHEN 0 THEN 'price_drop_percent' WHEN 1 THEN 'price_drop_percent+price_drop_amount' WHEN 2 THEN 'below_median' ELSE 'watch_target' END AS rule, round(coalesce(value, 0) * 100)::BIGINT AS saving FROM events)"""


def alerts(spark, sf_dir):
    """Each event as an alert."""
    k = F.col("event_id") % 4
    rule = F.when(k == 0, "price_drop_percent").when(k == 1, "price_drop_percent+price_drop_amount").when(k == 2, "below_median").otherwise("watch_target")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("store"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), rule.alias("rule"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("saving"))


@query(f"WITH {_ALERTS} SELECT DISTINCT 'category' AS facet, category AS value FROM al UNION SELECT 'store', store FROM al UNION SELECT 'rule', unnest(string_split(rule, '+')) FROM al")
def deal_facets(spark, sf_dir):
    return K.facet_values(alerts(spark, sf_dir), ["category", "store"], "rule")


@query(f"WITH {_ALERTS} SELECT DISTINCT day FROM al ORDER BY day DESC LIMIT 12")
def deal_days(spark, sf_dir):
    return K.distinct_days(alerts(spark, sf_dir), "day", 12)


@query(f"WITH {OFF} SELECT DISTINCT ts::DATE AS day FROM off WHERE price < price_normal ORDER BY day DESC LIMIT 30")
def real_offer_days(spark, sf_dir):
    return K.distinct_days(offers(spark, sf_dir).filter("price < price_normal").withColumn("day", F.to_date("ts")), "day", 30)


@query("SELECT o_orderkey, o_custkey, o_orderdate::TIMESTAMP AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def recent_searches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return K.newest(o, [F.col("at").desc(), F.col("o_orderkey").desc()], 12)


@query("SELECT event_id, json_extract_string(props, '$.k') AS extra, ts::TIMESTAMP AS ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("extra"), F.col("ts").cast("timestamp").alias("ts"))
    return K.newest(e, [F.col("ts").desc(), F.col("event_id").desc()], 30)


@query("SELECT o_orderpriority AS run, max(o_orderdate)::TIMESTAMP AS last, count(*) AS n FROM orders GROUP BY 1 ORDER BY last DESC, run LIMIT 10")
def recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("last"), F.count("*").alias("n"))
    return K.newest(runs, [F.col("last").desc(), F.col("run")], 10)


@query(f"WITH {_ALERTS}, a AS (SELECT * FROM al WHERE category = 'view' AND rule NOT LIKE 'watch%') SELECT id, saving, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a) > 40 AS truncated FROM a ORDER BY saving DESC, id LIMIT 40")
def alerts_of_run(spark, sf_dir):
    a = alerts(spark, sf_dir).filter("category = 'view' and rule not like 'watch%'")
    return K.page_of(a.select("id", "saving"), [F.col("saving").desc(), F.col("id")], 1, 40).withColumn("truncated", F.col("total") > 40)


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS \"at\" FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def unmatched_queries(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").join(hit, "o_orderkey", "left_anti").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return K.newest(rows, [F.col("at").desc(), F.col("o_orderkey")], 50)


@query("WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def outcome_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority like '1%'").select("o_orderkey", "o_totalprice")
    return K.page_of(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 20)


@query("SELECT c_custkey AS user_id, c_name AS name, count(o_orderkey) AS alerts FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY ALL")
def admin_users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    n = K.counts_for(users, table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id")), "user_id")
    return users.join(n, "user_id").withColumnRenamed("n", "alerts")


@query("SELECT 's' || (l_suppkey % 5) AS store, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS ids FROM lineitem WHERE l_quantity = 50 GROUP BY 1")
def keys_by_store(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("store"), F.col("l_partkey").cast("string").alias("product_id"))
    return K.keys_by_store(wanted).select("store", F.array_join("ids", ",").alias("ids"))


@query("SELECT p_partkey AS product_id, p_size AS source FROM part WHERE p_partkey % 4 = 0 OR p_size <> p_partkey % 50")
def missing_thumbnails(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("long").alias("source"))
    known = p.filter("product_id % 4 <> 0").select("product_id", (F.col("product_id") % 50).alias("source"))
    return K.differing(p, known, ["product_id"], "source").withColumn("source", F.col("source").cast("int"))


@query("SELECT p_partkey AS product_id, p_partkey % 4 <> 0 AS stored FROM part")
def thumb_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    return K.flagged(p, p.filter("product_id % 4 <> 0"), ["product_id"])


@query(f"""WITH {OFF}, n AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store, product_id) = 1 AS low FROM off WHERE product_id % 3 = 0)
SELECT store, product_id, price, 'q' AS last_query, low AS is_lowest FROM n UNION ALL SELECT store, product_id, price_normal, NULL, false FROM off WHERE product_id % 3 <> 0""")
def upserted_offers(spark, sf_dir):
    o = offers(spark, sf_dir)
    return K.upserted_offers(o.select(*KEY, F.col("price_normal").alias("price")), o.filter("product_id % 3 = 0").withColumn("grp", F.col("product_id")), KEY, "q")


@query(f"WITH {_ALERTS} SELECT id, rule, saving, ts::DATE AS day, 'r1' AS run FROM al WHERE id % 2 = 1")
def saved_alerts(spark, sf_dir):
    """New alerts only: those with an even id were stored before."""
    from tallystone.operators.rules import not_stored

    a = alerts(spark, sf_dir)
    return K.stamped_alerts(not_stored(a, a.filter("id % 2 = 0"), ["id", "rule"]), "r1", "ts").select("id", "rule", "saving", "day", "run")


@query("SELECT p_partkey AS product_id, CASE WHEN p_partkey % 5 = 0 THEN 'm' || p_size WHEN p_partkey % 3 = 0 THEN 'old' END AS entity_override FROM part")
def entity_overrides(spark, sf_dir):
    p = _parts(spark, sf_dir).select("product_id", F.when(F.col("product_id") % 3 == 0, "old").alias("entity_override"), "size")
    new = p.filter("product_id % 5 = 0").select("product_id", F.concat(F.lit("m"), F.col("size").cast("string")).alias("entity_override"))
    return K.overridden(p, new, ["product_id"]).select("product_id", "entity_override")


@query("""WITH m AS (SELECT p_brand, min(p_type) AS value FROM part GROUP BY 1) SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 = 0 THEN value ELSE p_type END AS category FROM part JOIN m USING (p_brand)""")
def backfilled_categories(spark, sf_dir):
    p = _parts(spark, sf_dir)
    mapping = p.groupBy("brand").agg(F.min("category").alias("value"))
    holes = p.withColumn("category", F.when(F.col("product_id") % 8 == 0, "").when(F.col("product_id") % 4 != 0, F.col("category")))
    return K.backfilled(holes, mapping, "brand", "category").select("product_id", "category")


@query(f"""WITH {OBS}, l AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY store, product_id ORDER BY {_DESC}) = 1)
SELECT CASE WHEN NOT (price > 0 AND price_normal > price) THEN 'invalid' WHEN product_id % 7 = 0 THEN 'missing' WHEN product_id % 5 = 0 THEN 'existing' ELSE 'inserted' END AS outcome, count(*) AS n FROM l GROUP BY 1""")
def candidates_of_day(spark, sf_dir):
    last = stored(last_observations(spark, sf_dir).select(*KEY, *ORDER, "price_normal"))
    day = F.to_date(as_of())
    signature = F.concat_ws(":", F.col("price").cast("string"), F.col("price_normal").cast("string"))
    now = last.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id")), "product_id", "left_semi")
    queued = now.filter("product_id % 5 = 0").select(*KEY, day.alias("day"), signature.alias("signature"))
    return K.candidates_of_day(last, now.filter("product_id % 7 <> 0"), queued, day, KEY, ORDER).groupBy("outcome").agg(F.count("*").alias("n"))
