"""Registered queries on product rows, groups with histories, relevance, lists and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import intent as N
from tallystone.functions.text import tokens
from tallystone.operators import audit as A
from tallystone.operators import products as R
from tallystone.operators import records
from tallystone.operators import search as V
from tallystone.operators import series as S
from tallystone.registry import query

from .series import points
from .views import KEY, NOW, OFF, ORD, ORDER, SER, as_of, observations, offers, spread, table

DEVICES, ACCESSORIES, FURNITURE, REMEDIES = ["widget", "gizmo", "gear"], ["ring", "rod", "bolt*"], ["plate", "anvil"], ["cold"]
_ASKED = "x AS (SELECT p.p_partkey AS id, lower(p.p_name) AS q, p.p_size AS n, lower(o.p_name) AS m, o.p_size AS k FROM part p JOIN part o ON o.p_partkey = p.p_partkey // 7 * 3 % (SELECT count(*) FROM part))"


@query(f"""WITH {_ASKED}, i AS (SELECT *, regexp_matches(q, '\\b(ring|rod|bolt[a-z0-9]*)\\b') AS accessory, CASE WHEN id % 2 = 0 THEN n + 19 END AS inches, n % 4 = 0 OR regexp_matches(q, '\\bcold\\b') AS pharmacy FROM x), d AS (SELECT *, regexp_matches(q, '\\b(widget|gizmo|gear)\\b') AND NOT accessory AS device FROM i)
SELECT id, device, accessory, inches::INT AS inches, pharmacy, CASE WHEN device AND regexp_matches(m, '^(ring|rod|bolt[a-z0-9]*)\\b') THEN 'accessory' WHEN device AND regexp_matches(m, '\\b(plate|anvil)\\b') THEN 'furniture' WHEN device AND k % 3 = 0 AND regexp_matches(m, '\\b(ring|rod|bolt[a-z0-9]*)\\b') THEN 'made_for' WHEN inches IS NOT NULL AND k % 5 = 0 AND inches <> k + 19 THEN 'inches' WHEN regexp_matches(q, '\\bhot\\b') AND regexp_matches(m, '\\b(old|new)\\b') THEN 'heat' END AS conflict FROM d""")
def query_intents(spark, sf_dir):
    """Names of parts as queries, some with a size or a dose, and the names of other parts as what they find."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("n"))
    other = part.select(F.col("id").alias("other"), F.col("name").alias("m"), F.col("n").alias("k"))
    x = part.withColumn("other", F.floor(F.col("id") / 7) * 3 % part.count()).join(other, "other")
    say = lambda n, unit: F.concat(F.lit(" "), n.cast("string"), F.lit(unit))
    q = F.concat("name", F.when(F.col("id") % 2 == 0, say(F.col("n") + 19, " pulgadas")).otherwise(""), F.when(F.col("n") % 4 == 0, say(F.col("n"), " mg")).otherwise(""))
    name = F.concat("m", F.when(F.col("k") % 3 == 0, " para casa").otherwise(""), F.when(F.col("k") % 5 == 0, say(F.col("k") + 19, " pulgadas")).otherwise(""))
    m = N.intent(q, DEVICES, ACCESSORIES, REMEDIES)
    c = N.conflict(m, name, ACCESSORIES, FURNITURE, {"heat": ("hot", ["old", "new"])}, q)
    return x.select("id", *(m[f].alias(f) for f in ("device", "accessory", "inches", "pharmacy")), c.alias("conflict"))


@query("""SELECT 's1' AS store, p_partkey::VARCHAR AS product_id, 'Cosa ' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN ' usada' ELSE '' END AS name, (p_size * 1000)::BIGINT AS price, (p_size * 1250)::BIGINT AS price_normal, CASE WHEN p_partkey % 3 = 0 THEN (p_size * 1000)::BIGINT END AS price_card, CASE WHEN p_partkey % 3 = 0 THEN 'card' ELSE 'all_payment' END AS price_basis, CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 30 END::BIGINT AS discount,
  CASE WHEN p_partkey % 4 = 0 THEN 'used' WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'unknown' END AS condition, (p_size * 100 + 990)::BIGINT AS shipping_cost, 6 AS instalments, CASE WHEN p_partkey % 7 = 0 THEN 'sold_out' ELSE 'in_stock' END AS stock_state FROM part""")
def product_rows(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("long")
    text = lambda v: F.concat(F.lit("$"), F.translate(F.format_number(v, 0), ",", "."))
    raw = spread(table(spark, sf_dir, "part")).select(
        F.lit(" S1 ").alias("store"), k.cast("string").alias("product_id"), F.concat(F.lit("Cosa "), k.cast("string"), F.when(k % 4 == 0, " usada").otherwise("")).alias("name"), F.concat(F.lit("envio por "), text(n * 100 + 990), F.lit(", 6 cuotas")).alias("description"), F.when(k % 5 == 0, "Nuevo").alias("condition"),
        F.when(k % 3 != 0, text(n * 1000)).alias("price"), text(n * 1250).alias("price_normal"), F.when(k % 3 == 0, text(n * 1000)).alias("price_card"), F.when(k % 2 == 0, 95).otherwise(-30).alias("discount"), F.when(k % 7 == 0, 0).otherwise(2).alias("stock"), F.lit("").alias("availability"),
    )
    return R.product_rows(raw)


@query("""SELECT p_partkey AS id, 'Talla ' || p_size || ' rojo agotado' AS texts, CASE WHEN p_partkey % 2 = 0 THEN 'same' ELSE 'different' END AS price, CASE WHEN p_partkey % 3 = 0 THEN 'same' ELSE 'not_verified' END AS stock, CASE WHEN p_partkey % 5 = 0 THEN 'not_verified' ELSE 'different' END AS shipping FROM part""")
def variant_texts_and_differences(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    doc = F.concat(F.lit('{"a": ["Talla '), n.cast("string"), F.lit('", {"color": "rojo", "n": 3}], "estado": "agotado"}'))
    e = F.struct(n.alias("price"), n.alias("stock"), n.alias("shipping"))
    o = F.struct(F.when(k % 2 == 0, n).otherwise(n + 1).alias("price"), n.alias("stock"), (n + 1).alias("shipping"))
    d = R.differences(e, o, ["price", "stock", "shipping"], k % 3 == 0, k % 5 != 0)
    return table(spark, sf_dir, "part").select(k.alias("id"), R.json_text(doc).alias("texts"), *(d[f].alias(f) for f in ("price", "stock", "shipping")))


@query(f"""WITH {OFF}, fl AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs), ser AS (SELECT * FROM fl WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment')),
h AS (SELECT store, product_id, list(price ORDER BY {ORD}) AS p FROM ser GROUP BY ALL), x AS (SELECT off.store, off.product_id, price, coalesce(p, []) AS p, list_filter(coalesce(p, []), lambda v: v <> price) AS o FROM off LEFT JOIN h USING (store, product_id))
SELECT store, product_id, len(p)::INT AS points, list_min(p) AS low, o[-1] AS previous, price - o[-1] AS delta, array_to_string(p[greatest(1, len(p) - 11):], ',') AS spark FROM x""")
def offers_with_history(spark, sf_dir):
    out = R.with_history(offers(spark, sf_dir).select(*KEY, "price"), points(spark, sf_dir), KEY, ORDER)
    return out.select(*KEY, "points", "low", "previous", "delta", F.array_join(F.transform("spark", lambda x: x.cast("string")), ",").alias("spark"))


@query(f"WITH {OFF} SELECT product_id, min(price) AS lowest, count(DISTINCT family) AS stores, count(DISTINCT family) >= 2 AS comparable, string_agg(store || ':' || price, ',' ORDER BY price, store) AS offers FROM off WHERE price > 0 GROUP BY 1")
def compared_products(spark, sf_dir):
    return R.compared(offers(spark, sf_dir), ["product_id"]).withColumn("offers", F.array_join("offers", ","))


@query("""WITH s AS (SELECT (event_id % 50)::BIGINT AS query_id, event_id AS product_id, (user_id * 100)::BIGINT AS price, (event_id % 7) / 7::DOUBLE AS score, CASE WHEN event_id % 3 <> 0 THEN (event_id % 11) / 11::DOUBLE END AS semantic FROM events WHERE event_id % 4 <> 0), b AS (SELECT *, round(CASE WHEN semantic IS NULL THEN score ELSE 0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * semantic END, 6) AS blend FROM s WHERE price BETWEEN 1000 AND 9000)
SELECT query_id, product_id, blend, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, price, product_id)::INT AS place FROM b""")
def relevant_results(spark, sf_dir):
    e = F.col("event_id")
    s = table(spark, sf_dir, "events").select((e % 50).alias("query_id"), e.alias("product_id"), (F.col("user_id") * 100).alias("price"), (e % 7 / 7).alias("score"), F.when(e % 3 != 0, e % 11 / 11).alias("semantic"), (e % 4 != 0).alias("accepted"))
    return R.relevant(s, (1000, 9000)).select("query_id", "product_id", "blend", "place")


@query("SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT n_nationkey * 3 AS k, 100 - n_nationkey AS rank FROM nation) ON k = c_custkey ORDER BY rank NULLS LAST, c_acctbal, c_custkey LIMIT 20 OFFSET 20")
def prioritized_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    first = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("id"), (100 - F.col("n_nationkey")).alias("rank"))
    return R.prioritized_page(rows, first, "id", [F.col("c_acctbal"), F.col("id")], 2, 20).select("id")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS recent FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1")
def recent_sends(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("entity"), F.col("ts").cast("timestamp").alias("ts"))
    return R.recent_sends(e, ["user_id"], F.lit("2024-01-30").cast("timestamp")).withColumn("recent", F.array_join("recent", ","))


def _lists(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("store"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("L"), (F.col("l_orderkey") % 10).cast("string")).alias("list_id"))
    return line


@query("SELECT DISTINCT 's' || (l_suppkey % 5) AS store, l_partkey AS product_id FROM lineitem WHERE l_orderkey % 10 IN (1, 2)")
def list_product_keys(spark, sf_dir):
    x = _lists(spark, sf_dir)
    return R.list_keys(x.filter("n = 1"), x.filter("n <> 1"), ["L1", "L2"])


@query("""WITH h AS (SELECT event_id AS id, 'L' || (user_id % 4) AS list_id, event_id % 30 AS n, round(coalesce(value, 0))::BIGINT AS price, ts FROM events), i AS (SELECT 'L' || (p_partkey % 4) AS list_id, p_partkey % 30 AS n, min(p_type) AS query FROM part WHERE p_partkey % 30 < 20 GROUP BY ALL), x AS (SELECT h.*, coalesce(query, h.list_id || ':' || h.n) AS q FROM h LEFT JOIN i USING (list_id, n))
SELECT q AS query, price, ts::TIMESTAMP AS ts FROM x QUALIFY row_number() OVER (PARTITION BY q ORDER BY ts, id) = 1""")
def first_list_changes(spark, sf_dir):
    e, k = F.col("event_id"), F.col("p_partkey")
    h = table(spark, sf_dir, "events").select(e.alias("id"), F.concat(F.lit("L"), (F.col("user_id") % 4).cast("string")).alias("list_id"), (e % 30).alias("n"), F.round(F.coalesce("value", F.lit(0.0))).cast("long").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    items = table(spark, sf_dir, "part").filter("p_partkey % 30 < 20").groupBy(F.concat(F.lit("L"), (k % 4).cast("string")).alias("list_id"), (k % 30).alias("n")).agg(F.min("p_type").alias("query"))
    return R.first_changes(h, items)


@query(f"WITH {OFF}, a AS (SELECT product_id AS anchor, store AS anchor_store, brand FROM off WHERE product_id % 100 = 0) SELECT anchor, anchor_store, off.product_id, off.store FROM a JOIN off USING (brand) QUALIFY row_number() OVER (PARTITION BY anchor, anchor_store ORDER BY (off.product_id = anchor AND off.store = anchor_store) DESC, off.price, off.store, off.product_id) <= 9")
def anchors_with_peers(spark, sf_dir):
    """Anchors: the offers of every product whose id is divisible by 100."""
    o = offers(spark, sf_dir).select(*KEY, "brand", "price")
    return R.peers_of(o.filter("product_id % 100 = 0"), o, "brand", 8)


@query(f"""WITH {SER}, d AS (SELECT store, ts, price, lag(price) OVER w AS b, product_id FROM ser WINDOW w AS (PARTITION BY store, product_id ORDER BY {ORD})), e AS (SELECT store, ts, product_id % 3 = 0 AS inflated FROM d WHERE b > price), a AS (SELECT store, count(*) AS drops, count(*) FILTER (WHERE inflated) AS inflated, max(ts) AS last_seen FROM e GROUP BY 1),
x AS (SELECT 's' || n_nationkey AS store, coalesce(drops, 0) AS drops, coalesce(inflated, 0) AS inflated, last_seen FROM nation LEFT JOIN a ON a.store = 's' || n_nationkey), f AS (SELECT *, round(inflated * 100 / nullif(drops, 0), 1) AS fake_percent, (epoch_us({NOW}) - epoch_us(last_seen)) // 86400000000 AS days_silent FROM x)
SELECT store, drops, inflated, last_seen::TIMESTAMP AS last_seen, fake_percent, days_silent, row_number() OVER (ORDER BY drops DESC, fake_percent NULLS LAST, inflated, last_seen DESC NULLS LAST, store)::INT AS place FROM f""")
def stores_ranking(spark, sf_dir):
    drops = S.drop_events(points(spark, sf_dir), KEY, ORDER).select("store", "ts", (F.col("product_id") % 3 == 0).alias("inflated"))
    stores = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("store"))
    return R.stores_ranking(drops, stores, as_of())


@query("""WITH l AS (SELECT doc_id % 6 AS pair, quality AS a, toxic AS b FROM labels), c AS (SELECT pair, a, b, count(*) AS c FROM l GROUP BY ALL), t AS (SELECT pair, sum(c) AS n, coalesce(sum(c) FILTER (WHERE a = b), 0) AS same FROM c GROUP BY 1), x AS (SELECT p.pair, sum(p.x * q.y) AS xy FROM (SELECT pair, a AS label, sum(c) AS x FROM c GROUP BY ALL) p JOIN (SELECT pair, b AS label, sum(c) AS y FROM c GROUP BY ALL) q USING (pair, label) GROUP BY 1),
k AS (SELECT pair, n, round((same / n - coalesce(xy, 0) / (n * n)) / nullif(1 - coalesce(xy, 0) / (n * n), 0), 6) AS kappa FROM t LEFT JOIN x USING (pair)) SELECT count(*) AS pairs, sum(n)::BIGINT AS items, round(sum(kappa * n) / sum(n), 6) AS kappa FROM k WHERE kappa IS NOT NULL""")
def weighted_kappa(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select((F.col("doc_id") % 6).alias("pair"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return R.weighted_kappa(A.kappa(pairs, ["pair"]))


@query("""SELECT page_id AS id, page_id % 3 <> 2 AS counted, 'b' || (page_id % 4) || ',c' AS left_words, page_id % 2 = 0 AS accepted FROM pages""")
def request_and_word_rules(spark, sf_dir):
    k = F.col("page_id")
    counted = R.counted_request(F.when(k % 3 == 0, "/catalogo").when(k % 3 == 1, "/api/search/stream").otherwise("/static/x.js"), F.lit("get"), ["/", "/catalogo"], ["/api/search"])
    left = R.name_tokens_left(F.array(F.lit("a"), F.concat(F.lit("b"), (k % 4).cast("string")), F.lit("c")), F.array(F.lit("a"), F.lit("z")))
    accepted = R.matches_all(F.when(k % 2 == 0, "Silla Gamer-Roja").otherwise("Silla azul"), tokens(F.lit("silla roja barata")), ["cara"])
    return table(spark, sf_dir, "pages").select(k.alias("id"), counted.alias("counted"), F.array_join(left, ",").alias("left_words"), accepted.alias("accepted"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, label, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM q, embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 8), p AS (SELECT query_id, label, max(score) AS best FROM k GROUP BY ALL), t AS (SELECT *, max(best) OVER (PARTITION BY query_id) AS top FROM p), g AS (SELECT query_id, label % 5 AS grp FROM t WHERE best >= top * 0.78::DOUBLE)
SELECT query_id, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS stores FROM g JOIN nation ON n_regionkey = grp GROUP BY 1""")
def recovered_stores(spark, sf_dir):
    """Queries: every vec_id divisible by 100, against all vectors; the categories within 78 % of the best give groups, and those stores."""
    v = table(spark, sf_dir, "embeddings")
    near = V.top_k(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 8)
    found = V.category_candidates(near, v.select("vec_id", "label"), -1.0, 0.78)
    groups = found.groupBy("query_id").agg(F.collect_set(F.col("label") % 5).alias("groups"))
    stores = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store"), F.col("n_regionkey").alias("grp"), F.col("n_name").alias("position"))
    return records.stores_for(groups, stores).select("query_id", F.array_join("stores", ",").alias("stores"))
