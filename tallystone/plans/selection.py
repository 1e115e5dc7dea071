"""Registered queries on real offers, alerts to users, adaptive visits, merged changes and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import selection as X
from tallystone.operators import series as S
from tallystone.operators import stats as T
from tallystone.registry import query
from tallystone.sources.storage import stored

from .offers import _VERIFIED
from .series import points
from .stats import _DAILY
from .store import _ALERTS, alerts
from .views import KEY, NOW, OBS, OFF, ORD, ORDER, SER, as_of, marked_observations, observations, of_parts, offers, table

G = ["product_id"]
_FLAG = "flagged AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs), ser AS (SELECT * FROM flagged WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment'))"


def judged(spark, sf_dir):
    """Offers with what their history says: verified discount, points, a day at full price; and made-up signs of inflation."""
    last = T.last_with_history(marked_observations(spark, sf_dir), KEY, ORDER, F.col("_kept")).withColumnRenamed("verified_discount", "verified")
    k = F.col("product_id")
    return of_parts(spark, sf_dir, last, "verified", "points", "was_full").withColumns({"list_savings": F.when(k % 17 == 0, F.lit(5.0)), "fake": k % 19 == 0, "pre_event": k % 23 == 0})


_JUDGED = f"""{OFF}, {_FLAG}, {_VERIFIED}, fe AS (SELECT *, last_value(price) OVER w2 AS lp, last_value(price_normal) OVER w2 AS ll, last_value(ts) OVER w2 AS lt FROM ser WINDOW w2 AS (PARTITION BY store, product_id ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
fd AS (SELECT DISTINCT store, product_id FROM fe WHERE price <> lp AND ts::DATE <> lt::DATE AND price >= ll * 0.95::DOUBLE),
jd AS (SELECT off.*, coalesce(verified, 0.0::DOUBLE) AS verified, coalesce(points, 0) AS points, fd.store IS NOT NULL AS was_full, CASE WHEN off.product_id % 17 = 0 THEN 5.0::DOUBLE END AS list_savings, off.product_id % 19 = 0 AS fake, off.product_id % 23 = 0 AS pre_event
  FROM off LEFT JOIN vf USING (store, product_id) LEFT JOIN pt USING (store, product_id) LEFT JOIN fd ON fd.store = off.store AND fd.product_id = off.product_id)"""


@query(f"""WITH {_JUDGED}, u AS (SELECT * FROM jd WHERE store <> 's4' AND NOT stock <= 0 AND price > 0 AND price_all_payment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, family ORDER BY price, store) = 1), c AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY product_id) >= 2),
a AS (SELECT c.product_id, c.store, min(q.price) AS pm, round_even(median(q.price), 0)::BIGINT AS pd, arg_min(q.store, (q.price, q.store)) AS rival_store, bool_or(q.price >= c.price_normal * 0.9::DOUBLE AND q.price >= c.price * 1.1::DOUBLE) AS at_list FROM c JOIN c q ON c.product_id = q.product_id AND c.family <> q.family GROUP BY ALL),
m AS (SELECT c.*, pm, pd, rival_store, at_list, price >= pm * 0.97::DOUBLE OR price >= pd * 0.97::DOUBLE AS sim, CASE WHEN pd > price THEN round((pd - price) * 100 / pd, 1) ELSE 0.0::DOUBLE END AS ms, CASE WHEN price_normal > price THEN round((price_normal - price) * 100 / price_normal, 1) ELSE 0.0::DOUBLE END AS com FROM c JOIN a USING (product_id, store)),
i AS (SELECT *, CASE WHEN sim THEN verified ELSE greatest(verified, ms) END AS r0 FROM m), j AS (SELECT *, CASE WHEN list_savings IS NOT NULL THEN least(r0, list_savings) ELSE r0 END AS r1 FROM i),
k AS (SELECT *, round(CASE WHEN fake THEN least(r1, 0.0::DOUBLE) ELSE r1 END, 1) AS rs, list_savings IS NOT NULL OR fake OR (sim AND com >= 10) OR (pre_event AND com >= 10 AND verified < 10) AS suspicious FROM j),
f AS (SELECT *, at_list AND NOT sim AS kc, (was_full AND list_savings IS NULL AND NOT fake) OR verified >= 10 AS kh, pm - price AS gap, round((pm - price) * 100 / pm, 1) AS gap_percent FROM k
  WHERE (com >= 10 OR verified >= 10) AND ((list_savings IS NULL AND NOT fake AND NOT pre_event) OR (rs >= 10 AND NOT sim AND NOT fake)) AND (NOT sim OR verified >= 10)),
s AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (CASE WHEN price <= pm THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END) + 30 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, rs / 30)) + 15 * 0.9::DOUBLE + 10.0::DOUBLE + 5 * least(1.0::DOUBLE, points::DOUBLE / 5.0::DOUBLE) - (CASE WHEN suspicious THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN sim THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END))), 2) AS score FROM f WHERE (kc OR kh) AND (gap > 0 OR kh))
SELECT product_id, store, rival_store, concat_ws('+', CASE WHEN kc THEN 'comparison' END, CASE WHEN kh THEN 'history' END) AS kinds, gap, gap_percent, score, rs AS real_savings_percent, concat_ws('+', CASE WHEN list_savings IS NOT NULL THEN 'list_inflation' END, CASE WHEN fake THEN 'fake_discount' END, CASE WHEN pre_event THEN 'pre_event_inflation' END, CASE WHEN sim THEN 'similar_to_market' END) AS flags
FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, gap DESC, gap_percent DESC, store) = 1""")
def real_offer_cards(spark, sf_dir):
    out = X.real_offers(judged(spark, sf_dir), G, aggregators=["s4"])
    return out.select("product_id", "store", "rival_store", F.array_join("kinds", "+").alias("kinds"), "gap", "gap_percent", "score", "real_savings_percent", F.array_join("flags", "+").alias("flags"))


@query(f"""WITH {OFF}, c AS (SELECT *, (l % 10) / 10::DOUBLE AS confidence FROM (SELECT *, price AS l FROM off)), p AS (SELECT DISTINCT a.product_id, a.store AS a, b.store AS b, least(a.confidence, b.confidence) AS confidence FROM c a JOIN c b ON a.product_id = b.product_id AND a.store < b.store),
e AS (SELECT product_id, a AS item, confidence FROM p UNION ALL SELECT product_id, b, confidence FROM p), m AS (SELECT product_id, item, max(confidence) AS c FROM e GROUP BY ALL) SELECT product_id, min(c) AS confidence FROM m GROUP BY 1""")
def group_confidence(spark, sf_dir):
    o = offers(spark, sf_dir).select("product_id", "store", ((F.col("price") % 10) / 10).alias("confidence"))
    b = o.select("product_id", F.col("store").alias("b"), F.col("confidence").alias("_c"))
    pairs = o.withColumnRenamed("store", "a").join(b, "product_id").filter("a < b").select("product_id", "a", "b", F.least("confidence", "_c").alias("confidence"))
    return X.group_confidence(pairs, G)


@query(f"""WITH {OFF}, c AS (SELECT *, product_id || store AS id, (price % 10) / 10::DOUBLE AS c FROM off), p AS (SELECT DISTINCT a.id AS a, b.id AS b, least(a.c, b.c) AS score FROM c a JOIN c b ON a.brand = b.brand AND a.category = b.category AND a.id < b.id AND a.store <> b.store WHERE least(a.c, b.c) >= 0.5), t AS (SELECT * FROM p ORDER BY score DESC, a, b LIMIT 60) SELECT * FROM t ORDER BY md5('21:' || a || ':' || b) LIMIT 20""")
def identity_pair_sample(spark, sf_dir):
    o = offers(spark, sf_dir).withColumns({"id": F.concat(F.col("product_id").cast("string"), "store"), "confidence": (F.col("price") % 10) / 10})
    return X.identity_pairs(o, ["brand", "category"], "id", 0.5, 20)


@query(f"""WITH {OFF}, v AS (SELECT * FROM off QUALIFY row_number() OVER (PARTITION BY store, lower(name) ORDER BY price, product_id) = 1), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY brand, family ORDER BY price, store, product_id) = 1)
SELECT brand, count(*) AS shown, count(DISTINCT family) AS stores, count(DISTINCT family) >= 2 AS comparable, min(price) AS lowest FROM f GROUP BY 1""")
def display_groups(spark, sf_dir):
    return X.display_groups(offers(spark, sf_dir), ["brand"])


_MARKS = f"""mk AS (SELECT store, product_id, ts::DATE AS day, price AS evaluated, CASE WHEN product_id % 3 = 0 THEN 'history' ELSE 'comparison' END AS kind FROM obs QUALIFY row_number() OVER (PARTITION BY store, product_id, ts::DATE ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) = 1),
fm AS (SELECT mk.* FROM mk JOIN off o ON mk.store = o.store AND mk.product_id = o.product_id AND mk.evaluated = o.price WHERE kind = 'history' AND mk.store <> 's4')"""


@query(f"WITH {OFF}, {_MARKS} SELECT store, product_id, day, (SELECT count(*) FROM fm) AS total FROM fm ORDER BY md5('21:' || store || ':' || product_id || ':' || day) LIMIT 40")
def public_offer_sample(spark, sf_dir):
    o = observations(spark, sf_dir)
    marks = o.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct(*ORDER)).alias("evaluated")).withColumn("kinds", F.array(F.when(F.col("product_id") % 3 == 0, "history").otherwise("comparison")))
    fresh = X.marks_with_products(marks, offers(spark, sf_dir), KEY, ["history"], ["s4"])
    return X.seeded_sample(fresh.select(*KEY, "day"), [F.col("store"), F.col("product_id"), F.col("day")], 40)


# --- alerts and users ---------------------------------------------------------

_PREFS = """us AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN ['watch', 'real'] ELSE ['drop', 'real', 'super'] END AS kinds, CASE WHEN c_custkey % 5 = 0 THEN ['view'] ELSE [] END AS cats, (c_custkey % 4 * 10)::DOUBLE AS ms, (c_custkey % 3 * 20)::DOUBLE AS mo, (c_custkey % 2 * 30)::DOUBLE AS mr, c_custkey % 6 <> 0 AS approved FROM customer)"""


def _users(spark, sf_dir):
    k = F.col("c_custkey")
    kinds = F.when(k % 2 == 0, F.array(F.lit("watch"), F.lit("real"))).otherwise(F.array(F.lit("drop"), F.lit("real"), F.lit("super")))
    cats = F.when(k % 5 == 0, F.array(F.lit("view"))).otherwise(F.array().cast("array<string>"))
    prefs = F.struct(kinds.alias("kinds"), cats.alias("email_categories"), (k % 4 * 10).cast("double").alias("min_self"), (k % 3 * 20).cast("double").alias("min_other"), (k % 2 * 30).cast("double").alias("min_real"))
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), prefs.alias("prefs"), (k % 6 != 0).alias("approved"))


@query(f"""WITH {_PREFS}, a AS (SELECT event_id, user_id, event_type AS category, ['watch', 'real', 'super', 'drop'][event_id % 4 + 1] AS kind, event_id % 9 AS stock, CASE WHEN event_id % 3 <> 0 THEN (event_id % 50)::DOUBLE END AS own, CASE WHEN event_id % 7 <> 0 THEN (event_id % 41)::DOUBLE END AS other FROM events),
x AS (SELECT a.*, us.* EXCLUDE user_id FROM a JOIN us USING (user_id)), f AS (SELECT *, NOT stock <= 0 AND list_contains(kinds, kind) AS ok, CASE WHEN own IS NULL AND other IS NULL THEN ms = 0 AND mo = 0 ELSE coalesce(own >= ms, false) OR coalesce(other >= mo, false) END AS fl, (len(cats) = 0 OR list_contains(cats, category)) AND (kind NOT IN ('real', 'super') OR mr = 0 OR greatest(coalesce(own, 0.0), coalesce(other, 0.0)) >= mr) AS em FROM x)
SELECT event_id, greatest(coalesce(own, 0.0::DOUBLE), coalesce(other, 0.0::DOUBLE)) AS discount, ok AND (kind = 'watch' OR fl) AS push, ok AND (kind = 'watch' OR (em AND fl)) AS email FROM f""")
def wanted_alerts(spark, sf_dir):
    k = F.col("event_id")
    a = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("category"), F.element_at(F.array(*(F.lit(x) for x in ("watch", "real", "super", "drop"))), (k % 4 + 1).cast("int")).alias("kind"), (k % 9).alias("stock"), F.when(k % 3 != 0, k % 50).cast("double").alias("own"), F.when(k % 7 != 0, k % 41).cast("double").alias("other"))
    x = a.join(_users(spark, sf_dir), "user_id")
    want = lambda channel: X.wants(F.col("kind"), F.col("stock"), F.col("own"), F.col("other"), F.col("category"), F.col("prefs"), channel)
    return x.select("event_id", X.alert_discount(F.col("own"), F.col("other")).alias("discount"), want(None).alias("push"), want("email").alias("email"))


_WATCH = "wa AS (SELECT c_custkey AS user_id, (c_custkey % 200)::BIGINT AS product_id FROM customer), os AS (SELECT o_custkey AS user_id, (o_orderkey % 200)::BIGINT AS product_id FROM orders WHERE o_orderstatus = 'O')"


def _watches(spark, sf_dir):
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 200).alias("product_id"))
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 200).alias("product_id"))
    return w, a


@query(f"""WITH {OFF}, {_PREFS}, {_WATCH}, d AS (SELECT product_id, min(price) AS price FROM off WHERE price < price_normal GROUP BY 1), s AS (SELECT * FROM wa UNION SELECT * FROM os) SELECT user_id, product_id, price FROM d JOIN s USING (product_id) JOIN us USING (user_id) WHERE approved""")
def notified_users(spark, sf_dir):
    changes = offers(spark, sf_dir).filter("price < price_normal").groupBy("product_id").agg(F.min("price").alias("price"))
    w, a = _watches(spark, sf_dir)
    return X.subscribers(changes, w.unionByName(a), _users(spark, sf_dir), G).select("user_id", "product_id", "price")


@query(f"""WITH {_PREFS}, {_WATCH}, k AS (SELECT DISTINCT product_id FROM (SELECT * FROM wa UNION ALL SELECT * FROM os) JOIN us USING (user_id) WHERE approved), f AS (SELECT p_type AS catalog_id, 95 AS score, 6 AS interval_hours FROM part JOIN k ON p_partkey = product_id UNION ALL SELECT p_type, 85, 8 FROM part WHERE p_size > 30)
SELECT catalog_id, max(score) AS score, arg_max(interval_hours, score) AS interval_hours FROM f GROUP BY 1""")
def boosted_catalogs(spark, sf_dir):
    w, a = _watches(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("catalog_id"), "p_size")
    followed = part.join(X.watched_keys(w, a, _users(spark, sf_dir), G), "product_id", "left_semi")
    return X.boosted([(followed, 95, 6), (part.filter("p_size > 30"), 85, 8)], "catalog_id")


@query(f"WITH {_ALERTS} SELECT category, rule, string_agg(DISTINCT lpad(user_id::VARCHAR, 9, '0'), ',' ORDER BY lpad(user_id::VARCHAR, 9, '0')) AS users, count(DISTINCT user_id)::INT AS n FROM al GROUP BY ALL")
def entity_watchers(spark, sf_dir):
    x = X.watchers(alerts(spark, sf_dir), ["category", "rule"])
    return x.select("category", "rule", F.array_join(F.transform("users", lambda u: F.lpad(u.cast("string"), 9, "0")), ",").alias("users"), "n")


_HOSTS = """hs AS (SELECT c_custkey AS host, CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-30' - to_minutes(c_custkey % 13) END AS seen, (c_custkey * 7 % 100)::DOUBLE AS cpu, (c_custkey * 13 % 100)::DOUBLE AS disk FROM customer),
ha AS (SELECT host, 'data' AS metric, CASE WHEN seen IS NULL THEN 'none' ELSE 'stale' END AS level FROM hs WHERE seen IS NULL OR seen < TIMESTAMP '2024-01-29 23:50:00' UNION ALL SELECT host, metric, level FROM (SELECT host, seen, 'cpu' AS metric, CASE WHEN cpu >= 95 THEN 'critical' WHEN cpu >= 80 THEN 'warning' END AS level FROM hs UNION ALL SELECT host, seen, 'disk', CASE WHEN disk >= 90 THEN 'critical' WHEN disk >= 75 THEN 'warning' END FROM hs) WHERE seen >= TIMESTAMP '2024-01-29 23:50:00' AND level IS NOT NULL)"""


def _host_alerts(spark, sf_dir):
    k = F.col("c_custkey")
    seen = F.when(k % 11 != 0, F.lit("2024-01-30").cast("timestamp") - F.make_dt_interval(mins=(k % 13).cast("int")))
    hosts = table(spark, sf_dir, "customer").select(k.alias("host"), seen.alias("seen"), (k * 7 % 100).cast("double").alias("cpu"), (k * 13 % 100).cast("double").alias("disk"))
    return X.host_alerts(hosts, {"cpu": (80, 95), "disk": (75, 90)}, F.lit("2024-01-30").cast("timestamp"))


@query(f"WITH {_HOSTS} SELECT * FROM ha")
def host_alerts(spark, sf_dir):
    return _host_alerts(spark, sf_dir)


@query(f"WITH {_HOSTS}, b AS (SELECT host, metric, CASE WHEN level = 'critical' AND host % 2 = 0 THEN 'warning' ELSE level END AS level FROM ha WHERE host % 3 <> 0) SELECT ha.* FROM ha LEFT JOIN b USING (host, metric) WHERE b.level IS NULL OR (ha.level = 'critical' AND b.level = 'warning')")
def host_alerts_worse(spark, sf_dir):
    a = _host_alerts(spark, sf_dir)
    before = a.filter("host % 3 <> 0").withColumn("level", F.when((F.col("level") == "critical") & (F.col("host") % 2 == 0), "warning").otherwise(F.col("level")))
    return X.worse(a, before, ["none", "stale", "warning", "critical"])


# --- adaptive visits ----------------------------------------------------------


@query(f"""WITH {SER}, {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY day DESC) AS b, lag(price) OVER (PARTITION BY store, product_id ORDER BY day) AS l, last_value(price) OVER (PARTITION BY store, product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM dl),
t AS (SELECT *, max(day) FILTER (WHERE price <> c) OVER (PARTITION BY store, product_id) AS turn FROM r), p AS (SELECT store, product_id, count(*) AS observations, sum(CASE WHEN b <= 30 AND price <> l THEN 1 ELSE 0 END) AS changes, round(coalesce(CASE WHEN count(*) FILTER (WHERE b <= 90) >= 2 THEN stddev_pop(price) FILTER (WHERE b <= 90) / avg(price) FILTER (WHERE b <= 90) END, 0.0::DOUBLE), 4) AS volatility,
  DATE '2001-08-01' - min(day) FILTER (WHERE turn IS NULL OR day > turn) AS u, max(day) AS last_seen FROM t GROUP BY ALL),
s AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN changes >= 4 OR volatility >= 0.08 THEN 25 WHEN changes >= 2 THEN 10 ELSE 0 END + CASE WHEN observations >= 60 AND u >= 90 THEN -30 WHEN observations >= 30 AND u >= 45 THEN -20 ELSE 0 END + CASE WHEN product_id % 29 = 0 THEN 35 ELSE 0 END + CASE WHEN product_id % 6 = 0 THEN 10 ELSE 0 END - 0)) AS score FROM p),
z AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'normal' WHEN score >= 25 THEN 'low' ELSE 'dormant' END AS tier, CASE WHEN score >= 75 THEN 12 WHEN score >= 45 THEN 24 WHEN score >= 25 THEN 72 ELSE 168 END AS h, p_brand FROM s JOIN part ON p_partkey = product_id),
pt AS (SELECT p_brand, pattern, max(score) AS s FROM (SELECT p_brand, score, unnest(['p' || (product_id % 4), 'q' || (product_id % 3)]) AS pattern FROM z) GROUP BY ALL), pl AS (SELECT p_brand, string_agg(pattern, ',' ORDER BY s DESC, pattern) AS patterns FROM (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, pattern) <= 5) GROUP BY 1),
g AS (SELECT p_brand AS catalog_id, max(score)::INT AS score, arg_min(tier, (-score, store || product_id)) AS tier, arg_min(h, (-score, store || product_id))::INT AS interval_hours, max(last_seen)::TIMESTAMP AS last_seen, count(*) AS products FROM z GROUP BY 1)
SELECT g.*, patterns, last_seen + to_hours(interval_hours) AS next_due_at FROM g JOIN pl ON catalog_id = p_brand""")
def catalog_priorities(spark, sf_dir):
    daily = S.last_per_day(points(spark, sf_dir), KEY, ORDER)
    profile = T.profile_with_day(daily, KEY, S.local_day(as_of())).withColumn("last_seen", F.col("last_day").cast("timestamp"))
    k = F.col("product_id")
    rows = X.assessed(profile.withColumns({"likely_drop": k % 29 == 0, "confirmed": k % 6 == 0}))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("catalog_id"))
    patterns = F.array(F.concat(F.lit("p"), (k % 4).cast("string")), F.concat(F.lit("q"), (k % 3).cast("string")))
    rows = rows.join(part, "product_id").select("catalog_id", "score", "tier", "interval_hours", "last_seen", "product_id", F.concat("store", k.cast("string")).alias("id"))
    rows = stored(rows).withColumn("patterns", patterns)  # read for the first product and for the patterns
    return X.catalog_priorities(rows, as_of()).withColumn("patterns", F.array_join("patterns", ","))


# --- changes from several feeds -----------------------------------------------


@query(f"""WITH {SER}, c AS (SELECT *, lag(price) OVER (PARTITION BY store, product_id ORDER BY {ORD}) AS pp FROM ser), a AS (SELECT p_name AS query, price, pp AS previous_price, store, ts AS "at", 'catalog' AS source FROM c JOIN part ON p_partkey = product_id WHERE price <> pp AND ts >= TIMESTAMP '2001-06-01'),
b AS (SELECT upper(p_name) AS query, p_size * 1000 AS price, NULL::BIGINT AS previous_price, NULL AS store, TIMESTAMP '2001-07-01' + to_hours((p_partkey % 700)::INT) AS "at", 'event' AS source FROM part WHERE p_partkey % 3 = 0), d AS (SELECT p_name, NULL, p_partkey, 's9', NULL, 'following' FROM part WHERE p_partkey % 5 = 0),
u AS (SELECT *, lower(query) AS key, ("at" IS NOT NULL, "at", source, coalesce(price, 0)) AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)),
g AS (SELECT key, arg_max(query, o) AS query, arg_max(price, o) FILTER (WHERE price IS NOT NULL) AS price, arg_max(previous_price, o) FILTER (WHERE previous_price IS NOT NULL) AS previous_price, arg_max(store, o) FILTER (WHERE store IS NOT NULL) AS store, max("at")::TIMESTAMP AS "at", arg_max(source, o) AS source, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY key)
SELECT *, row_number() OVER (ORDER BY "at" DESC NULLS LAST, query DESC)::INT AS n FROM g""")
def merged_price_changes(spark, sf_dir):
    """One row a query: catalog changes, event prices and followed products, the newest of each kind of knowledge."""
    from tallystone.functions.text import fold

    part = table(spark, sf_dir, "part")
    p = points(spark, sf_dir).withColumn("previous_price", F.lag("price").over(S.ordered(KEY, ORDER))).filter("price <> previous_price and ts >= '2001-06-01'")
    names = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("query"))
    catalog = p.join(names, "product_id").select("query", "price", "previous_price", "store", F.col("ts").alias("at"))
    k = F.col("p_partkey")
    event = part.filter("p_partkey % 3 = 0").select(F.upper("p_name").alias("query"), (F.col("p_size") * 1000).cast("long").alias("price"), F.lit(None).cast("long").alias("previous_price"), F.lit(None).cast("string").alias("store"), (F.lit("2001-07-01").cast("timestamp") + F.make_dt_interval(hours=(k % 700).cast("int"))).alias("at"))
    following = part.filter("p_partkey % 5 = 0").select(F.col("p_name").alias("query"), F.lit(None).cast("long").alias("price"), k.alias("previous_price"), F.lit("s9").alias("store"), F.lit(None).cast("timestamp").alias("at"))
    out = X.merged_changes({"catalog": catalog, "event": event, "following": following}, fold(F.col("query")))
    return X.numbered(out).withColumn("sources", F.array_join("sources", ","))


# --- quotes -------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS quote_id, l_partkey AS item, l_quantity::BIGINT AS quantity, CASE WHEN l_linenumber <> 3 THEN round(l_extendedprice)::BIGINT END AS unit_price FROM lineitem), p AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 10 <> 0 THEN round(p_retailprice * 20)::BIGINT END AS price, p_size::BIGINT AS stock, (p_partkey % 11) / 10::DOUBLE AS confidence, TIMESTAMP '2001-08-02' - to_hours((p_partkey % 60)::INT) AS seen FROM part),
x AS (SELECT l.*, p.* EXCLUDE item, sum(quantity) OVER (PARTITION BY quote_id, l.item) AS need FROM l LEFT JOIN p USING (item)), c AS (SELECT *, NOT (confidence IS NULL OR confidence < 0.8 OR coalesce(seen < TIMESTAMP '2001-07-31', false) OR coalesce(stock <= 0, false) OR price IS NULL OR (need > quantity AND coalesce(stock, 0) < need) OR unit_price IS NULL) AS ok FROM x)
SELECT quote_id, count(*) AS items, count(*) FILTER (WHERE ok) AS compared, coalesce(sum(unit_price * quantity) FILTER (WHERE ok), 0)::BIGINT AS reference_subtotal, coalesce(sum(price * quantity) FILTER (WHERE ok), 0)::BIGINT AS market_subtotal, count(*) FILTER (WHERE NOT ok) AS pending,
  (coalesce(sum(unit_price * quantity) FILTER (WHERE ok), 0) - coalesce(sum(price * quantity) FILTER (WHERE ok), 0))::BIGINT AS saving, bool_and(ok) AS complete FROM c GROUP BY 1""")
def quote_reports(spark, sf_dir):
    """Orders as quotes: their lines against the catalog."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_linenumber") != 3, F.round("l_extendedprice").cast("long")).alias("unit_price"))
    k = F.col("p_partkey")
    products = table(spark, sf_dir, "part").select(k.alias("item"), F.when(k % 10 != 0, F.round(F.col("p_retailprice") * 20).cast("long")).alias("price"), F.col("p_size").cast("long").alias("stock"), ((k % 11) / 10).alias("confidence"), (as_of() - F.make_dt_interval(hours=(k % 60).cast("int"))).alias("seen"))
    return X.quote_report(X.quote_candidates(lines, products, as_of()))
