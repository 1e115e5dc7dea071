"""Registered queries on price statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import series as S
from tallystone.operators import stats as T
from tallystone.registry import query

from .series import _BASE, points
from .views import DAY, KEY, NOW, OFF, ORD, ORDER, SER, WIN, as_of, observations, table

_WINDOWS = (365, 730, 1500)


def _summaries() -> str:
    out = []
    for d in _WINDOWS:
        inside = f"ts >= {NOW} - INTERVAL {d} DAY"
        pick = lambda f: f"CASE WHEN count(*) FILTER (WHERE {inside}) > 0 THEN {f} FILTER (WHERE {inside}) ELSE {f} END"  # noqa: B023, E731
        out += [f"{pick('count(price)')} AS count_{d}", f"{pick('min(price)')} AS min_{d}", f"{pick('max(price)')} AS max_{d}", f"round_even({pick('median(price)')}, 0)::BIGINT AS median_{d}"]
    return ", ".join(out)


@query(f"""WITH {SER}, {_BASE}, st AS (SELECT store, product_id, arg_max(price, ({ORD})) AS current, count(*) AS points, min(price) AS low, max(price) AS high, {_summaries()} FROM ser GROUP BY store, product_id),
prev AS (SELECT store, product_id, arg_max(price, ({ORD})) AS previous FROM ser JOIN st USING (store, product_id) WHERE price <> current GROUP BY store, product_id),
a AS (SELECT st.*, previous, baseline, round((current - median_1500) * 100 / median_1500, 1) + 0.0::DOUBLE AS percent_vs_median, current <= low AND points >= 3 AS lowest,
  coalesce(previous > current AND previous > baseline * 1.05::DOUBLE AND current >= baseline * 0.98::DOUBLE, false) AS fake
  FROM st LEFT JOIN prev USING (store, product_id) LEFT JOIN base USING (store, product_id))
SELECT *, CASE WHEN percent_vs_median IS NULL THEN 'unknown' WHEN fake THEN 'fake' WHEN lowest OR percent_vs_median <= -10 THEN 'great' WHEN percent_vs_median <= -2 THEN 'good' WHEN percent_vs_median >= 5 THEN 'high' ELSE 'normal' END AS level FROM a""")
def price_stats_windows(spark, sf_dir):
    return T.price_stats(points(spark, sf_dir), KEY, ORDER, as_of(), _WINDOWS, baseline_days=365, recent=30)


@query(f"""WITH {SER}, r AS (SELECT *, lag(price) OVER w AS b FROM ser {WIN}), q AS (SELECT *, b > price AS d, CASE WHEN b > price THEN round((b - price) * 100 / b, 1) END AS p, CASE WHEN b > price THEN ts END AS f FROM r),
g AS (SELECT *, CASE WHEN d THEN (epoch_us(ts) - epoch_us(last_value(f IGNORE NULLS) OVER (PARTITION BY store, product_id ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) // 86400000000 END AS gap FROM q),
a AS (SELECT store, product_id, arg_max(price, ({ORD})) AS current, count(*) AS n, min(price) AS low, max(price) AS high, (epoch_us({NOW}) - epoch_us(min(ts))) // 86400000000 AS days_tracked, count(p) AS drops,
  round(round(median(p), 2), 1) AS typical_drop_percent, (epoch_us({NOW}) - epoch_us(max(f))) // 86400000000 AS days_since_last_drop, round_even(median(gap), 0)::BIGINT AS typical_days_between_drops, min(price) FILTER (WHERE ts >= {NOW} - INTERVAL 180 DAY) AS rl FROM g GROUP BY store, product_id),
z AS (SELECT *, n >= 2 AND days_tracked >= 14 AS ready, CASE WHEN high = low THEN 0 ELSE round_even((current - low) * 100 / (high - low), 0)::BIGINT END AS pos FROM a)
SELECT store, product_id, current, low, days_tracked, drops, typical_drop_percent, days_since_last_drop, typical_days_between_drops, ready, CASE WHEN ready THEN pos END AS position_percent,
  CASE WHEN NOT ready THEN 'no_data' WHEN low > 0 AND (current - low) * 100 / low <= 10 THEN 'buy' WHEN current <= rl THEN 'buy' WHEN typical_days_between_drops > 0 AND days_since_last_drop < typical_days_between_drops THEN 'wait' WHEN pos >= 60 THEN 'wait' ELSE 'undecided' END AS advice FROM z""")
def buy_or_wait(spark, sf_dir):
    return T.buy_or_wait(points(spark, sf_dir), KEY, ORDER, as_of())


@query(f"""WITH {SER}, cur AS (SELECT store, product_id, arg_max(price, ({ORD})) AS current FROM ser GROUP BY ALL),
o AS (SELECT ser.*, current, row_number() OVER (PARTITION BY store, product_id ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS n FROM ser JOIN cur USING (store, product_id) WHERE price <> current),
m AS (SELECT store, product_id, count(*) AS k, median(price) AS m FROM o WHERE n <= 30 GROUP BY ALL)
SELECT store, product_id, CASE WHEN k >= 2 AND m > current THEN round((m - current) * 100 / m, 1) ELSE 0.0::DOUBLE END AS verified_discount FROM cur LEFT JOIN m USING (store, product_id)""")
def verified_discount(spark, sf_dir):
    return T.verified_discount(points(spark, sf_dir), KEY, ORDER)


_DAILY = f"dl AS (SELECT store, product_id, {DAY} AS day, arg_max(price, ({ORD})) AS price FROM ser GROUP BY ALL)"
#: Daily prices of a whole store and part type are long enough for seasonal patterns.
_WIDE = f"wide AS (SELECT store, l_suppkey AS product_id, {DAY} AS day, arg_max(price, ({ORD}, product_id)) AS price FROM ser GROUP BY ALL)"


def _wide(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.withColumn("day", S.local_day("ts")).groupBy("store", F.col("l_suppkey").alias("product_id"), "day").agg(F.max_by("price", F.struct(F.struct(*ORDER), F.struct("product_id"))).alias("price"))


@query(f"""WITH {SER}, {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY day DESC) AS b, lag(price) OVER (PARTITION BY store, product_id ORDER BY day) AS l,
  last_value(price) OVER (PARTITION BY store, product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM dl),
t AS (SELECT *, max(day) FILTER (WHERE price <> c) OVER (PARTITION BY store, product_id) AS turn FROM r)
SELECT store, product_id, count(*) AS observations, (max(day) - min(day) + 1)::BIGINT AS history_days, sum(CASE WHEN b <= 30 AND price <> l THEN 1 ELSE 0 END)::BIGINT AS changes,
  round(coalesce(CASE WHEN count(*) FILTER (WHERE b <= 90) >= 2 THEN stddev_pop(price) FILTER (WHERE b <= 90) / avg(price) FILTER (WHERE b <= 90) END, 0.0::DOUBLE), 4) AS volatility,
  (DATE '2001-08-01' - min(day) FILTER (WHERE turn IS NULL OR day > turn))::BIGINT AS unchanged_days, arg_max(price, day) AS last_price FROM t GROUP BY ALL""")
def price_profile(spark, sf_dir):
    return T.price_profile(S.last_per_day(points(spark, sf_dir), KEY, ORDER), KEY, S.local_day(as_of()))


@query(f"""WITH {SER}, {_WIDE}, e AS (SELECT * FROM wide QUALIFY count(*) OVER (PARTITION BY store, product_id) >= 28), a AS (SELECT store, product_id, median(price) AS m, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT store, product_id, 'weekday_promotion' AS pattern, (isodow(day) - 1)::INT AS part, median(price) AS p, count(*) AS samples FROM e GROUP BY ALL HAVING count(*) >= 4
  UNION ALL SELECT store, product_id, 'seasonal_low', month(day)::INT, median(price), count(*) FROM e GROUP BY ALL HAVING count(*) >= 7),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY store, product_id, pattern ORDER BY p, part) = 1),
d AS (SELECT f.*, (p - m) * 100 / m AS diff, n FROM f JOIN a USING (store, product_id)),
ev AS (SELECT *, (month(day) = 5 AND day(day) >= 20) OR month(day) = 6 OR (month(day) = 9 AND day(day) >= 25) OR (month(day) = 10 AND day(day) <= 10) AS c FROM e),
s AS (SELECT store, product_id, 'event_window' AS pattern, median(price) FILTER (WHERE c) AS i, count(*) FILTER (WHERE c) AS samples, median(price) FILTER (WHERE NOT c) AS o, count(*) FILTER (WHERE NOT c) AS k, 5 AS li, 20 AS lo, -7 AS shift FROM ev GROUP BY store, product_id
  UNION ALL SELECT store, product_id, 'pre_christmas_rise', median(price) FILTER (WHERE month(day) = 12 AND day(day) <= 24), count(*) FILTER (WHERE month(day) = 12 AND day(day) <= 24), median(price) FILTER (WHERE month(day) IN (9, 10, 11)), count(*) FILTER (WHERE month(day) IN (9, 10, 11)), 7, 14, 7 FROM ev GROUP BY store, product_id
  UNION ALL SELECT store, product_id, 'season_end', median(price) FILTER (WHERE month(day) IN (3, 9)), count(*) FILTER (WHERE month(day) IN (3, 9)), median(price), count(*), 7, 1, -7 FROM ev WHERE product_id % 2 = 0 GROUP BY store, product_id)
SELECT store, product_id, pattern, part, round(diff, 1) AS difference, samples FROM d WHERE (pattern = 'weekday_promotion' AND diff <= -5) OR (pattern = 'seasonal_low' AND n >= 300 AND diff <= -7)
UNION ALL SELECT store, product_id, pattern, NULL, round((i - o) * 100 / o, 1), samples FROM s WHERE samples >= li AND k >= lo AND CASE WHEN shift > 0 THEN (i - o) * 100 / o >= shift ELSE (i - o) * 100 / o <= shift END""")
def price_patterns(spark, sf_dir):
    return T.price_patterns(_wide(spark, sf_dir), KEY, season=F.col("product_id") % 2 == 0)


@query(f"""WITH {OFF}, cur AS MATERIALIZED (SELECT store, product_id, price AS cp, price_normal AS cn FROM off WHERE price > 0 AND price_normal > price),
l AS MATERIALIZED (SELECT o.store, o.product_id, ts, price_normal AS v, row_number() OVER (PARTITION BY o.store, o.product_id ORDER BY {ORD}) AS i, count(*) OVER (PARTITION BY o.store, o.product_id) + 1 AS n FROM obs o JOIN cur USING (store, product_id) WHERE price_normal > 0 AND ts >= {NOW} - INTERVAL 2000 DAY),
r AS MATERIALIZED (SELECT * FROM l UNION ALL SELECT DISTINCT store, product_id, {NOW}, cn, n, n FROM l JOIN cur USING (store, product_id)),
q AS (SELECT *, max(CASE WHEN ts < {NOW} - INTERVAL 400 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS old FROM r),
z AS MATERIALIZED (SELECT *, CASE WHEN old = 1 THEN ts < {NOW} - INTERVAL 400 DAY ELSE i <= greatest(1, n // 2) END AS older FROM q),
lv AS MATERIALIZED (SELECT store, product_id, round_even(median(v) FILTER (WHERE older), 0)::BIGINT AS baseline_normal, max(v) FILTER (WHERE NOT older) AS inflated_normal FROM z GROUP BY ALL),
sb AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS b FROM obs WHERE price > 0 AND ts < {NOW} - INTERVAL 400 DAY),
sd AS MATERIALIZED (SELECT store, product_id, round_even(median(price), 0)::BIGINT AS sold FROM sb WHERE b <= 30 GROUP BY ALL),
x AS (SELECT *, coalesce(sold, baseline_normal) AS prior_selling FROM lv JOIN cur USING (store, product_id) LEFT JOIN sd USING (store, product_id))
SELECT store, product_id, baseline_normal, inflated_normal, prior_selling, round((inflated_normal - baseline_normal) * 100 / baseline_normal, 1) AS rise_percent, round((cn - cp) * 100 / cn, 1) AS commercial_discount FROM x
WHERE baseline_normal > 0 AND inflated_normal >= baseline_normal * 1.15::DOUBLE AND cn >= baseline_normal * 1.15::DOUBLE AND (abs(cp - prior_selling) / greatest(prior_selling, 1) <= 0.05::DOUBLE OR abs(cp - baseline_normal) / greatest(baseline_normal, 1) <= 0.05::DOUBLE)""")
def list_inflation(spark, sf_dir):
    found = T.list_inflation(observations(spark, sf_dir), KEY, ORDER, as_of(), window=2000, recent=400)
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    return found.join(known, "product_id", "left_semi").select(found.columns)


@query(f"""WITH {SER}, r AS (SELECT * FROM ser WHERE price_normal > 0 AND ts >= {NOW} - INTERVAL 914 DAY AND ts <= {NOW}),
a AS (SELECT store, product_id, count(*) AS n, coalesce(median(price_normal) FILTER (WHERE ts < {NOW} - INTERVAL 900 DAY), arg_min(price_normal, ({ORD}))::DOUBLE) AS base, max(price_normal) FILTER (WHERE ts >= {NOW} - INTERVAL 900 DAY AND ts <= {NOW} - INTERVAL 2 DAY) AS peak FROM r GROUP BY ALL),
b AS (SELECT *, round_even(base, 0)::BIGINT AS baseline FROM a)
SELECT store, product_id, baseline, peak, round((peak - baseline) * 100 / baseline, 1) AS rise_percent FROM b WHERE n >= 2 AND baseline > 0 AND peak >= baseline * 1.1::DOUBLE""")
def pre_event_rise(spark, sf_dir):
    return T.pre_event_rise(points(spark, sf_dir), KEY, ORDER, "price_normal", as_of(), look_back=900)


@query(f"""WITH {SER}, d AS (SELECT *, lag(price) OVER w AS b FROM ser {WIN}), p AS (SELECT store, product_id, count(*) FILTER (WHERE b > price) AS drops, (epoch_us({NOW}) - epoch_us(min(ts))) // 86400000000 AS days, max(ts) AS seen FROM d GROUP BY ALL HAVING count(*) >= 3)
SELECT n_name AS title, st.store, coalesce(count(p.product_id), 0) AS products, coalesce(sum(drops), 0)::BIGINT AS drops, max(days) AS max_days, max(seen)::TIMESTAMP AS last_seen FROM (SELECT 's' || n_nationkey AS store, n_name FROM nation WHERE n_nationkey < 8) st LEFT JOIN p ON p.store = st.store GROUP BY ALL""")
def stores_report(spark, sf_dir):
    p = points(spark, sf_dir)
    drops = S.drop_events(p, KEY, ORDER).groupBy(*KEY).agg(F.count("*").alias("drops"))
    per = p.groupBy(*KEY).agg(F.count("*").alias("n"), S.periods(as_of(), F.min("ts")).alias("days"), F.max("ts").alias("seen")).filter("n >= 3").join(drops, KEY, "left")
    per = per.groupBy("store").agg(F.count("*").alias("products"), F.sum(F.coalesce("drops", F.lit(0))).alias("drops"), F.max("days").alias("max_days"), F.max("seen").alias("last_seen"))
    stores = table(spark, sf_dir, "nation").filter("n_nationkey < 8").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("store"), F.col("n_name").alias("title"))
    return stores.join(per, "store", "left").withColumns({"products": F.coalesce("products", F.lit(0)), "drops": F.coalesce("drops", F.lit(0))})
