"""Registered queries on price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import series as S
from tallystone.registry import query

from .views import AS_OF, DAY, KEY, NOW, OBS, ORD, ORDER, SER, WIN, as_of, observations


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.series(observations(spark, sf_dir), KEY)


@query(f"""WITH {SER}, d AS (SELECT store, product_id, price, lag(price) OVER w AS before FROM ser {WIN})
SELECT store, count(DISTINCT product_id) AS products, count(*) FILTER (WHERE before > price) AS drops,
  round(avg(round((before - price) * 100 / before, 1)) FILTER (WHERE before > price), 4) AS avg_percent FROM d GROUP BY store""")
def drops_by_store(spark, sf_dir):
    p = points(spark, sf_dir)
    drops = S.drop_events(p, KEY, ORDER).groupBy("store").agg(F.count("*").alias("drops"), F.round(F.avg("percent"), 4).alias("avg_percent"))
    products = p.groupBy("store").agg(F.countDistinct("product_id").alias("products"))
    return products.join(drops, "store", "left").withColumn("drops", F.coalesce("drops", F.lit(0)))


@query(f"""WITH {SER}, d AS (SELECT *, lag(price) OVER w AS previous_price FROM ser {WIN})
SELECT store, product_id, ts::TIMESTAMP AS ts, previous_price, price, round((previous_price - price) * 100 / previous_price, 1) AS percent FROM d WHERE previous_price > price""")
def drop_events(spark, sf_dir):
    return S.drop_events(points(spark, sf_dir), KEY, ORDER).select(*KEY, "ts", "previous_price", "price", "percent")


@query(f"""WITH {SER}, d AS (SELECT store, product_id, {DAY} AS day, arg_max(price, ({ORD})) AS price FROM ser GROUP BY ALL),
b AS (SELECT store, product_id, min(day) AS first FROM d GROUP BY ALL),
c AS (SELECT store, product_id, unnest(generate_series(first, DATE '2001-08-01', INTERVAL 1 DAY))::DATE AS day FROM b WHERE first < DATE '2001-08-01' UNION ALL SELECT d.store, d.product_id, d.day FROM d JOIN b USING (store, product_id) WHERE first >= DATE '2001-08-01' QUALIFY d.day = max(d.day) OVER (PARTITION BY d.store, d.product_id)),
f AS (SELECT c.store, c.product_id, c.day, last_value(d.price IGNORE NULLS) OVER (PARTITION BY c.store, c.product_id ORDER BY c.day) AS price FROM c LEFT JOIN d USING (store, product_id, day))
SELECT store, product_id, count(*) AS days, min(day) AS first_day, max(day) AS last_day, sum(price)::BIGINT AS price_days, count(*) >= 2 AS drawable FROM f GROUP BY ALL""")
def chart_history_fill(spark, sf_dir):
    daily = S.last_per_day(points(spark, sf_dir), KEY, ORDER)
    return S.filled_summary(daily, KEY, S.local_day(as_of())).withColumn("drawable", F.col("days") >= 2)


@query(f"""WITH {OBS}, flagged AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs),
v AS (SELECT store, product_id, {DAY} AS day, arg_max(price, ({ORD})) AS price, arg_max(price_normal, ({ORD})) AS price_normal FROM flagged WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment') GROUP BY ALL)
SELECT *, CASE WHEN price_normal > price THEN price_normal - price END AS saving FROM v""")
def price_observations_daily(spark, sf_dir):
    return S.daily_observations(points(spark, sf_dir), KEY, ORDER)


_BASE = f"""base AS (SELECT store, product_id, round_even(CASE WHEN count(*) FILTER (WHERE inside) >= 2 THEN median(price) FILTER (WHERE inside) ELSE median(price) FILTER (WHERE n > 1) END, 0)::BIGINT AS baseline
FROM (SELECT *, ts >= {NOW} - INTERVAL 365 DAY AND ts < {NOW} - INTERVAL 30 DAY AS inside, row_number() OVER (PARTITION BY store, product_id ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS n FROM ser) GROUP BY ALL)"""


@query(f"WITH {SER}, {_BASE} SELECT * FROM base")
def baseline_price(spark, sf_dir):
    return S.baseline(points(spark, sf_dir), KEY, ORDER, as_of(), days=365, recent=30)


@query(f"""WITH {SER}, {_BASE}, cur AS (SELECT store, product_id, arg_max(price, ({ORD})) AS current FROM ser GROUP BY ALL),
prev AS (SELECT store, product_id, arg_max(price, ({ORD})) AS previous FROM ser JOIN cur USING (store, product_id) WHERE price <> current GROUP BY ALL)
SELECT store, product_id, current, previous, baseline, round((previous - baseline) * 100 / baseline, 1) AS over_percent FROM cur JOIN prev USING (store, product_id) JOIN base USING (store, product_id)
WHERE previous > current AND previous > baseline * 1.05::DOUBLE AND current >= baseline * 0.98::DOUBLE""")
def fake_discount(spark, sf_dir):
    p = points(spark, sf_dir)
    current = p.groupBy(*KEY).agg(F.max_by("price", F.struct(*ORDER)).alias("current"))
    previous = p.join(current, KEY).filter("price <> current").groupBy(*KEY, "current").agg(F.max_by("price", F.struct(*ORDER)).alias("previous"))
    out = previous.join(S.baseline(p, KEY, ORDER, as_of(), days=365, recent=30), KEY)
    out = out.filter(S.fake_discount(F.col("current"), F.col("previous"), F.col("baseline")))
    return out.withColumn("over_percent", F.round((F.col("previous") - F.col("baseline")) * 100 / F.col("baseline"), 1))


@query(f"""WITH {SER}, s AS (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS previous_price FROM ser {WIN}),
d AS (SELECT * FROM s WHERE previous_price > price),
h AS (SELECT d.store, d.product_id, d.n, count(*) FILTER (WHERE inside) AS k, median(p) FILTER (WHERE inside) AS a, median(p) FILTER (WHERE m < n) AS b FROM (
  SELECT d.store, d.product_id, d.n, s.n AS m, s.price AS p, s.ts >= d.ts - INTERVAL 365 DAY AND s.ts < d.ts - INTERVAL 7 DAY AS inside FROM d JOIN s ON s.store = d.store AND s.product_id = d.product_id AND s.n <= d.n) d GROUP BY ALL)
SELECT d.store, d.product_id, d.ts::TIMESTAMP AS ts, d.previous_price, d.price, round((d.previous_price - d.price) * 100 / d.previous_price, 1) AS percent,
  coalesce(d.previous_price > base * 1.05::DOUBLE AND d.price >= base * 0.98::DOUBLE, false) AS inflated
FROM d JOIN (SELECT *, round_even(CASE WHEN k >= 2 THEN a ELSE b END, 0)::BIGINT AS base FROM h) h USING (store, product_id, n)""")
def classified_drops(spark, sf_dir):
    return S.classified_drops(points(spark, sf_dir), KEY, ORDER, days=365).select(*KEY, "ts", "previous_price", "price", "percent", "inflated")


@query(f"""WITH {SER}, s AS (SELECT *, row_number() OVER w AS n, last_value(price) OVER (PARTITION BY store, product_id ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM ser {WIN}),
c AS (SELECT *, coalesce(max(n) FILTER (WHERE price <> current) OVER (PARTITION BY store, product_id), 0) AS change FROM s)
SELECT store, product_id, current, greatest(0, (epoch_us({NOW}) - epoch_us(min(ts))) // 86400000000)::BIGINT AS days FROM c WHERE n > change GROUP BY ALL""")
def changed_days_ago(spark, sf_dir):
    return S.changed_days_ago(points(spark, sf_dir), KEY, ORDER, as_of())


@query(f"""WITH {SER}, cur AS (SELECT store, product_id, arg_max(price, ({ORD})) AS current FROM ser GROUP BY ALL),
b AS (SELECT ser.*, current, min(price) OVER (PARTITION BY store, product_id) AS low FROM ser JOIN cur USING (store, product_id) WHERE price < current)
SELECT store, product_id, low, max(ts::DATE) FILTER (WHERE price = low) AS "on", current - low AS gap, round((current - low) * 100 / current, 1) AS gap_percent FROM b GROUP BY store, product_id, low, current HAVING (current - low) / current >= 0.03""")
def cheaper_before(spark, sf_dir):
    p = points(spark, sf_dir)
    return S.cheaper_before(p, p.groupBy(*KEY).agg(F.max_by("price", F.struct(*ORDER)).alias("current")), KEY)


@query(f"""WITH {OBS}, s AS (SELECT *, {DAY} AS day, lag(price) OVER w AS p, lag(price_normal) OVER w AS q, lag({DAY}) OVER w AS e, row_number() OVER w AS n FROM obs {WIN})
SELECT store, count(*) AS recorded, count(DISTINCT (product_id)) AS products FROM s WHERE n = 1 OR price IS DISTINCT FROM p OR price_normal IS DISTINCT FROM q OR day IS DISTINCT FROM e GROUP BY store""")
def recorded_points(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("day", S.local_day("ts"))
    kept = S.value_changes(rows, KEY, ORDER, ["price", "price_normal", "day"])
    return kept.groupBy("store").agg(F.count("*").alias("recorded"), F.countDistinct("product_id").alias("products"))


_MOVES = f"""m AS (SELECT *, CASE WHEN price < previous_price THEN 'down' ELSE 'up' END AS direction FROM (SELECT *, lag(price) OVER w AS previous_price FROM ser {WIN}) WHERE price <> previous_price),
t AS (SELECT *, CASE WHEN direction IS NOT DISTINCT FROM lag(direction) OVER w THEN 0 ELSE 1 END AS turn FROM m {WIN}), r AS (SELECT *, sum(turn) OVER w AS run FROM t {WIN}),
k AS (SELECT *, row_number() OVER (PARTITION BY store, product_id, run ORDER BY {ORD}) AS streak FROM r)"""


@query(f"WITH {SER}, {_MOVES} SELECT store, direction, streak, count(*) AS n, CASE WHEN streak > 1 THEN direction || '_again' ELSE direction END AS label FROM k GROUP BY ALL")
def direction_streaks(spark, sf_dir):
    return S.direction_streaks(points(spark, sf_dir), KEY, ORDER).groupBy("store", "direction", "streak", "label").agg(F.count("*").alias("n"))


@query(f"WITH {SER}, c AS (SELECT store, product_id, CASE WHEN price <> lag(price) OVER w THEN 1 ELSE 0 END AS c FROM ser {WIN}) SELECT store, product_id, count(*) AS points, sum(c)::BIGINT AS changes, count(*) >= 8 AND sum(c) >= 3 AS dense FROM c GROUP BY ALL")
def price_change_counts(spark, sf_dir):
    return S.price_changes(points(spark, sf_dir), KEY, ORDER).withColumn("dense", (F.col("points") >= 8) & (F.col("changes") >= 3))


@query(f"""WITH {SER}, m AS (SELECT *, lag(price) OVER w AS previous_price FROM ser {WIN})
SELECT store, product_id, max(ts)::TIMESTAMP AS at, arg_max(previous_price, ({ORD})) AS previous_price, arg_max(price, ({ORD})) AS price FROM m WHERE price <> previous_price AND ts >= TIMESTAMP '2001-01-01' GROUP BY ALL""")
def price_changes_window(spark, sf_dir):
    return S.last_value_change(points(spark, sf_dir), KEY, ORDER, F.lit("2001-01-01").cast("timestamp"))


@query(f"""WITH {SER}, e AS (SELECT *, last_value(price) OVER w2 AS p, last_value(price_normal) OVER w2 AS l, last_value(ts) OVER w2 AS t FROM ser WINDOW w2 AS (PARTITION BY store, product_id ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT store, product_id, max(ts::DATE) AS day FROM e WHERE price <> p AND ts::DATE <> t::DATE AND price >= l * 0.95::DOUBLE GROUP BY ALL""")
def previous_full_price_day(spark, sf_dir):
    return S.full_price_day(points(spark, sf_dir), KEY, ORDER)


@query(f"""WITH {SER}, b AS (SELECT store, product_id, price, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY store, product_id)) // (30 * 86400000000) AS bucket FROM ser)
SELECT store, product_id, bucket, list_sort(list(price))[count(*) // 2 + 1] AS price, count(*) AS n FROM b GROUP BY ALL""")
def bucket_relative_median(spark, sf_dir):
    return S.bucket_medians(points(spark, sf_dir), KEY, 30 * 86400)


@query(f"""WITH {SER}, i AS (SELECT *, row_number() OVER w AS i FROM ser {WIN}), f AS (SELECT store, product_id, arg_max(price, i)::HUGEINT AS p, count(*) * sum(i * price)::HUGEINT - sum(i)::HUGEINT * sum(price)::HUGEINT AS rise, count(*) * sum(i * i)::HUGEINT - sum(i)::HUGEINT * sum(i)::HUGEINT AS run FROM i GROUP BY ALL HAVING count(*) >= 2)
SELECT store, product_id, step::INT AS step, greatest(100, (200 * (p * run + rise * step) + run) // (2 * run))::DOUBLE / 100 AS price FROM f, unnest(generate_series(1, 3)) t(step)""")
def event_slope_projection(spark, sf_dir):
    return S.slope_projection(points(spark, sf_dir), KEY, ORDER, 3)
