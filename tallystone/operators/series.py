"""Price series: the basis rule, days, gap filling, changes, drops and their classification.

Observations have key columns, ``ts``, ``price`` and, for ties, further order
columns. Every function takes and returns DataFrames; the evaluation time is an
argument. Windows are partitioned by the key, so work grows with one product's
history, never with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/Santiago"
RECENT_DAYS, BASELINE_DAYS, INFLATION_MARGIN = 7, 90, 0.05
MIN_CHEAPER_RATIO = 0.03


def local_day(ts: Column | str, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def periods(later: Column, earlier: Column, seconds: int = 86400) -> Column:
    """Whole periods between two moments (not calendar days)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / (seconds * 1_000_000)).cast("long")


def round_even(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c).cast("long")


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_first() for c in order))


def whole(key: list[str], order: list[str]):
    """All rows of a key in order. Windows of one order share a sort, and those by the key alone need no further one."""
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def is_last(key: list[str], order: list[str]) -> Column:
    """True on a key's last row. Unlike a rank from the end it shares the sort of the other windows, and no rows are ranked before the shuffle, which spares nothing where a key's rows are spread."""
    return F.lead(F.lit(1)).over(ordered(key, order)).isNull()


def marked(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """points with _kept: true for those of series()."""
    of_all = F.coalesce(F.col("price_basis") == "all_payment", F.lit(False))
    x = points.withColumn("_all", F.max(of_all).over(whole(key, order)))
    return x.withColumn("_kept", (~F.col("_all") | of_all) & F.coalesce(F.col("price") > 0, F.lit(False))).drop("_all")


def series(points: DataFrame, key: list[str]) -> DataFrame:
    """Points with a price; where a product has any all-payment point, those only."""
    known = F.max(F.coalesce(F.col("price_basis") == "all_payment", F.lit(False))).over(Window.partitionBy(*key))
    rows = points.withColumn("_all", known).filter(~F.col("_all") | F.coalesce(F.col("price_basis") == "all_payment", F.lit(False)))
    return rows.filter("price > 0").drop("_all")


def last_per_day(points: DataFrame, key: list[str], order: list[str], zone: str = ZONE) -> DataFrame:
    """key, day, price: the last price of each local day."""
    days = points.filter("ts is not null").withColumn("day", local_day("ts", zone))
    return days.withColumn("_last", is_last([*key, "day"], order)).filter("_last").select(*key, "day", "price")


def filled_days(daily: DataFrame, key: list[str], today: Column) -> DataFrame:
    """One row a day from the first to today, prices carried forward; a series that starts today or later has its last day only."""
    bounds = daily.groupBy(*key).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.when(F.col("first") >= today, F.array("last")).otherwise(F.sequence("first", today))
    calendar = bounds.select(*key, F.explode(days).alias("day"))
    carry = F.last("price", ignorenulls=True).over(Window.partitionBy(*key).orderBy("day"))
    return calendar.join(daily, [*key, "day"], "left").withColumn("price", carry)


def filled_summary(daily: DataFrame, key: list[str], today: Column) -> DataFrame:
    """key, days, first_day, last_day, price_days (sum of prices) of filled_days, from how long each price lasts: no row a day is made."""
    w = Window.partitionBy(*key).orderBy("day")
    rows = daily.withColumns({"_first": F.min("day").over(Window.partitionBy(*key)), "_next": F.lead("day").over(w)})
    late = F.col("_first") >= today
    rows = rows.filter(F.when(late, F.col("_next").isNull()).otherwise(F.col("day") <= today))
    end = F.least(F.coalesce("_next", F.date_add(today, 1)), F.date_add(today, 1))
    span = F.when(late, F.lit(1)).otherwise(F.datediff(end, F.col("day")))
    return rows.withColumns({"_span": span, "_end": F.when(late, F.col("day")).otherwise(today)}).groupBy(*key).agg(F.sum("_span").alias("days"), F.min("day").alias("first_day"), F.max("_end").alias("last_day"), F.sum(F.col("price") * F.col("_span")).alias("price_days"))


def daily_observations(points: DataFrame, key: list[str], order: list[str], zone: str = ZONE) -> DataFrame:
    """key, day, price, price_normal, saving: the last valid offer of each local day and, apart from it, the last valid normal price."""
    days = points.filter("ts is not null").withColumn("day", local_day("ts", zone))
    last = lambda c: F.max_by(c, F.when(F.col(c) > 0, F.struct(*order)))
    out = days.groupBy(*key, "day").agg(last("price").alias("price"), last("price_normal").alias("price_normal")).filter("price > 0")
    return out.withColumn("saving", F.when(F.col("price_normal") > F.col("price"), F.col("price_normal") - F.col("price")))


def drop_events(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every decrease between consecutive points: previous_price, price, ts, percent (1 decimal)."""
    before = F.lag("price").over(ordered(key, order))
    rows = points.withColumn("previous_price", before).filter("previous_price > price and price > 0")
    return rows.withColumn("percent", F.round((F.col("previous_price") - F.col("price")) * 100 / F.col("previous_price"), 1))


def baseline_sums(now: Column, days: int, recent: int, last: Column) -> dict[str, Column]:
    """Aggregates of a key's points from which baseline_of_sums tells its baseline."""
    inside = (F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < now - F.expr(f"INTERVAL {recent} DAYS"))
    return {"_base_n": F.count(F.when(inside, 1)), "_base_in": F.median(F.when(inside, F.col("price"))), "_base_all": F.median(F.when(~last, F.col("price")))}


def baseline_of_sums() -> Column:
    return round_even(F.when(F.col("_base_n") >= 2, F.col("_base_in")).otherwise(F.col("_base_all")))


def baseline(points: DataFrame, key: list[str], order: list[str], now: Column, days: int = BASELINE_DAYS, recent: int = RECENT_DAYS) -> DataFrame:
    """key, baseline: the median of [now - days, now - recent); with fewer than two such points, of all but the last."""
    rows = points.withColumn("_last", is_last(key, order))
    sums = baseline_sums(now, days, recent, F.col("_last"))
    rows = rows.withColumns({name: c.over(Window.partitionBy(*key)) for name, c in sums.items()}).filter("_last")
    return rows.select(*key, baseline_of_sums().alias("baseline"))


def fake_discount(current: Column, previous: Column, base: Column, margin: float = INFLATION_MARGIN) -> Column:
    """True where a price only undoes a recent rise above its usual level."""
    return F.coalesce((previous > current) & (previous > base * (1 + margin)) & (current >= base * 0.98), F.lit(False))


def classified_drops(points: DataFrame, key: list[str], order: list[str], days: int = BASELINE_DAYS, recent: int = RECENT_DAYS) -> DataFrame:
    """Drop events with inflated: judged by the history up to each drop alone.

    The history of one product in one store is gathered once, in order; each drop
    looks at the part of that array before it.
    """
    rest = [c for c in points.columns if c not in key and c not in order]
    history = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_h"))
    price = lambda i: F.get("_h", i)["price"]

    def judged(p: Column, i: Column) -> Column:
        from_, to = p["ts"] - F.expr(f"INTERVAL {days} DAYS"), p["ts"] - F.expr(f"INTERVAL {recent} DAYS")
        before = F.slice("_h", F.lit(1), i)
        inside = F.filter(before, lambda q: (q["ts"] >= from_) & (q["ts"] < to))
        older = F.transform(F.when(F.size(inside) >= 2, inside).otherwise(before), lambda q: q["price"])
        return F.struct(p.alias("p"), price(i - 1).alias("previous_price"), F.array_sort(older).alias("s"))

    fell = lambda p, i: (price(i - 1) > p["price"]) & (p["price"] > 0)
    numbered = F.filter(F.transform("_h", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.coalesce(fell(x["p"], x["i"]), F.lit(False)))
    rows = history.select(*key, F.explode(F.transform(numbered, lambda x: judged(x["p"], x["i"]))).alias("_d")).select(*key, "_d.p.*", "_d.previous_price", "_d.s")
    rows = rows.withColumn("_base", round_even(middle(F.col("s"))))
    out = rows.withColumn("percent", F.round((F.col("previous_price") - F.col("price")) * 100 / F.col("previous_price"), 1))
    return out.withColumn("inflated", fake_discount(F.col("price"), F.col("previous_price"), F.col("_base"))).drop("s", "_base")


def middle(sorted_: Column) -> Column:
    """Median of a sorted array, null if it is empty."""
    n = F.size(sorted_)
    return (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2.0


def changed_days_ago(points: DataFrame, key: list[str], order: list[str], now: Column) -> DataFrame:
    """key, current, days: whole days since the trailing run of the current price began."""
    w = ordered(key, order)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumn("current", F.last("price").over(end)).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_change", F.coalesce(F.max(F.when(F.col("price") != F.col("current"), F.col("_n"))).over(Window.partitionBy(*key)), F.lit(0)))
    run = rows.filter("_n > _change").groupBy(*key, "current").agg(F.min("ts").alias("since"))
    return run.select(*key, "current", F.greatest(F.lit(0).cast("long"), periods(now, F.col("since"))).alias("days"))


def cheaper_before(points: DataFrame, current: DataFrame, key: list[str], min_ratio: float = MIN_CHEAPER_RATIO) -> DataFrame:
    """key, low, on, gap, gap_percent where a product cost less before, by min_ratio at least. current: key, current."""
    below = points.join(current, key).filter(F.col("price") < F.col("current"))
    low = F.min("price").over(Window.partitionBy(*key))
    out = below.withColumn("low", low).groupBy(*key, "current", "low").agg(F.max(F.when(F.col("price") == F.col("low"), F.to_date("ts"))).alias("on"))
    out = out.withColumn("gap", F.col("current") - F.col("low")).filter(F.col("gap") / F.col("current") >= min_ratio)
    return out.select(*key, "low", "on", "gap", F.round(F.col("gap") * 100 / F.col("current"), 1).alias("gap_percent"))


def value_changes(points: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Points at which any of the columns differs from the point before (null-safe), and each first point: what is worth recording."""
    w = ordered(key, order)
    first = F.row_number().over(w) == 1
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return points.withColumn("_new", first | changed).filter("_new").drop("_new")


def direction_streaks(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Changed points with previous_price, direction (up or down) and streak: how many changes in a row went that way."""
    w = ordered(key, order)
    moves = points.withColumn("previous_price", F.lag("price").over(w)).filter("previous_price is not null and price <> previous_price")
    moves = moves.withColumn("direction", F.when(F.col("price") < F.col("previous_price"), "down").otherwise("up"))
    turn = F.when(F.col("direction").eqNullSafe(F.lag("direction").over(w)), 0).otherwise(1)
    moves = moves.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w))
    streak = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(*order))
    label = F.when(streak > 1, F.concat("direction", F.lit("_again"))).otherwise(F.col("direction"))
    return moves.withColumn("streak", streak.cast("long")).withColumn("label", label).drop("_turn", "_run")


def price_changes(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, points, changes: observations and consecutive differences."""
    changed = F.when(F.col("price") != F.lag("price").over(ordered(key, order)), 1).otherwise(0)
    return points.withColumn("_c", changed).groupBy(*key).agg(F.count("*").alias("points"), F.sum("_c").alias("changes"))


def last_value_change(points: DataFrame, key: list[str], order: list[str], since: Column) -> DataFrame:
    """key, at, previous_price, price: the last change at or after since; the point before it may be older."""
    w = ordered(key, order)
    moves = points.withColumn("previous_price", F.lag("price").over(w)).filter((F.col("price") != F.col("previous_price")) & (F.col("ts") >= since))
    latest = F.max_by(F.struct(F.col("ts").alias("at"), "previous_price", "price"), F.struct(*order)).alias("m")
    return moves.groupBy(*key).agg(latest).select(*key, "m.*")


def full_price_day(points: DataFrame, key: list[str], order: list[str], ratio: float = 0.95) -> DataFrame:
    """key, day: the latest earlier day at ratio of the current list price or more, at another price than the current one."""
    end = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumns({"_p": F.last("price").over(end), "_l": F.last("price_normal").over(end), "_d": F.to_date(F.last("ts").over(end))})
    hit = (F.col("price") != F.col("_p")) & (F.to_date("ts") != F.col("_d")) & (F.col("price") >= F.col("_l") * ratio)
    return rows.filter(hit).groupBy(*key).agg(F.max(F.to_date("ts")).alias("day"))


def bucket_medians(points: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """key, bucket, price, n: upper median of the prices of each span of seconds since the series' first point."""
    start = F.min("ts").over(Window.partitionBy(*key))
    rows = points.withColumn("bucket", F.floor((F.unix_micros("ts") - F.unix_micros(start)) / (seconds * 1_000_000)).cast("long"))
    sorted_ = F.array_sort(F.collect_list("price"))
    return rows.groupBy(*key, "bucket").agg(F.get(sorted_, F.floor(F.count("*") / 2).cast("int")).alias("price"), F.count("*").alias("n"))


def slope_projection(points: DataFrame, key: list[str], order: list[str], horizon: int, floor: int = 1) -> DataFrame:
    """key, step, price: last price plus the least-squares slope per observation, no less than floor."""
    rows = points.withColumn("_i", F.row_number().over(ordered(key, order)))
    whole = lambda c: c.cast("decimal(18,0)")
    x, y = whole(F.col("_i")), whole(F.col("price"))
    sums = rows.groupBy(*key).agg(F.max_by("price", "_i").alias("_p"), whole(F.count("*")).alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx")).filter("_n >= 2")
    fit = sums.select(*key, "_p", (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")).alias("_rise"), (F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")).alias("_run"))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    # in whole numbers, so that a half cent rounds up whatever the order of the sums
    cents = F.expr("cast((200 * (_p * _run + _rise * step) + _run) div (2 * _run) as long)")
    return steps.select(*key, "step", (F.greatest(F.lit(100 * floor).cast("long"), cents).cast("double") / 100).alias("price"))
