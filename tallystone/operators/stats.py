"""Statistics of a product's prices: windows, verdicts, timing advice, profiles, patterns, inflation of list prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.storage import stored

from . import series as S


def days_before(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {days} DAYS")


def verdict_level(fake: Column, lowest: Column, percent: Column) -> Column:
    """fake, great, good, high or normal, in this order of precedence; unknown without a reference."""
    return F.when(percent.isNull(), "unknown").when(fake, "fake").when(lowest | (percent <= -10), "great").when(percent <= -2, "good").when(percent >= 5, "high").otherwise("normal")


def price_stats(points: DataFrame, key: list[str], order: list[str], now: Column, windows: tuple[int, ...] = (7, 30, 90), baseline_days: int = 90, recent: int = 7) -> DataFrame:
    """One row a product: count, min, max and median of each window (of all where it is empty), points, low and high of all, current and previous price, baseline, percent_vs_median, lowest, fake, level.

    The history is shuffled and sorted once: all is windows over a key, of which the last row is taken.
    """
    p, all_ = Window.partitionBy(*key), S.whole(key, order)
    price = F.col("price")
    x = points.withColumns({"current": F.last("price").over(all_), "_last": S.is_last(key, order)})
    x = x.withColumn("previous", F.last(F.when(price != F.col("current"), price), ignorenulls=True).over(all_))
    sums = {"points": F.count("*"), "_count": F.count("price"), "low": F.min("price"), "high": F.max("price"), "_median": F.median("price")}
    for d in windows:
        in_ = F.when(F.col("ts") >= days_before(now, d), price)
        sums |= {f"_rows_{d}": F.count(F.when(F.col("ts") >= days_before(now, d), 1)), f"_count_{d}": F.count(in_), f"_min_{d}": F.min(in_), f"_max_{d}": F.max(in_), f"_median_{d}": F.median(in_)}
    sums |= S.baseline_sums(now, baseline_days, recent, F.col("_last"))
    x = x.withColumns({name: c.over(p) for name, c in sums.items()}).filter("_last").withColumn("baseline", S.baseline_of_sums())
    pick = lambda name, d, of_all: F.when(F.col(f"_rows_{d}") > 0, F.col(f"_{name}_{d}")).otherwise(F.col(of_all))
    summaries = [c for d in windows for c in (pick("count", d, "_count").alias(f"count_{d}"), pick("min", d, "low").alias(f"min_{d}"), pick("max", d, "high").alias(f"max_{d}"), S.round_even(pick("median", d, "_median")).alias(f"median_{d}"))]
    out = x.select(*key, "current", "points", "low", "high", *summaries, "previous", "baseline")
    median = F.col(f"median_{windows[-1]}")
    out = out.withColumn("percent_vs_median", F.when(median > 0, F.round((F.col("current") - median) * 100 / median, 1)))
    out = out.withColumn("lowest", (F.col("current") <= F.col("low")) & (F.col("points") >= 3)).withColumn("fake", S.fake_discount(F.col("current"), F.col("previous"), F.col("baseline")))
    return out.withColumn("level", verdict_level(F.col("fake"), F.col("lowest"), F.col("percent_vs_median")))


def timing(points: DataFrame, key: list[str], order: list[str], now: Column, kept: Column, tracked: int = 14, near_low: int = 10, half_year: int = 180) -> DataFrame:
    """The last point of each key, kept or not, with what the n kept ones (they have a price) say: how often and how far it drops, where today's price is in its range, and the advice. One shuffle and sort."""
    p, w, all_ = Window.partitionBy(*key), S.ordered(key, order), S.whole(key, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = points.withColumn("_k", kept).withColumn("_price", F.when(F.col("_k"), F.col("price")))
    x = x.withColumns({"_b": F.last("_price", ignorenulls=True).over(before), "current": F.last("_price", ignorenulls=True).over(all_), "_last": S.is_last(key, order)})
    x = x.withColumn("_drop", F.coalesce(F.col("_b") > F.col("_price"), F.lit(False)))
    x = x.withColumn("_percent", F.when(F.col("_drop"), F.round((F.col("_b") - F.col("price")) * 100 / F.col("_b"), 1)))
    fell = F.when(F.col("_drop"), F.col("ts"))
    x = x.withColumn("_prev_drop", F.last(fell, ignorenulls=True).over(before))
    x = x.withColumn("_gap", F.when(F.col("_drop"), S.periods(F.col("ts"), F.col("_prev_drop"))))
    sums = {
        "n": F.count(F.when(F.col("_k"), 1)),
        "low": F.min("_price"),
        "high": F.max("_price"),
        "_first": F.min(F.when(F.col("_k"), F.col("ts"))),
        "drops": F.count("_percent"),
        "_typical": F.median("_percent"),
        "_fell": F.max(fell),
        "_between": F.median("_gap"),
        "_recent_low": F.min(F.when(F.col("ts") >= days_before(now, half_year), F.col("_price"))),
    }
    a = x.withColumns({name: c.over(p) for name, c in sums.items()}).filter("_last")
    a = a.withColumns({"days_tracked": S.periods(now, F.col("_first")), "typical_drop_percent": F.round(F.round("_typical", 2), 1), "days_since_last_drop": S.periods(now, F.col("_fell")), "typical_days_between_drops": S.round_even(F.col("_between"))})
    a = a.withColumn("ready", (F.col("n") >= 2) & (F.col("days_tracked") >= tracked))
    span = F.col("high") - F.col("low")
    position = F.when(span == 0, F.lit(0).cast("long")).otherwise(S.round_even((F.col("current") - F.col("low")) * 100 / F.when(span == 0, F.lit(None)).otherwise(span)))
    near = (F.col("low") > 0) & ((F.col("current") - F.col("low")) * 100 / F.col("low") <= near_low)
    advice = (
        F.when(~F.col("ready"), "no_data")
        .when(near, "buy")
        .when(F.col("current") <= F.col("_recent_low"), "buy")
        .when((F.col("typical_days_between_drops") > 0) & (F.col("days_since_last_drop") < F.col("typical_days_between_drops")), "wait")
        .when(position >= 60, "wait")
        .otherwise("undecided")
    )
    out = a.withColumn("position_percent", F.when(F.col("ready"), position)).withColumn("advice", advice)
    return out.drop("_k", "_price", "_b", "_last", "_drop", "_percent", "_prev_drop", "_gap", "_first", "_typical", "_fell", "_between", "_recent_low")


def buy_or_wait(points: DataFrame, key: list[str], order: list[str], now: Column, tracked: int = 14, near_low: int = 10, half_year: int = 180) -> DataFrame:
    """One row a product: how often and how far it drops, where today's price is in its range, and the advice."""
    out = timing(points, key, order, now, F.lit(True), tracked, near_low, half_year)
    return out.select(*key, "current", "low", "days_tracked", "drops", "typical_drop_percent", "days_since_last_drop", "typical_days_between_drops", "ready", "position_percent", "advice")


def blocked_by_cheaper(advice: Column, cheaper: Column) -> Column:
    """No advice to buy where another store is cheaper."""
    return F.when((advice == "buy") & (cheaper > 0), "wait").otherwise(advice)


def last_with_history(points: DataFrame, key: list[str], order: list[str], kept: Column, most: int = 30, ratio: float = 0.95) -> DataFrame:
    """The last point of each key, kept or not, with what the kept ones say: verified_discount, points (how many) and was_full (S.full_price_day has a day). One shuffle and sort."""
    p, all_ = Window.partitionBy(*key), S.whole(key, order)
    x = points.withColumn("_k", kept)
    x = x.withColumns({"_now": F.last(F.when(F.col("_k"), F.struct("price", "price_normal", "ts")), ignorenulls=True).over(all_), "_last": S.is_last(key, order)})
    x = x.withColumn("_other", F.coalesce(F.col("_k") & (F.col("price") != F.col("_now.price")), F.lit(False)))
    x = x.withColumn("_place", F.count(F.when(F.col("_other"), 1)).over(all_.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = F.col("_other") & (F.to_date("ts") != F.to_date("_now.ts")) & (F.col("price") >= F.col("_now.price_normal") * ratio)
    x = x.withColumns({"_others": F.count(F.when(F.col("_other"), 1)).over(p), "points": F.count(F.when(F.col("_k"), 1)).over(p), "was_full": F.coalesce(F.max(full).over(p), F.lit(False))})
    x = x.withColumn("_m", F.median(F.when(F.col("_other") & (F.col("_others") - F.col("_place") < most), F.col("price"))).over(p)).filter("_last")
    current = F.col("_now.price")
    value = F.when((F.least(F.col("_others"), F.lit(most)) >= 2) & (F.col("_m") > current), F.round((F.col("_m") - current) * 100 / F.col("_m"), 1)).otherwise(F.lit(0.0).cast("double"))
    return x.withColumn("verified_discount", value).drop("_k", "_now", "_last", "_other", "_place", "_others", "_m")


def verified_discount(points: DataFrame, key: list[str], order: list[str], most: int = 30) -> DataFrame:
    """key, verified_discount: percent below the median of the last prices that differ from the current one; 0 with fewer than two."""
    return last_with_history(points, key, order, F.lit(True), most).select(*key, "verified_discount")


def price_profile(daily: DataFrame, key: list[str], now_day: Column, recent: int = 90, changes: int = 30) -> DataFrame:
    """One row a product from its daily prices (key, day, price): observations, span, changes, volatility, unchanged days, last price."""
    return profile_with_day(daily, key, now_day, recent, changes).drop("last_day")


def profile_with_day(daily: DataFrame, key: list[str], now_day: Column, recent: int = 90, changes: int = 30) -> DataFrame:
    """price_profile with last_day."""
    w, p = Window.partitionBy(*key).orderBy("day"), Window.partitionBy(*key)
    rows = daily.withColumns({"_n": F.row_number().over(w), "_lag": F.lag("price").over(w), "_current": F.last("price").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.withColumns({"_turn": F.max(F.when(F.col("price") != F.col("_current"), F.col("day"))).over(p), "_back": F.count("*").over(p) - F.col("_n") + 1})
    last = F.when(F.col("_back") <= recent, F.col("price"))
    return rows.groupBy(*key).agg(
        F.count("*").alias("observations"),
        (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("history_days"),
        F.sum(F.when((F.col("_back") <= changes) & (F.col("price") != F.col("_lag")), 1).otherwise(0)).alias("changes"),
        F.round(F.coalesce(F.when(F.count(last) >= 2, F.stddev_pop(last) / F.avg(last)), F.lit(0.0)), 4).alias("volatility"),
        F.datediff(now_day, F.min(F.when(F.col("_turn").isNull() | (F.col("day") > F.col("_turn")), F.col("day")))).cast("long").alias("unchanged_days"),
        F.max_by("price", "day").alias("last_price"),
        F.max("day").alias("last_day"),
    )


def group_low(daily: DataFrame, key: list[str], part: Column, least: int, below: float, min_rows: int) -> DataFrame:
    """key, part, difference, samples: the part (weekday, month) with the lowest median, if it is ``below`` percent or more under the product's median."""
    whole = daily.groupBy(*key).agg(F.median("price").alias("_m"), F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    parts = daily.withColumn("part", part).groupBy(*key, "part").agg(F.median("price").alias("_p"), F.count("*").alias("samples")).filter(F.col("samples") >= least)
    first = parts.groupBy(*key).agg(F.min_by(F.struct("part", "_p", "samples"), F.struct("_p", "part")).alias("s")).select(*key, "s.*")
    out = first.join(whole, key).withColumn("difference", (F.col("_p") - F.col("_m")) * 100 / F.col("_m")).filter(F.col("difference") <= -below)
    return out.select(*key, "part", F.round("difference", 1).alias("difference"), "samples")


def span_shift(daily: DataFrame, key: list[str], inside: Column, outside: Column, least_in: int, least_out: int, shift: float) -> DataFrame:
    """key, difference, samples: median inside against outside, where it is lower by -shift percent or (shift > 0) higher."""
    agg = daily.groupBy(*key).agg(*(f(F.when(c, F.col("price"))).alias(n) for c, (f, n) in ((inside, (F.median, "_i")), (inside, (F.count, "samples")), (outside, (F.median, "_o")), (outside, (F.count, "_k")))))
    agg = agg.filter((F.col("samples") >= least_in) & (F.col("_k") >= least_out)).withColumn("difference", (F.col("_i") - F.col("_o")) * 100 / F.col("_o"))
    keep = F.col("difference") >= shift if shift > 0 else F.col("difference") <= shift
    return agg.filter(keep).select(*key, F.round("difference", 1).alias("difference"), "samples")


def price_patterns(daily: DataFrame, key: list[str], min_rows: int = 28, day_least: int = 4, month_least: int = 7, month_rows: int = 300, tech: Column | None = None, season: Column | None = None) -> DataFrame:
    """key, pattern, part, difference, samples: seasonal patterns that pass their sample sizes. daily may carry columns for tech and season; it is made once and stored."""
    enough = daily.withColumn("_rows", F.count("*").over(Window.partitionBy(*key))).filter(F.col("_rows") >= min_rows).drop("_rows")
    enough = stored(enough)
    d, m = F.dayofmonth("day"), F.month("day")
    event = ((m == 5) & (d >= 20)) | (m == 6) | ((m == 9) & (d >= 25)) | ((m == 10) & (d <= 10))
    found = [
        group_low(enough, key, F.weekday("day"), day_least, 5, min_rows).withColumn("pattern", F.lit("weekday_promotion")),
        group_low(enough, key, m, month_least, 7, month_rows).withColumn("pattern", F.lit("seasonal_low")),
        span_shift(enough, key, event, ~event, 5, 20, -7).withColumns({"part": F.lit(None).cast("int"), "pattern": F.lit("event_window")}),
        span_shift(enough, key, (m == 12) & (d <= 24), m.isin(9, 10, 11), 7, 14, 7).withColumns({"part": F.lit(None).cast("int"), "pattern": F.lit("pre_christmas_rise")}),
    ]
    if season is not None:
        found.append(span_shift(enough.filter(season), key, m.isin(3, 9), F.lit(True), 7, 1, -7).withColumns({"part": F.lit(None).cast("int"), "pattern": F.lit("season_end")}))
    if tech is not None:
        back = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("day").desc()))
        rows = enough.filter(tech).withColumn("_b", back).filter("_b <= 90")
        old = rows.filter("_b > 30").groupBy(*key).agg(F.median("price").alias("_old"), F.count("*").alias("_k")).filter("_k >= 60")
        new = rows.filter("_b <= 30").join(old, key).groupBy(*key, "_old").agg(F.median("price").alias("_new"), F.count("*").alias("samples"), F.avg((F.col("price") < F.col("_old")).cast("double")).alias("_below"))
        new = new.withColumn("difference", F.round((F.col("_new") - F.col("_old")) * 100 / F.col("_old"), 1)).filter("difference <= -8 and _below >= 0.7")
        found.append(new.select(*key, "difference", "samples").withColumns({"part": F.lit(None).cast("int"), "pattern": F.lit("technology_cycle")}))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*key, "pattern", "part", "difference", "samples")


def list_inflation(points: DataFrame, key: list[str], order: list[str], now: Column, window: int = 30, recent: int = 7, rise: float = 0.15, back: float = 0.05, current: DataFrame | None = None) -> DataFrame:
    """key, baseline_normal, inflated_normal, prior_selling, rise_percent, commercial_discount: list prices that rose while the selling price came back.

    points: price and price_normal history; current: key, price, price_normal, without it each key's last point.
    The history is shuffled and sorted once: all is windows over a key.
    """
    cut = days_before(now, recent)
    p, all_ = Window.partitionBy(*key), S.whole(key, order)
    running = S.ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if current is None:
        x = points.withColumns({"_price": F.last("price").over(all_), "_normal": F.last("price_normal").over(all_)})
    else:
        x = points.join(current.select(*key, F.col("price").alias("_price"), F.col("price_normal").alias("_normal")), key)
    x = x.filter("_price > 0 and _normal > _price")
    x = x.withColumns({"_listed": F.coalesce((F.col("price_normal") > 0) & (F.col("ts") >= days_before(now, window)), F.lit(False)), "_sells": F.coalesce((F.col("price") > 0) & (F.col("ts") < cut), F.lit(False))})
    x = x.withColumns({"_i": F.count(F.when(F.col("_listed"), 1)).over(running), "_s": F.count(F.when(F.col("_sells"), 1)).over(running), "_last": S.is_last(key, order)})
    # the current list price counts as one more, the last
    x = x.withColumns({"_n": F.count(F.when(F.col("_listed"), 1)).over(p) + 1, "_k": F.count(F.when(F.col("_sells"), 1)).over(p), "_old": F.max(F.col("_listed") & (F.col("ts") < cut)).over(p)}).filter("_n > 1")
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    x = x.withColumn("_older", F.when(F.col("_old"), F.col("ts") < cut).otherwise(F.col("_i") <= half))
    levels = {
        "baseline_normal": S.round_even(F.median(F.when(F.col("_listed") & F.col("_older"), F.col("price_normal"))).over(p)),
        "inflated_normal": F.greatest(F.max(F.when(F.col("_listed") & ~F.col("_older"), F.col("price_normal"))).over(p), F.col("_normal")),
        "_sold": S.round_even(F.median(F.when(F.col("_sells") & (F.col("_k") - F.col("_s") < 30), F.col("price"))).over(p)),
    }
    out = x.withColumns(levels).filter("_last").withColumn("prior_selling", F.coalesce("_sold", "baseline_normal"))
    near = lambda c: F.abs(F.col("_price") - F.col(c)) / F.greatest(F.col(c), F.lit(1)) <= back
    limit = F.col("baseline_normal") * (1 + rise)
    out = out.filter((F.col("baseline_normal") > 0) & (F.col("inflated_normal") >= limit) & (F.col("_normal") >= limit) & (near("prior_selling") | near("baseline_normal")))
    percent = lambda a, b: F.round((F.col(a) - F.col(b)) * 100 / F.col(b), 1)
    return out.select(*key, "baseline_normal", "inflated_normal", "prior_selling", percent("inflated_normal", "baseline_normal").alias("rise_percent"), F.round((F.col("_normal") - F.col("_price")) * 100 / F.col("_normal"), 1).alias("commercial_discount"))


def pre_event_rise(points: DataFrame, key: list[str], order: list[str], column: str, now: Column, look_back: int = 14, rise: float = 0.10) -> DataFrame:
    """key, baseline, peak, rise_percent: early prices of the span against their peak just before now."""
    early_end, end = days_before(now, look_back), days_before(now, 2)
    rows = points.filter((F.col(column) > 0) & (F.col("ts") >= days_before(now, look_back + 14)) & (F.col("ts") <= now))
    v = F.col(column)
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("_n"),
        F.coalesce(F.median(F.when(F.col("ts") < early_end, v)), F.min_by(v, F.struct(*order)).cast("double")).alias("_base"),
        F.max(F.when((F.col("ts") >= early_end) & (F.col("ts") <= end), v)).alias("peak"),
    )
    agg = agg.withColumn("baseline", S.round_even(F.col("_base"))).filter((F.col("_n") >= 2) & (F.col("baseline") > 0) & (F.col("peak") >= F.col("baseline") * (1 + rise)))
    return agg.select(*key, "baseline", "peak", F.round((F.col("peak") - F.col("baseline")) * 100 / F.col("baseline"), 1).alias("rise_percent"))
