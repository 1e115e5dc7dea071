"""Column builders on numbers and moments: money texts, discounts, calendar of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Santiago"
# First and last month and day of the yearly sales windows.
EVENTS = [("05-20", "06-10", "CyberDay"), ("09-25", "10-10", "CyberMonday"), ("11-20", "12-02", "Black Friday")]


def digits(c: Column) -> Column:
    """Digits of a text as a number, null without any."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("long")


def money(c: Column) -> Column:
    """An amount from 1549990.000000 or $1.549.990; nothing for 0."""
    t = F.trim(c)
    amount = F.when(t.rlike(r"^[0-9]+\.[0-9]+$") & ~t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.round(t.try_cast("double")).cast("long")).otherwise(digits(t))
    return F.when(amount > 0, amount)


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def signed_int(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9-]", "").try_cast("long")


def sane_discount(declared: Column, normal: Column, current: Column) -> Column:
    """The declared percentage if it is within 20 of the computed one, else the computed one."""
    real = F.when((normal > current) & (current > 0), F.round((normal - current) * 100 / normal).cast("long"))
    said = F.abs(declared)
    return F.when((said > 0) & (said < 100) & (real.isNull() | (F.abs(said - real) <= 20)), said).otherwise(real)


def discount_insight(price: Column, normal: Column, least_normal: Column) -> Column:
    """Struct percent, amount, signal (strong, ok, usual) of a price under its list price."""
    amount = F.when((price > 0) & (normal > price), normal - price)
    percent = F.bround(amount * 100 / normal).cast("long")
    strong = (percent >= 35) | F.coalesce((least_normal > 0) & (price <= F.floor(least_normal * 0.9)), F.lit(False))
    return F.struct(percent.alias("percent"), amount.alias("amount"), F.when(amount.isNull(), F.lit(None)).when(strong, "strong").when(percent < 10, "usual").otherwise("ok").alias("signal"))


def event_label(ts: Column, zone: str = ZONE) -> Column:
    day = F.date_format(F.from_utc_timestamp(ts, zone), "MM-dd")
    out = None
    for a, b, name in EVENTS:
        out = F.when(day.between(a, b), name) if out is None else out.when(day.between(a, b), name)
    return out


def day_bounds(day: Column, zone: str = ZONE) -> Column:
    """Struct start, end: a local day's moments in UTC."""
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return F.struct(start(day).alias("start"), start(F.date_add(day, 1)).alias("end"))


def seconds_to_midnight(ts: Column, zone: str = ZONE) -> Column:
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    return F.unix_timestamp(day_bounds(day, zone)["end"]) - F.unix_timestamp(ts)


def tier(role: Column, paid_until: Column, now: Column) -> Column:
    return F.when(role == "admin", "admin").when(paid_until >= now, "paid").otherwise("user")
