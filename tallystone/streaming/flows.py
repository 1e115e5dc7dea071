"""Streams: daily counters, duplicates, throttled changes, laps, kept points and keyed snapshots, on Structured Streaming.

Keyed states live in RocksDB and end by timers in event time: a state goes once
no row that the watermark still lets in could be judged otherwise for its loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ZONE = "America/Santiago"


def files(spark: SparkSession, folder: str, name: str, per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files called name below a folder; the schema is that of the files there now."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder)


def daily_counters(stream: DataFrame, by: list[str], lateness: str = "2 days", zone: str = ZONE) -> DataFrame:
    """day, by, n, by local day; rows later than lateness are dropped, and with them the state of days that old."""
    local = stream.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)).withWatermark("ts", lateness)
    return local.groupBy(F.window("ts", "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def first_seen(stream: DataFrame, key: list[str], lateness: str = "30 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(key)


def _millis(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


class _UntilTimer(StatefulProcessor):
    """A value per key that a timer ends; one timer a key."""

    def __init__(self, state: str):
        self.schema = state

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def last(self):
        return self.value.get() if self.value.exists() else None

    def keep(self, value: tuple, until: int) -> None:
        self.value.update(value)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Throttle(_UntilTimer):
    def __init__(self, names: list[str], days: int):
        super().__init__("at long, price long")
        self.names, self.wait = names, days * 86_400_000_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "price"], kind="stable")
        at, price = self.last() or (None, None)
        sent = []
        for ts, p in zip(table["ts"], table["price"]):
            now = ts.value // 1000
            if at is None or now >= at + self.wait or p < price:
                at, price = now, int(p)
                sent.append((*key, ts, int(p)))
        # from then on a change is sent whatever the last send was
        self.keep((at, price), -(-(at + self.wait) // 1000))
        yield pd.DataFrame(sent, columns=[*self.names, "ts", "price"])


def throttled(stream: DataFrame, key: list[str], days: int = 5, lateness: str = "1 hour") -> DataFrame:
    """Changes (key, ts, price) that are sent: never sent before, days since the last one, or cheaper than it.

    The last send of a key is its state, until the watermark is ``days`` past it. Rows
    later than lateness are dropped.
    """
    rows = stream.select(*(F.col(k).cast("long").alias(k) for k in key), F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("long").alias("price")).withWatermark("ts", lateness)
    schema = ", ".join(f"{k} long" for k in key) + ", ts timestamp, price long"
    return rows.groupBy(*key).transformWithStateInPandas(_Throttle(key, days), schema, "append", "eventTime")


def subscribed(stream: DataFrame, subscriptions: DataFrame, on: list[str], least: str | None = None) -> DataFrame:
    """Changes once for each subscriber of their product; ``least``: a subscription's column of a highest price, null for any."""
    x = stream.join(subscriptions, on)
    return x if least is None else x.filter(F.col(least).isNull() | (F.col("price") <= F.col(least))).drop(least)


class _Lap(_UntilTimer):
    def __init__(self, columns: list[str], order: list[str], ends: int):
        super().__init__("at string, price long")
        self.columns, self.order, self.ends = columns, order, ends

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values(self.order, kind="stable").iloc[-1]
        # instants and numbers of fixed width compare as text
        at = "|".join(f"{_millis(v):020d}" if isinstance(v, pd.Timestamp) else f"{int(v):020d}" for v in last[self.order])
        have = self.last()
        if have is None or at >= have[0]:
            self.keep((at, int(last["price"])), _millis(pd.Timestamp(key[-2])) + self.ends)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        price = self.last()[1]
        self.value.clear()
        yield pd.DataFrame([(*key, price)], columns=self.columns)


def closed_laps(stream: DataFrame, by: list[str], order: list[str], lap, lateness: str = "1 hour") -> DataFrame:
    """by, day, lap, price: the last price of each lap of a day, once the watermark has left the day.

    order: ts first, then whole numbers. lap: the lap of a row, a whole number.
    """
    rows = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "day": F.to_date("ts"), "lap": lap.cast("int")}).withWatermark("ts", lateness)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "day", "lap"]) + ", price long"
    return rows.select(*by, "day", "lap", *order, "price").groupBy(*by, "day", "lap").transformWithStateInPandas(_Lap([*by, "day", "lap", "price"], order, 86_400_000), schema, "append", "eventTime")


class _Kept(_UntilTimer):
    def __init__(self, columns: list[str], values: list[str], order: list[str]):
        super().__init__("seen string")
        self.columns, self.values, self.order = columns, values, order

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        seen = table[self.values].astype(object).where(table[self.values].notna(), None).apply(lambda r: repr(tuple(r)), axis=1)
        have = self.last()
        before = seen.shift()
        before.iloc[0] = have[0] if have else None
        self.keep((seen.iloc[-1],), _millis(pd.Timestamp(key[-1])) + 2 * 86_400_000)
        yield table[(seen != before).to_numpy()][self.columns]


def kept_points(stream: DataFrame, by: list[str], order: list[str], values: list[str], lateness: str = "1 hour", zone: str = ZONE) -> DataFrame:
    """Rows that a history keeps as they come: the first of a key's local day, and those whose values differ from the row before.

    Only the last values of a key's day are state, until the day is over in any zone.
    """
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = rows.withColumn("day", F.to_date(F.from_utc_timestamp("ts", zone))).select(*by, "day", *dict.fromkeys([*order, *values]))
    return rows.groupBy(*by, "day").transformWithStateInPandas(_Kept(rows.columns, values, order), rows.schema, "append", "eventTime")


def run_updates(stream: DataFrame, path: str, checkpoint: str, key: list[str], value: str) -> DataFrame:
    """All that is there of an aggregated stream in update mode: each batch's changed rows as a version of their own, which a repeated batch writes again; returns the newest value of each key."""

    def each(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={version}")

    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    return rows.groupBy(*key).agg(F.max_by(value, "v").alias(value))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket -> the version that wrote it last; as many rows as there are buckets."""
    return {r.bucket: r.written for r in spark.read.schema("bucket int, written long").parquet(f"{path}/manifest/v={version}").collect()}


def write_snapshot(batch: DataFrame, path: str, key: list[str], order: list[str], version: int, before: int | None, buckets: int = 64) -> None:
    """One micro-batch into the snapshot below path: the latest row of each key, as a new version on top of the version before.

    Keys are dealt into buckets by a hash. A batch reads and writes only the buckets
    that it has keys of; a manifest names the version that holds each bucket, and is
    written last, so an unfinished version is never read. A repeated batch writes the
    same version again.
    """
    spark = batch.sparkSession
    dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    held = {} if before is None else _manifest(spark, path, before)
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
    old = _buckets(spark, path, batch.schema, {b: held[b] for b in touched if b in held})
    rows = dealt if old is None else old.unionByName(dealt)
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("bucket", *key).orderBy(*(F.col(c).desc_nulls_last() for c in order)))).filter("_n = 1").drop("_n")
    latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    now = held | dict.fromkeys(touched, version)
    spark.createDataFrame(list(now.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")


def _buckets(spark: SparkSession, path: str, schema, held: dict[int, int]) -> DataFrame | None:
    """Rows of the buckets, each as the version wrote it that holds it."""
    if not held:
        return None
    folders = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders).withColumn("bucket", F.regexp_extract(F.input_file_name(), "/bucket=([0-9]+)/", 1).cast("int"))


def read_snapshot(spark: SparkSession, path: str, schema, version: int) -> DataFrame:
    """The whole snapshot as of a version."""
    rows = _buckets(spark, path, schema, _manifest(spark, path, version))
    return spark.createDataFrame([], schema) if rows is None else rows.drop("bucket")


def run_snapshot(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """All that is there of a stream into a snapshot; returns its last version."""
    last: list[int] = []

    def each(batch: DataFrame, version: int) -> None:
        write_snapshot(batch, path, key, order, version, last[-1] if last else version - 1 if version else None, buckets)
        last.append(version)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return read_snapshot(spark, path, stream.schema, last[-1]) if last else spark.createDataFrame([], stream.schema)


#: The store of states that timers need.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession):
    """Streams started inside keep their states in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_append(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there of a stream into Parquet files; returns them."""
    with rocks_db(stream.sparkSession):
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
