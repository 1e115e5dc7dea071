"""Streams over several batches: states that end, replays, and what a batch writes."""

import datetime
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tallystone.operators import events as E
from tallystone.streaming import flows

DAY = datetime.datetime(2024, 1, 1)


def source(spark, batches, schema):
    """A stream that reads one file of rows after the other."""
    folder = tempfile.mkdtemp(prefix="stream-")
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    like = spark.createDataFrame([], schema)
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder), folder


def run(stream, work):
    with flows.rocks_db(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/state").option("path", f"{work}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def test_throttled_state_ends_with_the_cooldown_and_a_replay_sends_the_same(spark):
    at = lambda d, h=0: DAY + datetime.timedelta(days=d, hours=h)
    batches = [[(1, at(0), 100), (2, at(0), 50), (1, at(0, 1), 120), *((k, at(0), 1) for k in range(10, 20))], [(1, at(1), 90), (2, at(1), 60)], [(3, at(20), 5)], [(1, at(21), 95), (3, at(21), 7)]]
    want = [(1, at(0), 100), (1, at(1), 90), (1, at(21), 95), (2, at(0), 50), (3, at(20), 5), *((k, at(0), 1) for k in range(10, 20))]
    for _ in range(2):
        s, _ = source(spark, batches, "k long, ts timestamp, price long")
        work = tempfile.mkdtemp(prefix="work-")
        q = run(flows.throttled(s, ["k"], days=5), work)
        got = spark.read.parquet(f"{work}/out").orderBy("k", "ts").collect()
        assert [tuple(r) for r in got] == want
        held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
        assert max(held) >= 12 and held[-1] <= 2  # all but the keys of the last days went when the watermark was past their cooldown


def test_laps_and_kept_points_are_those_of_the_batch(spark):
    rows = [(k, DAY + datetime.timedelta(hours=h, minutes=k), h * 10 + k, (h * 7 + k) % 4, h % 2) for h in range(0, 60) for k in (1, 2)]
    schema = "k long, ts timestamp, n long, price long, store long"
    batches = [[r for r in rows if r[1] < DAY + datetime.timedelta(hours=cut) and r[1] >= DAY + datetime.timedelta(hours=cut - 13)] for cut in (13, 26, 39, 52, 65)] + [[(9, DAY + datetime.timedelta(days=30), 0, 0, 0)]]
    s, _ = source(spark, batches, schema)
    work = tempfile.mkdtemp(prefix="work-")
    run(flows.closed_laps(s, ["k"], ["ts", "n"], F.floor(F.hour("ts") / 8)), work)
    df = spark.createDataFrame(rows, schema)
    want = E.lap_samples(df, ["k"], ["ts", "n"], F.floor(F.hour("ts") / 8).cast("int")).select("k", "day", "lap", "price")
    assert sorted(map(tuple, spark.read.parquet(f"{work}/out").filter("k != 9").collect())) == sorted(map(tuple, want.collect()))
    s, _ = source(spark, batches, schema)
    work = tempfile.mkdtemp(prefix="work-")
    run(flows.kept_points(s, ["k"], ["ts", "n"], ["price", "store"]), work)
    want = E.appended(df.withColumn("price_normal", F.lit(0)), ["k"], ["ts", "n"]).select("k", "ts", "n")
    assert sorted(map(tuple, spark.read.parquet(f"{work}/out").filter("k != 9").select("k", "ts", "n").collect())) == sorted(map(tuple, want.collect()))


def test_a_snapshot_batch_writes_only_the_buckets_of_its_keys(spark):
    path = tempfile.mkdtemp(prefix="snap-")
    schema = "k long, ts long, v string"
    all_ = spark.createDataFrame([(k, 0, "a") for k in range(400)], schema)
    flows.write_snapshot(all_, path, ["k"], ["ts"], 0, None, buckets=16)
    few = spark.createDataFrame([(5, 1, "b"), (5, 2, "c"), (1000, 1, "new"), (6, -1, "old")], schema)
    for _ in range(2):  # a repeated batch writes the same
        flows.write_snapshot(few, path, ["k"], ["ts"], 1, 0, buckets=16)
    got = {r.k: r.v for r in flows.read_snapshot(spark, path, all_.schema, 1).collect()}
    assert got == {k: "a" for k in range(400)} | {5: "c", 1000: "new"}
    assert {r.k: r.v for r in flows.read_snapshot(spark, path, all_.schema, 0).collect()} == {k: "a" for k in range(400)}
    written = lambda v: {d for d in os.listdir(f"{path}/data/v={v}") if d.startswith("bucket=")}
    assert len(written(0)) == 16 and len(written(1)) <= 3
    assert len(pd.concat([pd.read_parquet(f"{path}/data/v=1/{b}") for b in written(1)])) < 120
