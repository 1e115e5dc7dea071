"""Helpers that several operators share: text buffers, hashes, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

#: Bytes of text that numpy handles at once inside a task.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Only where that setting is empty in a local session, as in tests, a temporary
    folder is made and set as the checkpoint folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            current = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(current)
        root = current
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = shared_dir(spark) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Jobs run inside hand Python this many rows at once at most, so that long texts stay small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, with underscores before it until no column is called so."""
    while wanted.lower() in {c.lower() for c in taken}:
        wanted = "_" + wanted
    return wanted


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    off = off - off[0]
    if column.null_count:  # Arrow gives null rows no bytes, though other writers may
        lengths = np.diff(off)
        null = column.is_null().to_numpy(zero_copy_only=False)
        if lengths[null].any():
            raw = raw[np.repeat(~null, lengths)]
            off = np.concatenate([[0], np.cumsum(np.where(null, 0, lengths))])
    return raw, off


def blocks(off: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of rows whose bytes come to about ``most``; a longer row is a range of its own."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= BLOCK_BYTES + 1:
            _POWERS[name] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the whole buffer."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _MULT, n), out=total[1:])
    h = (total[end] - total[start]) * _powers("down", _INV, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * _MIX1)


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and the number of words before each row.

    is_word: 256 booleans. A run ends where its row ends.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    mask = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:n]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:] | edge[1:n]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(start, off)


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: [^\x20\x09-\x0D]+ : every byte of a multi-byte character is 0x80 or more, so bytes decide as code points do.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs_combined(h: np.ndarray, k: int) -> np.ndarray:
    """An order-dependent hash of every k consecutive values: result[i] covers h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _MULT + h[j : j + n]
    return mix(out + np.uint64(k))


def windows_of_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Positions i such that values i..i+k-1 belong to one row; first: number of values before each row (and the total)."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, np.int64)
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(total)
    return at[at + k <= row_end]


#: Bits of a key filter: 4 MB, one false answer in 50 up to some four million keys.
FILTER_BITS = 25
_FILTER_HASHES = 4


def _filter_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.astype(np.int64).view(np.uint64)
    return np.stack([mix(k * np.uint64(2 * j + 1) + np.uint64(j)) >> np.uint64(64 - bits) for j in range(_FILTER_HASHES)])


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of a long column, of fixed size whatever the number of keys.

    It only spares a shuffle: what passes it meets the keys themselves in a join.
    The words of the filter are combined in Spark, so at most 2^bits / 64 rows
    come to the driver.
    """

    def run(batches):
        for batch in batches:
            at = np.unique(_filter_positions(batch.column(0).to_numpy(), bits).reshape(-1))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    got = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((1 << bits) >> 6, np.uint64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out


def may_have(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    bits = (len(filter_) << 6).bit_length() - 1
    at = _filter_positions(keys, bits)
    return ((filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)
