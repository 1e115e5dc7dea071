"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

n-grams of characters are hashed into buckets. A document is the set of its
buckets. On a bounded sample of labelled documents the log-count ratio of every
bucket is taken; buckets whose ratio is large enough are features, with the
ratio as their value; a logistic regression over them gives the score. The
model is one array of weights by bucket, so a text of any length is scored in
one pass over its characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, mix
from .labels import training_sample

ORDERS = (3, 4, 5)
BITS = 20
#: Documents a class in the training sample, of any length.
PER_CLASS = 2500
#: Least documents with a feature, least absolute log-count ratio.
LEAST_DOCS, LEAST_RATIO = 4, 1.0
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(0x10000)], np.uint32)


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of rows of UTF-8, a space before and after each, and their offsets."""
    lead = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])[off]
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(off) - 1
    out = np.full(len(code) + 2 * n, 0x20, np.uint32)
    at = np.arange(len(code)) + np.repeat(2 * np.arange(n) + 1, np.diff(count))
    out[at] = np.where(code < 0x10000, _LOWER[np.minimum(code, 0xFFFF)], code)
    return out, count + 2 * np.arange(n + 1)


def ngram_buckets(code: np.ndarray, off: np.ndarray):
    """For each order: positions' rows and buckets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    h = np.zeros(len(code), np.uint64)
    for k in range(max(ORDERS)):
        h = (h[: len(code) - k] if k else h) * np.uint64(0x100000001B3) + code[k:] + np.uint64(1)
        if k + 1 in ORDERS:
            same = row[: len(h)] == row[k:]
            bucket = (mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
            yield row[: len(h)][same], bucket[same]


def document_buckets(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct n-grams of each row; wanted: only buckets marked in it."""
    code, at = characters(data, off)
    keys = []
    for row, bucket in ngram_buckets(code, at):
        if wanted is not None:
            keep = wanted[bucket]
            row, bucket = row[keep], bucket[keep]
        keys.append(row.astype(np.int64) << BITS | bucket)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def bucket_counts(sample: DataFrame) -> DataFrame:
    """bucket, toxic, clean: documents of each class that have it."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy()
            data, off = buffers(batch.column(0))
            for a, b in blocks(off):
                row, bucket = document_buckets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[label[a:b][row] == k], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[1][at].astype(np.int64)), pa.array(counts[0][at].astype(np.int64))], names=["bucket", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(sample: DataFrame, rounds: int = 200, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by bucket (ratio times coefficient) and bias. sample: text, label, of bounded size.

    Without both classes every score is the share of toxic rows (0 without rows).
    """
    n = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << BITS, np.float32)
    if len(n) < 2:
        return weights, 30.0 if n.get(1) else -30.0
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    chosen = bucket_counts(sample).withColumn("ratio", ratio).filter((F.col("toxic") + F.col("clean") >= LEAST_DOCS) & (F.abs("ratio") >= LEAST_RATIO)).select("bucket", "ratio").toArrow()
    bucket, value = chosen["bucket"].to_numpy(), chosen["ratio"].to_numpy()
    order = np.argsort(bucket)
    bucket, value = bucket[order], value[order]
    wanted = np.zeros(1 << BITS, bool)
    wanted[bucket] = True
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            for a, b in blocks(off):
                row, found = document_buckets(data[off[a] : off[b]], off[a : b + 1] - off[a], shared.value)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                rows = [found[ends[i] : ends[i + 1]].astype("<u4").tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(rows, pa.binary())], names=["label", "doc_id", "buckets"])

    got = sample.select("text", F.col("label").cast("int").alias("label"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "label int, doc_id long, buckets binary").orderBy("doc_id").toArrow()
    label = got["label"].to_numpy().astype(np.float64)
    rows = [np.searchsorted(bucket, np.frombuffer(x, "<u4")) for x in got["buckets"].to_pylist()]
    column = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    coefficient, bias = logistic(row, column, value[column], label, len(bucket), rounds, penalty)
    weights[bucket] = (coefficient * value).astype(np.float32)
    return weights, bias


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, n: int, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean log loss with an L2 penalty; deterministic."""
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], len(label)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        d = (p - label) / len(label)
        g = np.concatenate([np.bincount(column, value * d[row], n) + penalty * w, [d.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text, between 0 and 1; null text counts as empty. A column of that name is replaced."""
    out = docs.withColumn(name, F.lit(0.0).cast("double"))
    names, schema = out.columns, out.schema
    shared = docs.sparkSession.sparkContext.broadcast((weights, weights != 0, bias))

    def run(batches):
        weights, wanted, bias = shared.value
        for batch in batches:
            data, off = buffers(batch.column(names.index(text)))
            z = np.full(batch.num_rows, bias)
            for a, b in blocks(off):
                row, bucket = document_buckets(data[off[a] : off[b]], off[a : b + 1] - off[a], wanted)
                z[a:b] += np.bincount(row, weights[bucket], b - a)
            columns = list(batch.columns)
            columns[names.index(name)] = pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. held_out: condition on doc_id; labels of such rows are never used.

    Null and empty texts are scored as texts without features. Rows that repeat a
    doc_id, also with another text, and rows with a null one are scored each by
    its own text; equal texts have equal scores. A text of any length is one row
    of an Arrow batch and is scored in one piece, at some 60 bytes a character. An
    empty table of documents gives an empty result; without labels every score
    is 0. Other columns are not read.
    """
    sample = training_sample(docs, labels, "toxic", ~held_out, per_class)
    weights, bias = fit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return score(rows, weights, bias).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
