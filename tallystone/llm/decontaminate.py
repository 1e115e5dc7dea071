"""Benchmark decontamination: windows of test words in a broadcast hash set, scanned over training words.

The benchmark is cut into blocks of bounded size; each block's windows are
broadcast and every document passes a few blocks one after the other in the same
task. With more blocks than that the documents are written between passes and
the broadcasts given back, so memory has a bound whatever the size of the
benchmark, and documents are never shuffled. A hash hit counts only after its
words were compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, blocks, buffers, free_name, lower_ascii, runs_combined, span_hashes, stored, windows_of_rows, word_spans

#: Bytes of benchmark text whose windows are broadcast at once (they take about ten times as much).
BROADCAST_TEXT_BYTES = 4 << 20
#: Blocks whose windows a task holds at the same time, some 40 MB each.
BLOCKS_AT_ONCE = 4
_FILTER_BITS = 22


class Windows:
    """Windows of one block of the benchmark, by number of words and hash."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.exact: dict[bytes, set[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        raw = [(t or "").encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = lower_ascii(np.frombuffer(b"".join(raw), np.uint8))
        start, end, first = word_spans(data, off, ALNUM)
        h = span_hashes(data, start, end)
        text = data.tobytes()
        for i, (item, _) in enumerate(items):
            a, b = int(first[i]), int(first[i + 1])
            k = min(size, b - a)
            if not k:
                continue
            hashes.setdefault(k, []).append(runs_combined(h[a:b], k))
            for p in range(a, b - k + 1):
                words = b" ".join(text[start[j] : end[j]] for j in range(p, p + k))
                self.exact.setdefault(words, set()).update([] if item is None else [item])
        self.by_length = {k: np.unique(np.concatenate(x)) for k, x in sorted(hashes.items())}
        self.filter = {}
        for k, x in self.by_length.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[x >> np.uint64(64 - _FILTER_BITS)] = True
            self.filter[k] = np.packbits(bits, bitorder="little")

    def hits(self, data: np.ndarray, off: np.ndarray):
        """Words of each row (their number before it), their starts and ends, and hits: (row, first word, end word, items)."""
        data = lower_ascii(data)
        start, end, first = word_spans(data, off, ALNUM)
        h = span_hashes(data, start, end)
        text, found = None, []
        for k, known in self.by_length.items():
            at = windows_of_rows(first, k)
            if not len(at):
                continue
            value = runs_combined(h, k)[at]
            slot = value >> np.uint64(64 - _FILTER_BITS)
            maybe = np.flatnonzero((self.filter[k][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            maybe = maybe[known[np.minimum(np.searchsorted(known, value[maybe]), len(known) - 1)] == value[maybe]]
            text = text or (data.tobytes() if len(maybe) else None)
            for p in at[maybe].tolist():
                items = self.exact.get(b" ".join(text[start[j] : end[j]] for j in range(p, p + k)))
                if items is not None:
                    found.append((int(np.searchsorted(first, p, "right")) - 1, p, p + k, items))
        return first, start, end, found


def _merged(spans: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Union of spans (first word, end word, first byte, end byte), ascending."""
    out: list[list[int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, y
        else:
            out.append([a, b, x, y])
    return out


_SPANS = "array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """docs with n_words, hit_spans (merged spans of hit words, in words and in bytes of the text) and hit_items, under these names.

    benchmark: item_id, text. A window is ``size`` consecutive words of an item, or
    all words of a shorter item. Null text has no words; a null item_id makes hits
    without a name. Columns of docs that are called as the new ones are replaced.
    Repeated rows and null doc_ids are scanned row by row; a text of any length is
    one row of an Arrow batch and is scanned whole. Empty tables of documents or of
    items give no hits.
    """
    n_words, hit_spans, hit_items = names
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BROADCAST_TEXT_BYTES))
    out = docs.withColumns({n_words: F.lit(0).cast("long"), hit_spans: F.lit(None).cast(_SPANS), hit_items: F.lit(None).cast("array<string>")})
    schema, names = out.schema, out.columns
    held = []
    for k in range(n):
        if len(held) == BLOCKS_AT_ONCE:
            out = stored(out)
            for windows in held:
                windows.destroy()
            held = []
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # of bounded size
        windows = spark.sparkContext.broadcast(Windows([(r[0], r[1]) for r in block], size))
        held.append(windows)

        def run(batches, windows=windows):
            table, kinds = windows.value, None
            for batch in batches:
                kinds = kinds or batch.schema
                data, off = buffers(batch.column(names.index(text)))
                for a, b in blocks(off):
                    part = batch.slice(a, b - a)
                    first, start, end, found = table.hits(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    spans, items = {}, {}
                    for row, p, q, which in found:
                        base = int(off[a + row] - off[a])
                        w = int(first[row])
                        spans.setdefault(row, []).append((p - w, q - w, int(start[p]) - base, int(end[q - 1]) - base))
                        items.setdefault(row, set()).update(which)
                    columns = list(part.columns)
                    columns[names.index(n_words)] = pa.array(np.diff(first), pa.int64())
                    if spans:
                        had, had_items = part.column(names.index(hit_spans)), part.column(names.index(hit_items))
                        rows, row_items = [], []
                        for i in range(b - a):
                            if i in spans:
                                old = [tuple(s.values()) for s in had[i].as_py() or []]
                                rows.append([dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s)) for s in _merged(old + spans[i])])
                                row_items.append(sorted(items[i] | set(had_items[i].as_py() or [])))
                            else:
                                rows.append(had[i].as_py())
                                row_items.append(had_items[i].as_py())
                        columns[names.index(hit_spans)] = pa.array(rows, kinds.field(hit_spans).type)
                        columns[names.index(hit_items)] = pa.array(row_items, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, size)
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    hit = F.aggregate(F.coalesce("hit_spans", F.array().cast(_SPANS)), F.lit(0).cast("long"), lambda n, s: n + s.end_word - s.first_word)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents") -> DataFrame:
    """docs, with their own columns, without what is in the benchmark.

    remove: "documents" leaves out every document with a hit; "spans" cuts the
    hit spans out of the texts (each from its first to its last hit word). Rows
    with null or empty text have no hit and stay. docs may have columns of any
    name and keeps their values.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    names = tuple(free_name(docs.columns, c) for c in ("_n_words", "_hit_spans", "_hit_items"))
    spans = names[1]
    found = scan(docs, benchmark, size, names=names)
    if remove == "documents":
        return found.filter(F.col(spans).isNull()).select(docs.columns)
    # bytes outside the spans; a span starts and ends at a word, so characters stay whole
    data = F.col("text").cast("string").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s.end_byte))
    begins = F.concat(F.transform(spans, lambda s: s.first_byte), F.array(F.octet_length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: data.substr((p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"))
    return found.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(parts, ""))).select(docs.columns)
