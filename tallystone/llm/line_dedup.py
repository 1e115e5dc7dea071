"""Removal of repeated passages of lines by content-defined chunks.

Lines that occur once anywhere cannot be part of a repeated passage, so they only
delimit runs of lines that occur more often. Inside a run, a rolling hash over
the hashes of a line and the one before it ends a chunk where it is divisible by
``divisor``; the rule looks at neighbouring lines only, so lines put in or taken
out move only the boundaries next to them, and a chunk has two lines or more. A
long line is a chunk of its own. Chunks of two lines or more, or of
``long_words`` words, that occur again anywhere in the corpus are removed
everywhere but in their first place, after their bytes were compared. A short
single line, such as a heading or a licence, stays.

In a copied document, or next to a blank line, every line occurs more often and a
run says nothing of the passages inside it. Each pair of adjacent lines therefore
counts the rows that hold it; a passage is also cut out where such a count falls,
without wordless lines at its ends, and is a chunk besides those of the runs. A
passage that occurs again only in copies of its own document does not stand out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, buffers, key_filter, may_have, runs_combined, span_hashes, stored, word_spans

DIVISOR, LONG_WORDS = 3, 50


def lines_before(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines before each row, and the total; a row of k line ends has k + 1 lines."""
    return np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(np.flatnonzero(data == 0x0A), off)) + 1)])


def line_spans(data: np.ndarray, off: np.ndarray):
    """Row, start, end and hash of each line, and lines before each row."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # a line starts at a row's start and after each line end
    start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    first = lines_before(data, off)
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = off[1:]
    h = span_hashes(data, start, end) if len(data) else np.zeros(len(start), np.uint64)
    return np.repeat(np.arange(n), np.diff(first)), start, end, h, first


def worded_lines(data: np.ndarray, off: np.ndarray):
    """As line_spans, and the words of each line."""
    row, start, end, h, first = line_spans(data, off)
    word_start, _, _ = word_spans(data, off, NOT_SPACE)
    return row, start, end, h, first, np.searchsorted(word_start, end) - np.searchsorted(word_start, start)


def described(lines, chunk_first: np.ndarray, chunk_last: np.ndarray):
    row, start, end, _, first, words = lines
    with_words = np.concatenate([[0], np.cumsum(words > 0)])
    total = np.concatenate([[0], np.cumsum(words)])
    return row[chunk_first], chunk_first - first[row[chunk_first]], chunk_last - chunk_first + 1, with_words[chunk_last + 1] - with_words[chunk_first], total[chunk_last + 1] - total[chunk_first], start[chunk_first], end[chunk_last]


def line_passages(lines, together: np.ndarray):
    """Passages of two lines with words or more, described as line_chunks does.

    together: for each line, the rows that hold it and the next one of its row as neighbours; below 2 means no others.
    """
    left, right = np.concatenate([[0], together[:-1]]), np.concatenate([together[1:], [0]])
    joined = (together >= 2) & (together >= left) & (together >= right)
    opens = np.flatnonzero(~np.concatenate([[False], joined[:-1]]))
    closes = np.concatenate([opens[1:], [len(together)]])
    worded = np.flatnonzero(lines[5] > 0)
    low, high = np.searchsorted(worded, opens), np.searchsorted(worded, closes) - 1
    some = high > low
    return described(lines, worded[low[some]], worded[high[some]])


def line_chunks(data: np.ndarray, off: np.ndarray, divisor: int, long_words: int, again):
    """Chunks of rows: row, first line (within its row), lines, lines with words, words, first and end byte.

    again: function from the hashes of all lines to booleans, true for lines that occur more than once.
    """
    return run_chunks(worded_lines(data, off), divisor, long_words, again)


def run_chunks(lines, divisor: int, long_words: int, again):
    row, _, _, h, _, words = lines
    m = len(h)
    flag, long = again(h.view(np.int64)), words >= long_words
    opens = np.ones(m, bool)  # first line of a run
    opens[1:] = (row[1:] != row[:-1]) | (flag[1:] != flag[:-1]) | long[1:] | long[:-1]
    closes = np.ones(m, bool)
    closes[:-1] = opens[1:]
    candidate = np.zeros(m, bool)
    if m > 1:
        candidate[1:] = (runs_combined(h, 2) % np.uint64(divisor) == 0) & ~opens[1:]
    inner = candidate.copy()
    inner[1:] &= ~candidate[:-1]  # of two candidates in a row the first counts
    inner[:-1] &= ~closes[1:]  # two lines or more stay to the run's end
    chunk_last = np.flatnonzero(inner | closes)
    chunk_first = np.concatenate([[0], chunk_last[:-1] + 1]) if len(chunk_last) else np.zeros(0, np.int64)
    keep = flag[chunk_first]
    return described(lines, chunk_first[keep], chunk_last[keep])


def line_hashes(docs: DataFrame) -> DataFrame:
    """hash of every line. docs: doc_id, row, text."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(2))
            for a, b in blocks(off):
                _, start, end, h, _ = line_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["hash"])

    return docs.mapInArrow(run, "hash long")


def passing_lines(docs: DataFrame, filter_) -> DataFrame:
    """doc_id, row, line, hash, pair, new of the lines that pass a broadcast filter of hashes. docs: doc_id, row, text.

    pair: the hash is that of the line and the next one, which passes too; new: the row has not had the hash yet.
    """

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(2))
            for a, b in blocks(off):
                row, _, _, h, first = line_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
                passes = may_have(filter_.value, h)
                one, two = np.flatnonzero(passes), np.flatnonzero(passes[:-1] & passes[1:] & (row[:-1] == row[1:]))
                some, pair = np.concatenate([one, two]), np.repeat([False, True], [len(one), len(two)])
                keys = np.concatenate([h[one], runs_combined(h, 2)[two]])
                order = np.lexsort((keys, row[some], pair))
                new = np.ones(len(some), bool)
                if len(some) > 1:
                    x, y = order[:-1], order[1:]
                    new[y] = (keys[x] != keys[y]) | (row[some[x]] != row[some[y]]) | (pair[x] != pair[y])
                at = pa.array(row[some] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((some - first[row[some]]).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(pair), pa.array(new)], names=["doc_id", "row", "line", "hash", "pair", "new"])

    return docs.mapInArrow(run, "doc_id long, row long, line int, hash long, pair boolean, new boolean")


def same_place(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, text, lines, pairs of rows with lines that occur more than once.

    lines: their numbers within the row; pairs: line, n for lines that n rows, two or more, hold next to the following one.
    """
    repeated = stored(line_hashes(docs).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    # the filter keeps most other lines out of the shuffle; the join decides
    passing = stored(passing_lines(docs, docs.sparkSession.sparkContext.broadcast(key_filter(repeated))))
    pairs = passing.filter("pair and new").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash", F.lit(True).alias("pair"), "n")
    known = stored(repeated.select("hash", F.lit(False).alias("pair"), F.lit(0).cast("long").alias("n")).union(pairs))
    # at most the lines of one document
    marks = passing.join(known, ["hash", "pair"]).groupBy("doc_id", "row").agg(F.collect_set(F.when(~F.col("pair"), F.col("line"))).alias("lines"), F.collect_set(F.when(F.col("pair"), F.struct("line", "n"))).alias("pairs"))
    return stored(docs.alias("d").join(marks.alias("m"), same_place("d", "m")).select("d.doc_id", "d.row", "d.text", "m.lines", "m.pairs"))


def chunk_rows(docs: DataFrame, divisor: int, long_words: int, wanted=None) -> DataFrame:
    """doc_id, row, first_line, n_lines, hash of each chunk that may be removed. docs: as marked_lines gives them.

    wanted: a broadcast filter of hashes; then only chunks that pass it, with their bytes.
    """
    with_bytes = wanted is not None

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(2))
            for a, b in blocks(off):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                before, marks = lines_before(part, at), batch.column(3).slice(a, b - a)
                again = np.zeros(before[-1], bool)
                again[before[pc.list_parent_indices(marks).to_numpy()] + pc.list_flatten(marks).to_numpy()] = True
                pairs, together = batch.column(4).slice(a, b - a), np.zeros(before[-1], np.int64)
                near = pc.list_flatten(pairs)
                together[before[pc.list_parent_indices(pairs).to_numpy()] + near.field("line").to_numpy()] = near.field("n").to_numpy()
                all_lines = worded_lines(part, at)
                found = [np.concatenate(x) for x in zip(run_chunks(all_lines, divisor, long_words, lambda h: again), line_passages(all_lines, together))]
                once = np.unique(np.stack([*found[:3]]), axis=1, return_index=True)[1] if len(found[0]) else np.zeros(0, np.int64)
                row, first, lines, full, words, start, end = (x[once] for x in found)
                keep = np.flatnonzero((full >= 2) | (words >= long_words))
                h = span_hashes(part, start[keep], end[keep]).view(np.int64) if len(keep) else np.zeros(0, np.int64)
                if with_bytes and len(keep):
                    some = may_have(wanted.value, h)
                    keep, h = keep[some], h[some]
                at = pa.array(row[keep] + a)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(first[keep], pa.int64()), pa.array(lines[keep], pa.int64()), pa.array(h)]
                if with_bytes:
                    raw = part.tobytes()
                    columns.append(pa.array([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "first_line", "n_lines", "hash", "bytes"][: len(columns)])

    return docs.mapInArrow(run, "doc_id long, row long, first_line long, n_lines long, hash long" + ", bytes binary" * with_bytes)


def merged(cuts: DataFrame) -> DataFrame:
    """cuts (doc_id, row, _cuts) with overlapping ones as one; _cuts: first_line, n_lines, in order."""

    def run(batches):
        for batch in batches:
            out = []
            for cut in batch.column(2).to_pylist():
                spans = []
                for c in cut:
                    first, end = c["first_line"], c["first_line"] + c["n_lines"]
                    if spans and first < spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([first, end])
                out.append([{"first_line": x, "n_lines": y - x} for x, y in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("first_line", pa.int64()), ("n_lines", pa.int64())])))], names=["doc_id", "row", "_cuts"])

    return cuts.mapInArrow(run, "doc_id long, row long, _cuts array<struct<first_line: long, n_lines: long>>")


def remove_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with text without repeated chunks, and n_lines, n_removed_lines, n_removed_chunks (long).

    The first place of a chunk, by doc_id (null last), then line, is kept; a
    document may also repeat itself. Rows alike in doc_id and text are one place
    and stay alike. Null text stays null and has no lines; a text whose lines are
    all removed becomes empty. Columns of docs with the three names are replaced;
    others, of any name, stay. doc_ids are ordered as whole numbers (a doc_id of
    another type must read as one). An empty table gives an empty result. A text of
    any length that Spark holds in a row is taken whole.
    """
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_row": F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))})
    slim = keyed.select(F.col("_id").alias("doc_id"), F.col("_row").alias("row"), F.col("text").cast("string").alias("text")).filter("text is not null")
    share = docs.sparkSession.sparkContext.broadcast
    more_than_once = lambda hashes: stored(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    marked = marked_lines(slim)
    repeated = more_than_once(chunk_rows(marked, divisor, long_words))
    # the filters keep the texts of other chunks and other documents out of the shuffles; the joins decide
    found = stored(chunk_rows(marked, divisor, long_words, share(key_filter(repeated))).join(repeated, "hash", "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "first_line")
    # grouping by the bytes compares them
    first = stored(found.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "bytes", "first"))
    removed = found.join(first, ["hash", "bytes"]).filter(~((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("row") == F.col("first.row")) & (F.col("first_line") == F.col("first.first_line"))))
    # at most the chunks of one document
    cuts = stored(merged(removed.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("first_line", "n_lines"))).alias("_cuts"))))
    touched = share(key_filter(cuts.select("row")))

    @F.pandas_udf("boolean")
    def may_change(row: pd.Series) -> pd.Series:
        return pd.Series(may_have(touched.value, row.to_numpy()))

    flagged = keyed.withColumn("_may", may_change("_row"))
    cuts = cuts.withColumnsRenamed({"doc_id": "_id2", "row": "_row2"})
    met = flagged.filter("_may").join(cuts, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left")
    out = met.unionByName(flagged.filter("not _may"), allowMissingColumns=True)
    lines = F.split(F.col("text").cast("string"), "\n")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["first_line"] + c["n_lines"]))
    begins = F.concat(F.transform("_cuts", lambda c: c["first_line"]), F.array(F.size(lines).cast("long")))
    kept = F.flatten(F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: F.slice(lines, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    zero = F.lit(0).cast("long")
    out = out.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), zero).otherwise(F.size(lines).cast("long")),
            "n_removed_lines": F.when(F.col("_cuts").isNull(), zero).otherwise(F.aggregate("_cuts", zero, lambda n, c: n + c["n_lines"])),
            "n_removed_chunks": F.when(F.col("_cuts").isNull(), zero).otherwise(F.size("_cuts").cast("long")),
            "text": F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    )
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")], "n_lines", "n_removed_lines", "n_removed_chunks")
