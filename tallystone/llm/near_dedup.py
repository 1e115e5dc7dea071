"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its distinct w-word shingles. Its signature has
``chunks * chunk_size`` components of 16 bits, each the low bits of a minimum
under its own hash function. The signature distance of two documents is the
number of components that differ.

Pigeonhole: if two signatures differ in fewer than ``chunks * (errors + 1)``
components, some chunk differs in ``errors`` components at most. Each chunk is
therefore stored under every choice of ``chunk_size - errors`` of its components
(the enumerated errors are wildcards), and such a pair meets under at least one
key. With the defaults (11 chunks of 6, 1 error) every pair at a distance of 21
or less meets; two sets of similarity 0.8 miss each other in all 66 keys with a
chance of 8e-6, those of 0.85 with 2e-8.

Every link is confirmed on the full sets. Sets that are equal are one class from
the start, so groups of exact copies never meet in a bucket. In a bucket a
member first meets one leader only; of buckets which hold more than one
component after that, the rows outside the largest component are compared with
the others by set size, by signature and by a larger sketch, block against
block, and what passes is confirmed too. A task holds two blocks of SALT_ROWS
rows or so, whatever the size of a bucket. The number of comparisons, though not
of rows that leave a task, is that of the pairs of different components whose
set sizes are close enough: where very many documents share more than half of
their shingles, but less than the threshold, it grows with their square.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, buffers, lower_ascii, mix, runs_combined, shared_dir, span_hashes, stored, windows_of_rows, word_spans

CHUNKS, CHUNK_SIZE, ERRORS = 11, 6, 1
#: Signature distance up to which a pair of a bucket is looked at: at similarity 0.8 the mean is 13.2 of 66, and a distance over 36 has a chance below 1e-10.
MOST_APART = 36
#: Bins of the sketch that decides which pairs of a crowded bucket are confirmed on full sets, and how many standard
#: deviations (of its estimate for a pair at the threshold) a pair may be below it.
SKETCH_BINS, SKETCH_DEVIATIONS = 1024, 5.5
#: Rows of a bucket that one task compares at once.
SALT_ROWS = 2000


def shingle_rows(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their offsets."""
    data = lower_ascii(data)
    start, end, first = word_spans(data, off, NOT_SPACE)
    h = span_hashes(data, start, end)
    count = np.diff(first)
    at = windows_of_rows(first, words)
    row_of = np.repeat(np.arange(len(count)), count)
    value, row = runs_combined(h, words)[at], row_of[at]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.array([mix(np.uint64([hash_sequence(h[first[i] : first[i + 1]])]))[0] for i in short], np.uint64)
        value, row = np.concatenate([value, whole]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def hash_sequence(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8, person=b"short").digest(), "little")


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(value: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """n components of 16 bits for each row that has a shingle."""
    out = np.zeros((len(off) - 1, n), np.uint16)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    # 32-bit arithmetic: an odd multiplier permutes the values, the added half word sets the permutations apart
    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    seeds = _seeds(2 * n)
    for k in range(n):
        x = low * np.uint32(seeds[2 * k] >> np.uint64(32) | np.uint64(1)) + high * np.uint32(seeds[2 * k + 1] >> np.uint64(32) | np.uint64(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        least = np.minimum.reduceat(x, off[full])
        out[full, k] = ((least * np.uint32(0x297A2D39)) >> np.uint32(16)).astype(np.uint16)
    return out


def sketches(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The least shingle of each of SKETCH_BINS bins as 4 bits, 0 for an empty bin. value: ascending in each row."""
    out = np.zeros((len(off) - 1, SKETCH_BINS), np.uint8)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    where = row * SKETCH_BINS + (value >> np.uint64(64 - (SKETCH_BINS - 1).bit_length())).astype(np.int64)
    if len(where):
        new = np.ones(len(where), bool)
        new[1:] = where[1:] != where[:-1]
        out.reshape(-1)[where[new]] = (value[new] % np.uint64(15)).astype(np.uint8) + 1
    return out[:, ::2] << 4 | out[:, 1::2]


def unpacked(sketch: np.ndarray) -> np.ndarray:
    return np.concatenate([sketch >> 4, sketch & 15], 1)


def describe(docs: DataFrame, words: int, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (binary, 16 bits a component), sketch (binary)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, off = buffers(batch.column(1))
            for a, b in blocks(off):
                value, at = shingle_rows(data[off[a] : off[b]], off[a : b + 1] - off[a], words)
                sig = signatures(value, at, n)
                digests = [hashlib.blake2b(value[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.binary()), pa.array([row.tobytes() for row in sig], pa.binary()), pa.array([row.tobytes() for row in sketches(value, at)], pa.binary())], names=["doc_id", "n_shingles", "digest", "signature", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, sketch binary")


def chunk_keys(classes: DataFrame, chunks: int, size: int, errors: int) -> DataFrame:
    """key, id for every chunk and every choice of allowed errors. The low 8 bits of a key are the number of the choice."""
    kept = list(combinations(range(size), size - errors))
    if chunks * len(kept) > 256:
        raise ValueError("at most 256 keys a document")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), chunks, size).astype(np.uint64)
            keys = np.empty((len(ids), chunks, len(kept)), np.uint64)
            for j, which in enumerate(kept):
                h = np.zeros((len(ids), chunks), np.uint64) + np.uint64(j + 1) + np.arange(chunks, dtype=np.uint64) * np.uint64(1009)
                for k in which:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k] + np.uint64(1))
                keys[:, :, j] = h << np.uint64(8) | np.arange(chunks, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(j)
            width = chunks * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, width))], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def signature_distance(pairs: DataFrame) -> DataFrame:
    """Adds apart: the number of components in which signature and other_signature differ."""
    names = [c for c in pairs.columns if c not in ("signature", "other_signature")]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) if n else np.zeros((0, 1), np.uint16) for c in ("signature", "other_signature"))
            apart = (a != b).sum(1) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(apart, pa.int32())], names=[*names, "apart"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in names)
    return pairs.mapInArrow(run, f"{schema}, apart int")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union. texts: id, text; one row for each text of an id."""
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stored(texts.join(involved, "id", "left_semi"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            data_a, off_a = buffers(batch.column(2))
            data_b, off_b = buffers(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for first, last in blocks(off_a + off_b):
                va, at_a = shingle_rows(data_a[off_a[first] : off_a[last]], off_a[first : last + 1] - off_a[first], words)
                vb, at_b = shingle_rows(data_b[off_b[first] : off_b[last]], off_b[first : last + 1] - off_b[first], words)
                for i in range(last - first):
                    x, y = va[at_a[i] : at_a[i + 1]], vb[at_b[i] : at_b[i + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                        continue
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    good[first + i] = 100 * common >= percent * (len(merged) - common)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reachable) for every id of edges (a, b), by alternating large-star and small-star steps.

    Each step is two aggregations and a join over the edges, cut off by a table in
    the shared folder; only two sums per step come to the driver.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        # done when every id has one neighbour and the step changed nothing
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def cross_pairs(mixed: DataFrame, most_apart: int, percent: int, chunks: int, size: int, errors: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a bucket and are close by set size, signature and sketch.

    mixed: key, id, root, n_shingles, signature, sketch, minor (not of the
    bucket's largest component), n (rows of the bucket). A bucket of more than
    SALT_ROWS rows is dealt into bands of set sizes, so that close sizes lie in
    one band or in two that follow each other, and a band into blocks. Every block
    of rows meets every block of minor rows (as queries) of its own band and of
    those beside it, so a task holds two blocks of SALT_ROWS rows or so. Of all
    buckets that two documents share, only the first one by number of the choice
    gives the pair.
    """
    kept = [list(c) for c in combinations(range(size), size - errors)]
    band = F.when(F.col("n") > SALT_ROWS, F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / percent) + 1e-6))).otherwise(F.lit(0)).cast("long")
    mixed = mixed.withColumn("band", band)
    # blocks of each band: one row a key, and few bands
    blocks_of = lambda c: F.ceil(F.count(c) / SALT_ROWS).cast("long")
    bands = mixed.groupBy("key", "band").agg(blocks_of(F.lit(1)).alias("rows"), blocks_of(F.when(F.col("minor"), 1)).alias("asks"))
    bands = bands.groupBy("key").agg(F.collect_list(F.struct("band", "rows", "asks")).alias("bands"))
    dealt = mixed.join(bands, "key")
    near = F.filter("bands", lambda b: F.abs(b["band"] - F.col("band")) <= 1)

    def every(c: str) -> Column:
        """Blocks of rows or of queries in the bands that a row may meet."""
        of_band = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b[c] - 1), lambda k: F.struct(b["band"].alias("band"), k.alias("salt")))
        return F.flatten(F.transform(F.filter(near, lambda b: b[c] > 0), of_band))

    def own(c: str) -> Column:
        n = F.filter("bands", lambda b: b["band"] == F.col("band"))[0][c]
        return F.struct(F.col("band").alias("band"), F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1).cast("long"))).alias("salt"))

    role = lambda block, asked_by, query: F.struct(block.alias("block"), asked_by.alias("asked_by"), F.lit(query).alias("query"))
    as_row = F.transform(every("asks"), lambda a: role(own("rows"), a, False))
    as_query = F.transform(every("rows"), lambda b: role(b, own("asks"), True))
    roles = F.explode(F.when(F.col("minor"), F.concat(as_row, as_query)).otherwise(as_row)).alias("role")
    both = dealt.select("key", roles, "id", "root", "n_shingles", "signature", "sketch").select("key", "role.*", "id", "root", "n_shingles", "signature", "sketch")
    least = percent / 100

    def run(table: pa.Table) -> pa.Table:
        ids, root, n = (table.column(c).to_numpy() for c in ("id", "root", "n_shingles"))
        chunk, choice = divmod(int(table.column("key")[0].as_py()) & 255, len(kept))
        query = table.column("query").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), -1)
        sketch = unpacked(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1))
        here, asks = np.flatnonzero(~query), np.flatnonzero(query)
        sig_here, sketch_here, root_here, n_here = sig[here], sketch[here], root[here], n[here]
        left, right = [], []
        for q in asks:
            at = np.flatnonzero((root_here != root[q]) & (100 * np.minimum(n_here, n[q]) >= percent * np.maximum(n_here, n[q])))
            if not len(at):
                continue
            same = sig_here[at] == sig[q]
            near = sig.shape[1] - np.count_nonzero(same, 1) <= most_apart
            same = same.reshape(len(at), chunks, size)
            near &= (np.count_nonzero(same, 2) >= size - errors).argmax(1) == chunk
            for j in range(choice):
                near &= ~same[:, chunk, kept[j]].all(1)
            at = at[near]
            if not len(at):
                continue
            x, y = sketch_here[at], sketch[q]
            full = (x | y) != 0
            bins = np.count_nonzero(full, 1)
            # the least of each bin is a sample, without replacement, of a union of this size
            union = np.maximum((n_here[at] + n[q]) / (1 + least), bins)
            slack = SKETCH_DEVIATIONS * np.sqrt(least * (1 - least) / bins * (1 - bins / union)) + 0.01
            at = at[np.count_nonzero((x == y) & full, 1) >= (least - slack) * bins]
            left.append(np.minimum(ids[here[at]], ids[q]))
            right.append(np.maximum(ids[here[at]], ids[q]))
        a, b = (np.concatenate(x) if left else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("key", "block", "asked_by").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int = CHUNKS, chunk_size: int = CHUNK_SIZE, errors: int = ERRORS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text and any other columns. Documents are linked if
    100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id reachable over links.

    Null or wordless text: an empty set, linked with nothing. Null doc_id: the
    row comes back with component_id null and kept true, linked with nothing.
    Rows that repeat a doc_id are one document with several texts, so its texts
    are linked with one another, and each row that has words comes back with the
    same component. Equal sets are one class, whatever their texts. Texts may be of
    any length: a row of an Arrow batch is one text, and is handled whole. An empty
    table gives an empty table. Other columns are not read.
    """
    shared_dir(docs.sparkSession)
    described = stored(describe(docs, words, chunks * chunk_size))
    filled = described.filter("n_shingles > 0 and doc_id is not null")
    again = stored(filled.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("several")).filter("n > 1").select("doc_id", "several"))
    # one class for each distinct set; the digest stands for it
    classes = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    keys = chunk_keys(classes, chunks, chunk_size, errors)
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).filter("leader <> last").select("key", "leader", "n")
    members = stored(keys.join(stored(buckets), "key"))

    sizes = classes.select("id", "n_shingles", "signature")
    # the nearest of the leaders that a document meets
    stars = members.filter("id <> leader").select("id", "leader").distinct()
    other = sizes.select(F.col("id").alias("leader"), F.col("n_shingles").alias("other_n"), F.col("signature").alias("other_signature"))
    stars = stars.join(sizes, "id").join(other, "leader").filter(100 * F.least("n_shingles", "other_n") >= percent * F.greatest("n_shingles", "other_n")).select("id", "leader", "signature", "other_signature")
    nearest = signature_distance(stars).filter(F.col("apart") <= MOST_APART).groupBy("id").agg(F.min_by("leader", F.struct("apart", "leader")).alias("leader"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    repeats = not again.isEmpty()
    if repeats:  # of equal rows one will do
        ids = again.select(F.col("doc_id").alias("id"))
        texts = texts.join(ids, "id", "left_anti").union(texts.join(ids, "id", "left_semi").distinct())
    first_edges = stored(confirmed(stored(nearest.select(F.col("leader").alias("a"), F.col("id").alias("b"))), texts, words, percent))
    roots = stored(components(first_edges))

    # buckets that still hold more than one component
    rooted = stored(members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = mixed.select("key", "major", "n")
    sketched = described.select(F.col("doc_id").alias("id"), "digest", "sketch").join(classes, ["id", "digest"]).select("id", "n_shingles", "signature", "sketch")
    mixed = rooted.join(mixed, "key").join(sketched, "id").withColumn("minor", F.col("root") != F.col("major"))
    more = stored(cross_pairs(mixed, MOST_APART, percent, chunks, chunk_size, errors))
    edges = first_edges.union(confirmed(more, texts, words, percent))
    if repeats:  # a doc_id with several different texts joins their classes
        several = filled.join(again.filter("several"), "doc_id", "left_semi").select("digest", F.col("doc_id").alias("a"))
        edges = edges.union(several.join(classes.select("digest", F.col("id").alias("b")), "digest").select("a", "b"))
    final = components(edges)

    reached = stored(classes.join(final, "id", "left").select("digest", F.coalesce("root", "id").alias("component")))
    linked = described.join(reached, "digest", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def without_linked_repeats(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without rows that share their doc_id with an equal or linked row; rows with other texts and null ids stay."""
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return docs
    rows = stored(docs.join(again, "doc_id", "left_semi").select(docs.columns).distinct().select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")))
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), words, percent).select(F.col("doc_id").alias("_row"), "component_id")
    first = rows.join(groups, "_row").groupBy("_doc.doc_id", "component_id").agg(F.min("_row").alias("_row")).select("_row")
    return docs.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(rows.join(first, "_row", "left_semi").select("_doc.*"))
