"""Vector and alias search: cosine top-k for a stated set of queries, categories of hits, alias n-grams to products and sources."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.storage import stored

#: Query vectors and vectors of one task, and as many of its vectors as are compared at once.
QUERY_BLOCK, VECTOR_BLOCK, SLICE = 1024, 16384, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists, without an object for each number."""
    rows = c.combine_chunks()
    size = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if len(size) != 1 or rows.null_count:
        raise ValueError("vectors must be of one length")
    return _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))


def _best_of(k: int):
    """The k nearest of a block's vectors (vec_id, known) for each of its queries (query_id, asked).

    The vectors come in slices in order of their ids, each ranked with the best before it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, asked, q = left.sort_by("vec_id"), right["query_id"].to_numpy(), _matrix(right["asked"])
        ids, score = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
        for start in range(0, left.num_rows, SLICE):
            some = left.slice(start, SLICE)
            score = np.concatenate([score, q @ _matrix(some["known"]).T], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(some["vec_id"].to_numpy(), (len(asked), some.num_rows))], axis=1)
            best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
            ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
        return pa.table({"query_id": np.repeat(asked, ids.shape[1]), "vec_id": ids.reshape(-1), "score": score.reshape(-1)})

    return run


def centroids(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of a bounded sample: the ``sample`` vectors whose ids have the lowest hashes."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].to_pylist()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(rows)
    at = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, x)
        empty = np.bincount(nearest, minlength=len(at)) == 0
        at = np.where(empty[:, None], at, _unit(sums))
    return at


def _nearest_lists(rows: DataFrame, vector: str, at: np.ndarray, n: int) -> DataFrame:
    """rows once for each of the n centres nearest to its vector, with ``list``."""
    names, place = rows.columns, rows.columns.index(vector)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _unit(batch.column(place).to_pylist()) @ at.T
            best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :n]
            taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best.reshape(-1).astype(np.int32))], names=[*names, "list"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", list int")


class VectorIndex:
    """Vectors (vec_id, embedding and other columns) in lists by their nearest centre; every row is in one list.

    Centres are fitted on a bounded sample. Searches look into the lists nearest to a
    query and rank what they hold exactly, so they may miss a neighbour in a farther
    list but never misplace one; ``top_k`` is the exact way.
    """

    def __init__(self, vectors: DataFrame, lists: int = 64, sample: int = 20_000):
        self.centres = centroids(vectors, lists, sample)
        self.rows = stored(_nearest_lists(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), "embedding", self.centres, 1)) if len(self.centres) else vectors.withColumn("list", F.lit(0))

    def search(self, queries: DataFrame, k: int, probes: int = 16, within: Column | None = None) -> DataFrame:
        """query_id, vec_id, score, place: the k nearest of the ``probes`` nearest lists; ``within``: a condition on the vectors' columns.

        A list of many vectors is compared in blocks of bounded size, each with all
        queries of that list.
        """
        if not len(self.centres):
            return self.rows.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("place")).limit(0)
        rows = self.rows if within is None else self.rows.filter(within)
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))  # one row a list
        v = rows.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", F.col("embedding").alias("known"))
        q = _nearest_lists(queries.select(F.col("query_id").cast("long"), F.col("embedding").alias("asked")), "asked", self.centres, probes)
        q = q.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "asked")
        out = v.groupBy("list", "block").cogroup(q.groupBy("list", "block")).applyInArrow(_best_of(k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return out.withColumn("place", place).filter(F.col("place") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, place: the k nearest vectors of each query by cosine, ties by id.

    queries (query_id, embedding) are a stated set. Queries and vectors are dealt
    into blocks by hashes of their ids; every block of queries meets every block of
    vectors in one task, which passes on its own best k of a query only, and a
    window ranks those. Only two counts come to the driver.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_queries, n_vectors = blocks(queries, QUERY_BLOCK), blocks(vectors, VECTOR_BLOCK)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("known"), deal("vec_id", n_vectors).alias("vb"), every(n_queries).alias("qb"))
    q = queries.select(F.col("query_id").cast("long"), F.col("embedding").alias("asked"), every(n_vectors).alias("vb"), deal("query_id", n_queries).alias("qb"))

    out = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(_best_of(k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def category_candidates(hits: DataFrame, labels: DataFrame, least: float, within: float) -> DataFrame:
    """query_id, label: best score, hits and place of the labels of a query's hits, within a share of its best."""
    x = hits.join(labels, "vec_id").filter(F.col("score") >= least)
    per = x.groupBy("query_id", "label").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    top = F.max("best").over(Window.partitionBy("query_id"))
    per = per.withColumn("_top", top).filter(F.col("best") >= F.col("_top") * within).drop("_top")
    return per.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("best").desc(), F.col("hits").desc(), "label")))


def resolve(queries: DataFrame, aliases: DataFrame, grams: Column) -> DataFrame:
    """query_id, alias, product: the longest run of words of a query that is an alias, then the earliest. aliases: alias, product."""
    x = queries.select("query_id", F.posexplode(grams).alias("rank", "alias"))
    found = x.join(aliases, "alias")
    return found.groupBy("query_id").agg(F.min_by(F.struct("alias", "product"), F.struct("rank", "product")).alias("m")).select("query_id", "m.alias", "m.product")


def hashed_vector(text: Column, size: int = 384, low: int = 2, high: int = 4) -> Column:
    """Signed hashed character n-grams of a folded text and of each of its words, with ^ and $ as edges, as a unit vector."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        @lru_cache(1 << 16)
        def place(gram: str) -> tuple[int, float]:
            digest = hashlib.sha256(gram.encode()).digest()
            return int.from_bytes(digest[:4], "little") % size, 1.0 if digest[4] % 2 == 0 else -1.0

        def vector(t: str) -> np.ndarray:
            v = np.zeros(size)
            for piece in (f"^{x}$" for x in (t, *t.split())):
                for n in range(low, high + 1):
                    for i in range(len(piece) - n + 1):
                        at, sign = place(piece[i : i + n])
                        v[at] += sign
            return v / (np.sqrt(v @ v) or 1.0)

        # a text is hashed once a batch
        once = texts.dictionary_encode()
        of_text = np.array([vector(t) for t in once.dictionary.to_pylist()]).reshape(-1, size)
        values = of_text[once.indices.to_numpy(zero_copy_only=False)]
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, size, dtype=np.int32), values.reshape(-1))

    return vectors(F.coalesce(text, F.lit("")))
