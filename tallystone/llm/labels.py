"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int) -> DataFrame:
    """text, label of at most per_class documents of each class, chosen by a hash of doc_id.

    usable: condition on labels' doc_id; rows it excludes are never looked at.
    The bound is one of rows, 2.2 * per_class in all, whatever the length of a text.
    Null labels and null doc_ids are left out, and labels of one doc_id that
    disagree; of rows that repeat a doc_id one is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other").select("doc_id", "label")
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.col("doc_id")]
    # a few more ids than asked for, as some texts are missing
    chosen = [known.filter(F.col("label") == k).orderBy(*order).limit(per_class + per_class // 10) for k in (0, 1)]
    chosen = stored(chosen[0].union(chosen[1]))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    # at most 2.2 * per_class ids, so this side may be broadcast
    return stored(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label"))
