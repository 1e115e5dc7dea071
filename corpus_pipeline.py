"""A training corpus from documents: five stages, each over all that the one before it kept.

All stages take documents with null doc_ids, null or empty or very long texts,
repeated rows, repeated doc_ids with other texts, further columns of any name
and no rows at all. All but the last return the columns that they were given,
with the values of the rows that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import decontaminate as decontamination
from tallystone.llm import mixing, near_dedup, quality_model, token_files
from tallystone.llm.common import free_name, read_table, shared_dir

#: Documents with a lower quality score go. Chosen on held-out labels: it keeps 99.8 % of good documents.
LEAST_QUALITY = 0.3
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Its labels come from sf_dir, its texts from docs.

    Every row is judged by its whole text alone, so equal texts stay or go together;
    null and empty texts are scored as no text. A score equal to the least stays.
    """
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    name = free_name(docs.columns, "_score")
    return quality_model.score(docs, model, name=name).filter(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows without words and rows with a null doc_id stay. Of rows that share the
    smallest doc_id, equal or linked ones become one; rows with other texts stay.
    """
    gone = near_dedup.near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return near_dedup.without_linked_repeats(docs.join(gone, "doc_id", "left_anti").select(docs.columns), words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts stay, and all rows if the benchmark is empty."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), size=10, remove="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document comes once for each epoch that takes it.

    Documents without words stand in whole epochs only; the one at which a budget
    ends comes with its first words. Null sources are one source, the last.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row a document of the mix, as read back from them: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; null doc_ids come first, copies of a
    document one after the other.
    """
    import public_tokenizers

    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: A convolutional network and tokenizer files are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
