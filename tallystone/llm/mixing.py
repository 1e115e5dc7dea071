"""Mixing sources to target weights, in DataFrame functions only.

Documents get hash-random keys. The key space of each source is cut into equal
ranges (a hash is uniform, so the ranges are known without sampling); sums of
the ranges give distributed prefix sums. The one range of a source in which its
budget ends is cut into ranges again, and only the one of those in which the
budget ends, a millionth of the source, is sorted row by row. A source whose
budget exceeds it is repeated whole, then cut in its next epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ranges of the key space of a source, and of the range in which its budget ends.
RANGES = 1024
INNER_BITS = 10
#: Bits of a key that place it in a range.
KEY_BITS = 52
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """sizes: source, source_size. Adds weight and target: shares by weight of percent % of all sizes, none above most * source_size.

    What exceeds a stop is shared again by weight. Sorted by stop / weight, the
    sources at their stop come first, so one pass of running sums finds the
    level. The windows hold one row a source.
    """
    by_source, order = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumns({"weight": weight.cast("long"), "place": F.row_number().over(by_source)})
    s = s.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop").cast("double") / F.col("weight"))
    everything = Window.partitionBy()
    before = F.sum("stop").over(order) - F.col("stop")
    rest = F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")
    wanted = F.sum("source_size").over(everything).cast("double") * percent / F.lit(100).cast("double")
    s = s.withColumn("level", (wanted - before.cast("double")) / rest.cast("double")).withColumn("open", F.col("stop").cast("double") > F.col("weight") * F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    target = F.least(F.col("stop").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("stop").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix-1", ranges: int = RANGES, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole repeats), extra (words of one more epoch), taken.

    size: words of the text (null: 0). Null sources are one source, the last.
    Null doc_ids share a key; equal keys are taken in order of size. Rows that
    repeat a doc_id are documents of their own. An empty table gives none. Only the
    number of words of a text is used, so its length does not matter. docs may have
    other columns of any name; they are not read.
    carry: also _doc, a struct of all columns of docs.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    if ranges >= 1 << 63 - KEY_BITS:
        raise ValueError("too many ranges")
    place = F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long") * ranges
    part = F.shiftright(place, KEY_BITS).cast("int")
    inner = F.shiftright(place.bitwiseAND(F.lit((1 << KEY_BITS) - 1)), KEY_BITS - INNER_BITS).cast("int")
    carried = ["_doc"] if carry else []
    whole_row = [F.struct(*docs.columns).alias("_doc")] if carry else []
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), key.alias("key"), *whole_row).withColumns({"part": part, "inner": inner}))
    sums = stored(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, percent, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", whole).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size")
    parts = sums.withColumn("before", before)
    plan = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "p.part", "part_size", "before", "source_size", "target", "epochs", "rest")
    plan = stored(plan)
    rows = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part"))).select("doc_id", "d.source", "size", "key", "d.part", "inner", "part_size", "before", "source_size", "target", "epochs", "rest", *carried)
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") > F.col("rest"))
    whole_or_none = F.when(F.col("before") + F.col("part_size") <= F.col("rest"), F.col("size")).otherwise(F.lit(0).cast("long"))
    simple = rows.filter(~cut).withColumn("extra", whole_or_none)
    # the range in which a budget ends, by its own ranges
    ends = plan.filter(cut).select("source", "part", "before", "rest")
    within = sized.select("source", "part", "inner", "size").alias("d").join(ends.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    sums = within.groupBy("d.source", "inner", "before").agg(F.sum("size").alias("inner_size"))
    so_far = F.sum("inner_size").over(Window.partitionBy("source").orderBy("inner")) - F.col("inner_size")
    sums = stored(sums.select("source", "inner", "inner_size", (F.col("before") + so_far).alias("inner_before")))
    names = [c for c in rows.columns if c not in ("before", "part_size", "source")]
    last = rows.filter(cut).alias("d").join(sums.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.inner") == F.col("p.inner")))
    last = last.select("d.source", *(f"d.{c}" for c in names), F.col("inner_before").alias("before"), F.col("inner_size").alias("part_size"))
    order = Window.partitionBy("source", "part", "inner").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    sorted_ = last.filter(cut).withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - so_far)))
    names = ["doc_id", "source", "size", "source_size", "target", "epochs", "extra", *carried]
    out = simple.select(names).unionByName(last.filter(~cut).withColumn("extra", whole_or_none).select(names)).unionByName(sorted_.select(names))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of docs: a document comes once for each epoch that takes it.

    The document at which a source's budget ends comes with its first words only,
    joined by single spaces; one without words comes with whole epochs only.
    The plan carries the rows in a struct, so null and repeated doc_ids come as the
    plan counts them, and docs may have columns of any name. An empty table gives
    an empty mix.
    """
    rows = plan_mix(docs, carry=True, **options).select("_doc", "epochs", "extra", "size")
    text = F.col("_doc")["text"]
    first = F.array_join(F.slice(F.filter(F.split(text, SPACES), lambda w: w != ""), F.lit(1), F.col("extra").cast("int")), " ")
    none = F.array().cast("array<boolean>")
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("epochs")), lambda i: F.lit(True))
    copies = F.concat(F.when(F.col("epochs") > 0, whole).otherwise(none), F.when(F.col("extra") > 0, F.array(F.lit(False))).otherwise(none))
    out = rows.withColumn("whole", F.explode(copies))
    cut = ~F.col("whole") & (F.col("extra") < F.col("size"))
    out = out.withColumn("text", F.when(cut, first).otherwise(text))
    pick = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        pick["n_chars"] = F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc")["n_chars"])
    return out.select(*(pick.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
