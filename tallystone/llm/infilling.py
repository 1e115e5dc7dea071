"""Fill-in-middle documents from an index of distinct texts.

Texts that stand in several rows are grouped by their whole content and become one
entry each of an index table: the text and the ends of its tokens as an Elias-Fano
list. Documents meet their entry by the SHA-256 of their text; a text that stands
once is its own entry and stays where it lies, told apart by a filter of the
repeated digests (what passes by mistake is an entry with one document). Each
document then selects its two seeded cuts from the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, buffers, key_filter, may_have, stored, word_spans
from .elias_fano import Offsets, encode

MARKS = ("<P>", "<S>", "<M>")
#: Documents of one text that a task joins with its entry: this many, or one in so many of all documents.
SLOT_ROWS, SLOT_SHARE = 500, 20_000
_LIST = "n long, width int, low binary, upper binary, samples binary"


def boundaries(rows: DataFrame, without: np.ndarray | None = None) -> DataFrame:
    """rows with n (tokens) and the Elias-Fano list of the byte offsets 0 and each token's end.

    A token is a run without white space and the white space before it; white space
    at the end is one more. The list is encoded from the whole text. without: a key
    filter; rows whose column ``probe`` may be in it are left out.
    """
    names = rows.columns
    at, probe = names.index("text"), names.index("probe")
    known = rows.sparkSession.sparkContext.broadcast(without) if without is not None else None

    def run(batches):
        for batch in batches:
            if known is not None:
                batch = batch.filter(pa.array(~may_have(known.value, batch.column(probe).to_numpy())))
            data, off = buffers(batch.column(at))
            for first, last in blocks(off):
                edges = off[first : last + 1] - off[first]
                _, ends, before = word_spans(data[off[first] : off[last]], edges, NOT_SPACE)
                lists = []
                for i in range(last - first):
                    size = edges[i + 1] - edges[i]
                    mine = np.concatenate([[0], ends[before[i] : before[i + 1]] - edges[i]])
                    if mine[-1] < size:
                        mine = np.append(mine, size)
                    lists.append((len(mine) - 1, *encode(mine)))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*lists), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *columns], names=[*names, "n", "width", "low", "upper", "samples"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", " + _LIST)


def _inside(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """The rows whose column probe may be in the filter."""
    known = rows.sparkSession.sparkContext.broadcast(known)
    at = rows.columns.index("probe")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_have(known.value, batch.column(at).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def text_index(texts: DataFrame) -> DataFrame:
    """digest, text and boundary list of each distinct text, stored; texts are grouped by their whole content."""
    index = stored(boundaries(texts.distinct()))
    if index.groupBy("digest").count().filter("count > 1").limit(1).count():
        raise ValueError("different texts share a digest")
    return index


def with_boundaries(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), n and the boundary list of each document, made once for each distinct text.

    A text that many documents share is joined in slots of bounded size: copies of
    its entry, and its documents dealt over them by a hash of their ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.withColumn("probe", F.xxhash64("digest"))
    repeated = stored(rows.groupBy("digest", "probe").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    known = key_filter(repeated.select("probe"))
    once = boundaries(rows.select("doc_id", "text", "probe"), without=known)
    index = text_index(_inside(rows.select("digest", "text", "probe"), known))
    # of the digests that fill more than one slot there are SLOT_SHARE at most, however many documents there are
    slot_rows = max(SLOT_ROWS, rows.count() // SLOT_SHARE)
    crowded = F.broadcast(repeated.filter(F.col("copies") > slot_rows).select("digest", F.ceil(F.col("copies") / slot_rows).cast("int").alias("slots")))
    slots = F.coalesce("slots", F.lit(1))
    entries = index.join(crowded, "digest", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots", "probe")
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.monotonically_increasing_id()), slots).cast("int")
    members = _inside(rows.select("doc_id", "digest", "probe"), known).join(crowded, "digest", "left").select("doc_id", "digest", dealt.alias("slot"))
    again = members.join(entries, ["digest", "slot"])
    columns = ["doc_id", "text", "n", "width", "low", "upper", "samples"]
    return once.select(columns).unionByName(again.select(columns))


def seeds(seed: int) -> list[Column]:
    """h1 to h4: the first 8-digit groups of the hex SHA-256 of ``seed:doc_id``, as numbers; a null doc_id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each document.

    form: plain (the text itself; empty and null texts, texts that hold a mark, and
    100 - rate of 100 others), spm of spm_rate of 100 of the rest, or psm. The counts
    of code points are null for plain. Documents with the same doc_id draw the same
    numbers, so repeated rows have repeated results; null doc_ids draw as an id
    without digits. Rows are kept one by one, an empty table gives an empty result,
    and other columns are not read, whatever their names. A text of any length that
    Spark holds in a row is cut as a whole.
    """
    h1, h2, h3, h4 = seeds(seed)
    marked = F.col("text") == ""
    for mark in MARKS:
        marked |= F.contains("text", F.lit(mark))
    form = F.when(marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = with_boundaries(docs).select("doc_id", "text", "n", "width", "low", "upper", "samples", form.alias("form"), F.least(x, y).alias("first"), F.greatest(x, y).alias("second"))
    p, s, m = (mark.encode() for mark in MARKS)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for a, b in blocks(off):
                part = batch.slice(a, b - a)
                out, chars = [], []
                for i, (width, low, upper, samples, kind, first, second) in enumerate(zip(*(c.to_pylist() for c in part.columns[3:])), a):
                    text = data[off[i] : off[i + 1]]
                    if kind == "plain":
                        out.append(text.tobytes())
                        chars.append((None, None))
                        continue
                    cuts = Offsets(width, low, upper, samples).select([first, second]).tolist()
                    begins = (text[: cuts[1]] & 0xC0) != 0x80  # the first bytes of characters
                    chars.append((int(begins[: cuts[0]].sum()), int(begins[cuts[0] :].sum())))
                    raw = text.tobytes()
                    prefix, middle, suffix = raw[: cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] :]
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if kind == "spm" else (p, prefix, s, suffix, m, middle)))
                prefix_chars, middle_chars = zip(*chars)
                columns = [part.column(0), part.column(2), part.column(7), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from: it holds no mark itself, so the marks alone cut it."""
    p, s, m = MARKS
    psm = F.split(F.substring(output, len(p) + 1, 2**31 - 1), f"{s}|{m}", -1)
    spm = F.split(F.substring(output, len(s) + 1, 2**31 - 1), f"{p}|{m}", -1)
    return F.when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1])).when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(F.col(output))


def infilling_report(docs: DataFrame, seed: int = 42) -> DataFrame:
    """fill_in_middle with digests of the output and of the text rebuilt from it instead of the texts."""
    return fill_in_middle(docs, seed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
