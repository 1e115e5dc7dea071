"""Alignment of the tokens of two tokenizers over the same bytes.

Python only encodes: each text becomes the ids of both tokenizers and the byte
offsets where their tokens end. All else is Spark: array_intersect of the two
arrays of ends gives the offsets where both end, which cut the tokens into
groups; the last tokens of a group on both sides are linked. Links are counted
over the corpus, and each document's links are looked up in those counts.

Tokens that end together are one a suffix of the other, so the number of linked
id pairs is bounded by the bytes of both vocabularies (some 600 000 pairs for
vocabularies of 50 000 and 32 000), whatever the size of the corpus.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, stored
from .token_counts import SPACE

#: The words of a byte-level vocabulary: fixed values of its file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = [" plain words, and more. don't", "  two  spaces ", " a\nb\n\n c\td\r\n", " naïve straße 中文 \U0001f600", " <|endoftext|> x<|endoftext|>", " 1234 a1b2 ###%%% x_y", " ﬁ①Ａ é\u00a0é", "  "]
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 300_000
#: A run without space, or of space, of this many characters is left to the tokenizers library, whose time does not grow with its square.
LONG_RUN = 500
_LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class ByteLevel:
    """Ids of texts in a byte-level vocabulary file of the tokenizers library; strings of special tokens are plain text.

    Its ranks are merged by tiktoken where the file is of the plain kind, in which
    the order of the merges is that of the ids; otherwise by the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.bytes = [b""] * (max(self.library.get_vocab().values()) + 1)
        for x, i in ranks.items():
            self.bytes[i] = x
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.fast = None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merged = {t: i for t, i in vocabulary.items() if t not in special and len(t) > 1}
        in_order = [t for t, _ in sorted(merged.items(), key=lambda x: x[1])] == ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if in_order:
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={x: i for x, i in ranks.items() if self.library.id_to_token(i) not in special}, special_tokens={})
            if all(fast.encode_ordinary(p) == self.exact(p) for p in _PROBES):
                self.fast = fast.encode_ordinary

    def exact(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids as int32; None where their bytes are not those of the text, which the ranks always give back."""
        quick = [self.fast is not None and max(map(len, t.split()), default=0) < LONG_RUN and not _LONG_SPACE.search(t) for t in texts]
        out = []
        for text, fast in zip(texts, quick):
            ids = self.fast(text) if fast else self.exact(text)
            out.append(array("i", ids).tobytes() if fast or b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else None)
        return out


class Pieces:
    """Ids of texts in a sentencepiece vocabulary.

    Texts whose words single spaces or line ends part are cut before each of them,
    where no piece of the vocabulary reaches across; equal words are encoded once,
    and their tokens compared with their bytes once. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, byte in pieces]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.cut = not any("\n" in p or a != SPACE and b == SPACE for p, byte in pieces if not byte for a, b in zip(p, p[1:] or p))
        self.words: dict[str, bytes | None] = {}

    def whole(self, texts: list[str]) -> list[bytes | None]:
        """Ids as int32; None where their bytes are not those of space + text."""
        found = self.model.encode(texts, num_threads=1)
        ends = np.cumsum([0, *map(len, found)]) * 4
        ids = array("i", chain.from_iterable(found)).tobytes()
        out: list[bytes | None] = [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        if b"".join(map(self.bytes.__getitem__, chain.from_iterable(found))) != (" " + " ".join(texts)).encode():
            for i, (text, x) in enumerate(zip(texts, found)):
                if b"".join(map(self.bytes.__getitem__, x)) != (" " + text).encode():
                    out[i] = None
        return out

    def encode(self, texts: list[str]) -> list[bytes | None]:
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        rows = []
        for text in texts:
            lines = text.replace("\n", " \n")
            rows.append(lines.split(" ") if self.cut and text and "  " not in lines and lines[0] != " " and lines[-1] != " " and SPACE not in text else None)
        new = [w for w in dict.fromkeys(chain.from_iterable(r for r in rows if r)) if w not in self.words]
        for w, ids in zip(new, self.whole(new) if new else []):
            # a line end follows no space, so the space that the library adds is dropped
            self.words[w] = ids[4:] if ids and w[:1] == "\n" else ids
        out = []
        for text, row in zip(texts, rows):
            try:
                out.append(b"".join(map(self.words.__getitem__, row)) if row else self.whole([text])[0])
            except TypeError:  # a word that is not given back
                out.append(None)
        return out


#: Stands for id 0 where it goes on with a group, as there is no negative zero; no id is so large.
_ZERO = -99999999

_TOKENIZERS: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def token_ends(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, and of both tokenizers the ids and ends of each text: a, ends_a, b, ends_b. An end is twice the byte offset in space + text.

    The first tokenizer is given space + text, the second adds the space itself. Null
    and empty texts, and those whose tokens do not give back space + text byte for
    byte, have no tokens.
    """

    def run(batches):
        key = (path_a, path_b)
        one, two = _TOKENIZERS.get(key) or _TOKENIZERS.setdefault(key, (ByteLevel(path_a), Pieces(path_b)))
        gc.disable()  # the many small lists of ids are in no cycles, so looking for some is for nothing
        for batch in batches:
            _, off = buffers(batch.column(1))
            for first, last in blocks(off):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sides = [one.encode([" " + t for t in texts]), two.encode(texts)]
                kept = [bool(t) and a is not None and b is not None for t, a, b in zip(texts, *sides)]
                columns = [part.column(0)]
                for tokenizer, side in zip((one, two), sides):
                    side = [x if ok else b"" for x, ok in zip(side, kept)]
                    at = np.cumsum([0, *map(len, side)]) // 4
                    ids = np.frombuffer(b"".join(side), np.int32)
                    ends = np.concatenate([[0], np.cumsum(tokenizer.lengths[ids])])
                    ends = 2 * (ends[1:] - np.repeat(ends[at[:-1]], np.diff(at)))
                    columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "ends_a", "b", "ends_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, a array<int>, ends_a array<int>, b array<int>, ends_b array<int>")


def aligned(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links of rows of token_ends.

    groups: ``a1,a2|b1;a3|b2,b3``, ids in order, cut wherever both tokens end.
    links: a << 32 | b for the last tokens of each group. A text without tokens has
    no groups and an empty string. All steps are linear in the tokens of a row.
    """
    rows = tokens.withColumn("common", F.array_intersect("ends_a", "ends_b"))
    for side in ("a", "b"):
        # the ends in order, one more where both tokens end: odd marks a group's last token
        rows = rows.withColumn("single", F.array_except(f"ends_{side}", "common"))
        rows = rows.withColumn(f"marks_{side}", F.expr("sort_array(concat(transform(common, e -> e + 1), single))"))

    def grouped(side: str) -> str:
        """Strings of the ids of each group: in one long string, an id that goes on with a group is negative, which its separator shows."""
        signed = f"zip_with({side}, concat(array(1), marks_{side}), (i, x) -> if(x % 2 = 1, i, if(i = 0, {_ZERO}, -i)))"
        return f"split(replace(replace(array_join(cast({signed} AS array<string>), ';'), ';{_ZERO}', ',0'), ';-', ','), ';')"

    last = lambda side: f"array_remove(zip_with({side}, marks_{side}, (i, x) -> if(x % 2 = 1, i, -1)), -1)"
    columns = {f"{kind}_{side}": F.expr(of(side)) for kind, of in (("groups", grouped), ("last", last)) for side in ("a", "b")}
    return rows.select("doc_id", "a", "b", "common", *(c.alias(name) for name, c in columns.items())).select(
        "doc_id",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.size("common").cast("long").alias("n_groups"),
        F.when(F.size("a") > 0, F.array_join(F.expr("zip_with(groups_a, groups_b, (x, y) -> concat(x, '|', y))"), ";")).otherwise("").alias("groups"),
        F.expr("zip_with(last_a, last_b, (x, y) -> shiftleft(cast(x AS bigint), 32) + y)").alias("links"),
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """link, count, best (no other first id has a higher count with this second id) of all links of a column of arrays."""
    counts = stored(links.select(F.explode("links").alias("link")).groupBy("link").count())
    second = F.col("link").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    return counts.join(most, second == F.col("second")).select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    n_best: links whose count in the corpus no other link of their second id exceeds.
    count_sum: the sum of the counts of the document's links. Texts without tokens
    (null, empty, not given back byte for byte) have zeros and '' instead of a digest.
    Null and repeated doc_ids are kept row by row; an empty table gives an empty
    result; other columns are not read, whatever their names. A text of many MB is
    one row of arrays, some 20 bytes a token and step in its task.
    """
    rows = aligned(token_ends(docs, path_a, path_b))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links"))
    # bounded by the bytes of both vocabularies, not by the corpus
    pairs = F.broadcast(pair_counts(rows))
    sums = rows.select("row", F.explode("links").alias("link")).join(pairs, "link").groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
