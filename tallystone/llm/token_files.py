"""Token ids of a corpus as binary files: one id array, document boundaries in Elias-Fano code.

A file is a sequence of blocks and a footer, each followed by a newline byte
(the record separator of the writer):

block   b"TEF1", then 8 little-endian uint32 (id width in bytes, documents, ids,
        low width, bytes of low bits, of upper bits, of samples, flags) and one
        uint64 (ids of this file before the block), then ids, low bits, upper
        bits, samples, and doc_ids as int64; flag 1: a bitmap of null doc_ids follows
footer  b"TEFF", then 3 big-endian uint64: number of the file, documents, ids

The boundaries of a block are its documents' ends, 0 first, relative to it.
Files are numbered in order of doc_id (nulls first), so the offset of a document
in the corpus is the ids of the files before its own, plus its block's, plus
what select returns.
"""

from __future__ import annotations

import gc
import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, shared_dir, stored
from .elias_fano import Offsets, encode

BLOCK_IDS = 1 << 19
#: Pieces whose ids a task remembers; they take some 250 bytes each.
CACHE_ENTRIES = 400_000
#: Marks that a word is looked up without. None of them starts a contraction.
_MARKS = ".,;:!?$%&#*|()"
FOOTER_BYTES = 28
_HEAD = struct.Struct("<4s8IQ")


class Encoder:
    """Whole texts to ids as the tokenizers library gives them, pre-token by pre-token.

    For byte-level BPE whose regular expression never joins a word to what stands
    before the space that leads it, a text may be cut before each single space
    and around each single line end; equal pieces are encoded once. Texts with
    other runs of white space at a cut are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # equal pieces never reach it twice
        with open(path) as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        self.cut = spec.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        vocabulary = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character of a byte-level token is a byte
            self.bytes_of[i] = len(token.encode()) if token in special else len(token)
        # the printable stand-in for each byte in a byte-level vocabulary
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.space = self.stand_in[0x20]
        self.marks: dict[str, bytes] = {}
        self.line_end = self.whole(["\n"])[0]
        self.model = self.tokenizer.model.tokenize
        self.packs: dict[int, struct.Struct] = {}
        self._clear()

    def _clear(self) -> None:
        self.seen, self.ids, self.used = _Numbered(), [], np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that start and end a cut: they are encoded as one text, and told apart by the bytes of their tokens.

        A piece without a leading space goes after a line end.
        """
        texts = [p if p[0] == " " else "\n" + p for p in pieces]
        out: list[bytes] = []
        for a in range(0, len(texts), 2000):
            part = texts[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.kind)
            token_ends = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(p.encode()) for p in part])
            last = np.searchsorted(token_ends, ends) + 1
            if not np.array_equal(token_ends[last - 1], ends):
                raise ValueError("a token reaches across a cut")
            first = np.concatenate([[0], last[:-1]]) + np.array([p[0] == "\n" for p in part])
            raw, w = ids.tobytes(), self.width
            out.extend(raw[x * w : y * w] for x, y in zip(first.tolist(), last.tolist()))
        return out

    def word(self, piece: str) -> bytes:
        """Ids of letters with or without a leading space: one pre-token, so the library's model alone decides."""
        shown = piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(self.stand_in)
        ids = [t.id for t in self.model(shown)]
        pack = self.packs.get(len(ids)) or self.packs.setdefault(len(ids), struct.Struct(f"<{len(ids)}{self.code}"))
        return pack.pack(*ids)

    def learn(self, had: int) -> None:
        """Ids of the pieces seen since there were ``had`` of them; None for one with white space at a cut.

        Letters followed by punctuation are two pre-tokens, so a word is encoded
        once for all the marks that follow it.
        """
        seen, ids = self.seen, self.ids
        ask, plain, stems = [], [], []

        while had < len(seen.new):  # looking up the stems may add some
            new = seen.new[had:]
            ids.extend([None] * len(new))
            for i, p in enumerate(new, had):
                if (p[1:] if p[:1] == " " else p).isalpha():
                    ids[i] = self.word(p)
                elif p == "\n":
                    ids[i] = self.line_end
                elif p.strip() and not p[-1].isspace() and not p[p[0] == " "].isspace():
                    stem = p.rstrip(_MARKS)
                    if len(stem) < len(p) and stem[-1:].isalpha():
                        stems.append((i, seen[stem], p[len(stem) :]))
                    else:
                        ask.append(i)
                        plain.append(p)
            had += len(new)
        for i, x in zip(ask, self.joined(plain)):
            ids[i] = x
        for i, stem, marks in stems:
            if marks not in self.marks:
                self.marks[marks] = self.whole([marks])[0]
            ids[i] = None if ids[stem] is None else ids[stem] + self.marks[marks]

    def forget(self) -> None:
        """Keeps the pieces that were used again, half a dictionary at most."""
        used = np.argsort(-self.used, kind="stable")[: CACHE_ENTRIES // 2]
        used = used[self.used[used] > 1].tolist()
        pieces, ids = self.seen.new, self.ids
        self._clear()
        for i in used:
            self.seen[pieces[i]]
            self.ids.append(ids[i])
        self.used = np.zeros(len(self.ids), np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self.whole(texts)
        gc.disable()  # the many small lists and words below are in no cycles, so looking for some is for nothing
        try:
            return self._by_piece(texts)
        finally:
            gc.enable()

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_ENTRIES:
            self.forget()
        seen, had = self.seen, len(self.ids)
        rows = [None if "\0" in t else list(map(seen.__getitem__, t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))) for t in texts]
        self.learn(had)
        index = np.fromiter(itertools.chain.from_iterable(r for r in rows if r), np.int64)
        used = np.bincount(index, minlength=len(self.ids))
        used[: len(self.used)] += self.used
        self.used = used
        out, odd = [], []
        for i, row in enumerate(rows):
            try:
                out.append(b"".join(map(self.ids.__getitem__, row)) if texts[i] else b"")
            except TypeError:
                out.append(b"")
                odd.append(i)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        return out


class _Numbered(dict):
    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.new)
        self.new.append(key)
        return n


_ENCODERS: dict[str, Encoder] = {}


def block_bytes(doc_ids: list, ids: list[bytes], width: int, before: int) -> bytes:
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype(np.int64)
    low_width, low, upper, samples = encode(ends)
    null = np.array([x is None for x in doc_ids])
    head = _HEAD.pack(b"TEF1", width, len(ids), int(ends[-1]), low_width, len(low), len(upper), len(samples), int(null.any()), before)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
    return b"".join([head, *ids, low, upper, samples, keys, np.packbits(null).tobytes() if null.any() else b""])


def read_blocks(content: bytes):
    """doc_ids (None for null), offsets of the documents' ends, ids, ids before, of each block of a file."""
    at = 0
    while content[at : at + 4] == b"TEF1":
        _, width, docs, n, low_width, n_low, n_upper, n_samples, flags, before = _HEAD.unpack_from(content, at)
        at += _HEAD.size
        ids = np.frombuffer(content, f"<u{width}", n, at)
        at += n * width
        parts = []
        for size in (n_low, n_upper, n_samples):
            parts.append(content[at : at + size])
            at += size
        keys = np.frombuffer(content, "<i8", docs, at).tolist()
        at += 8 * docs
        if flags & 1:
            null = np.unpackbits(np.frombuffer(content, np.uint8, -(-docs // 8), at))[:docs]
            keys = [None if x else k for k, x in zip(keys, null)]
            at += -(-docs // 8)
        yield keys, Offsets(low_width, *parts), ids, before
        at += 1  # the separator
    if content[at : at + 4] != b"TEFF":
        raise ValueError("damaged token file")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Files in ascending order of doc_id; every document ends with end_id. Null text: no ids of its own."""

    def run(batches):
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        end = np.array([end_id], encoder.kind).tobytes()
        keys, ids, held, before, docs_in = [], [], 0, 0, 0
        put = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["value"])
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                for key, x in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    keys.append(key)
                    ids.append(x + end)
                    held += len(ids[-1]) // encoder.width
                    docs_in += 1
                    if held >= BLOCK_IDS:
                        yield put(block_bytes(keys, ids, encoder.width, before))
                        keys, ids, held, before = [], [], 0, before + held
        if keys:
            yield put(block_bytes(keys, ids, encoder.width, before))
        yield put(struct.pack(">4s3Q", b"TEFF", TaskContext.get().partitionId(), docs_in, before + held))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash spreads rows that repeat a doc_id with other texts
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with batch_rows(docs.sparkSession, 1000):
        rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    files = spark.read.format("binaryFile").load(path)
    number = lambda k: F.conv(F.hex(F.substring(F.col("content"), k, 8)), 16, 10).cast("long")
    # one row a file, from its footer; the last byte is the separator
    footers = files.select(number(-FOOTER_BYTES - 1 + 4).alias("file"), number(-FOOTER_BYTES - 1 + 20).alias("ids"))
    footers = stored(footers.groupBy("file").agg(F.sum("ids").alias("ids")))
    bases = stored(footers.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("base")))

    def run(batches):
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist()):
                for keys, offsets, ids, before in read_blocks(content.as_py()):
                    ends = offsets.select(np.arange(len(keys) + 1))
                    wide = memoryview(ids.astype("<u4").view(np.uint8))
                    at = (4 * ends).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends[:-1] + base + before, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    based = files.select("content", number(-FOOTER_BYTES - 1 + 4).alias("file")).join(bases, "file").select("content", "base")
    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what is read back: doc_id, start, n_tokens, ids_crc32.

    Null text is empty and has the end id alone. Null doc_ids come first; rows that
    repeat a doc_id are written each, next to one another. An empty table gives
    an empty result. Other columns are not read, whatever their names. doc_ids are
    whole numbers; one of another type must read as one. A long text is written
    whole, in a block of its own if need be.

    Each shuffle partition becomes a file, which is read back in one piece, and
    Spark reads files of up to 2 GB so: spark.sql.shuffle.partitions must be high
    enough for that.
    """
    path = path or shared_dir(docs.sparkSession) + "/tokens"
    write_token_files(docs, tokenizer_path, end_id, path)
    return read_token_files(docs.sparkSession, path)
