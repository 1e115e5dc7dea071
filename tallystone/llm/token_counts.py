"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

Texts are cut into pre-tokens before spaces, and pre-tokens again between any two
characters that stand side by side in no piece of the vocabulary, as no merge
can reach across. The sequences of distinct pre-tokens of a batch lie one after
the other in flat arrays; each step merges, in every sequence at once, the pairs
of its lowest rank, until no pair is left. What survives are the tokens. Where a
merged piece could join its neighbour at no higher rank than its own, the step
of that sequence ends there, as the library would look at that neighbour next.
Counts of pre-tokens seen before are kept in a dictionary of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_NONE = np.int32(np.iinfo(np.int32).max)
#: Pre-tokens the dictionary holds before it is emptied.
CACHE_ENTRIES = 500_000
#: Bits of the table of characters side by side; a wrong answer only leaves a cut out.
_SIDE_BITS = 22
_PROBES = ["", " ", "  two  spaces ", "plain words, and more.", "ﬁ ① Ａ é Å", "a\nb\n\nc\td", "naïve straße 中文 \U0001f600\U0001f600", "<s> </s> <unk> <0x0A> ▁x"]


class Merger:
    """Pair ranks of one vocabulary, and counts by them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(model.get_piece_size()):
            if model.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece reaches across a space")
        self.newline = any("\n" in p for p in pieces)
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        symbol = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                symbol.setdefault(c, len(symbol))
        self.cost = np.array([1 if i < len(pieces) else len(s.encode()) for s, i in symbol.items()], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        keys, values = [], []
        for p, s in zip(pieces, scores):
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append((rank[s], symbol[p]))
        keys, values = np.array(keys, np.int64), np.array(values, np.int32).reshape(-1, 2)
        self._table(keys, values)
        # a piece whose pairs all have higher ranks than its own may be merged in many places at once
        own = np.full(len(symbol), -1, np.int32)
        own[[symbol[p] for p in pieces]] = [rank[s] for s in scores]
        best = np.full(len(symbol), _NONE, np.int32)
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(best, side, values[:, 0])
        self.alone = best <= own
        self.side = np.zeros(1 << _SIDE_BITS, bool)
        beside = np.array([(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:])], np.uint32).reshape(-1, 2)
        self.side[self._side(beside[:, 0], beside[:, 1])] = True
        for text in _PROBES:
            if self.count([text])[0] != len(model.encode(text)):
                raise ValueError(f"this model normalises or splits texts in a way that is not supported: {text!r}")

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full((1 << bits, 2), _NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys at once
            free = self.keys[slot[left]] == -1
            at, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SIDE_BITS)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair; _NONE where there is none."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(keys)
        out = np.full((len(keys), 2), _NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        while len(left):
            have = self.keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (have != -1)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (with its spaces already marked)."""
        counts = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        code = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        if not len(code):
            return counts
        begins = np.zeros(len(code), bool)
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        begins[1:] |= ~self.side[self._side(code[:-1], code[1:])]
        # sequences that merge by themselves, and the pre-token of each
        start = np.flatnonzero(begins)
        word = np.repeat(np.arange(len(tokens)), lengths)[start]
        length = np.diff(np.append(start, len(code)))
        sym = self.of_char[code]
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):  # their UTF-8 bytes are tokens, and nothing merges with them
            c = code[unknown]
            size = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
            np.add.at(counts, np.repeat(word, length)[unknown], size)
        rank = np.full(len(sym), _NONE, np.int32)
        at = np.flatnonzero(~begins) - 1
        rank[at] = self.find(sym[at], sym[at + 1])[:, 0]
        while len(word):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            if done.any():
                ended = np.repeat(done, length)
                left = sym[ended]
                cost = np.where(left >= 0, self.cost[left], 0)
                ends = np.cumsum(length[done])
                np.add.at(counts, word[done], np.add.reduceat(cost, ends - length[done]))
                sym, rank = sym[~ended], rank[~ended]
                word, length, best = word[~done], length[~done], best[~done]
                if not len(word):
                    break
                start = np.cumsum(length) - length
            owner = np.repeat(np.arange(len(word)), length)
            at = np.flatnonzero(rank == best[owner])
            to = self.find(sym[at], sym[at + 1])[:, 1]
            # of places that overlap, every second one of a run
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.flatnonzero(fresh)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1
            at, to = at[odd == 0], to[odd == 0]
            ask = np.flatnonzero(self.alone[to])
            if len(ask):
                at, to = self._in_order(sym, best, owner, start, length, at, to, ask)
            sym[at] = to
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            length = length - np.bincount(owner[at], minlength=len(word))
            sym, rank, owner, at = sym[keep], rank[keep], owner[keep], at - np.arange(len(at))
            last = np.append(owner[1:] != owner[:-1], True)
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            changed = np.flatnonzero(changed)
            rank[changed] = _NONE
            changed = changed[~last[changed]]
            rank[changed] = self.find(sym[changed], sym[changed + 1])[:, 0]
        return counts

    def _in_order(self, sym, best, owner, start, length, at, to, ask):
        """The places of each sequence up to the first whose merged piece has a pair of a rank no higher than the step's."""
        p, mine = at[ask], owner[at[ask]]
        beside = np.zeros(len(at), bool)
        beside[1:] = at[1:] == at[:-1] + 2
        left = np.where(beside[ask], to[np.maximum(ask - 1, 0)], sym[np.maximum(p - 1, 0)])
        has_left, has_right = p > start[mine], p + 2 < start[mine] + length[mine]
        before = np.where(has_left, self.find(left, to[ask])[:, 0], _NONE)
        after = np.where(has_right, self.find(to[ask], sym[np.minimum(p + 2, len(sym) - 1)])[:, 0], _NONE)
        stop = np.zeros(len(at), np.int64)
        stop[ask] = np.minimum(before, after) <= best[mine]
        seen = np.cumsum(stop) - stop
        first = np.ones(len(at), bool)
        first[1:] = owner[at[1:]] != owner[at[:-1]]
        begin = np.flatnonzero(first)
        keep = seen == np.repeat(seen[begin], np.diff(np.append(begin, len(at))))
        return at[keep], to[keep]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        seen = self.__dict__.setdefault("seen", _Index())
        if len(seen.new) > CACHE_ENTRIES:
            seen = self.seen = _Index()
        had = len(seen.new)
        index, ends = [], []
        for text in texts:
            index.extend(map(seen.__getitem__, self.split(text)))
            ends.append(len(index))
        # a key is a pre-token after a space, or, from its first character on, after a line's end
        new = [x if x[:1] == SPACE else x[1:] if x[:1] == "\n" and not self.newline else SPACE + x for x in seen.new[had:]]
        extra = np.array([x[:1] == "\n" and not self.newline for x in seen.new[had:]], np.int64)
        seen.counts = np.concatenate([seen.counts, self.merge(new) + extra]) if new else seen.counts
        total = np.concatenate([[0], np.cumsum(seen.counts[np.array(index, np.int64)])])
        return np.diff(total[np.array([0, *ends])])

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and not self.newline:
            lines = text.replace("\n", " \n")
            if "  " not in lines and lines[0] != " " and lines[-1] != " ":
                return lines.split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        # a run of spaces belongs to what follows it; what stands before the first run cannot occur
        return re.findall(f"{SPACE}+[^{SPACE}]*", marked)


class _Index(dict):
    """Number of each key in order of its first use."""

    def __init__(self):
        self.new: list[str] = []
        self.counts = np.zeros(0, np.int64)

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.new)
        self.new.append(key)
        return n


_MERGERS: dict[str, Merger] = {}


def token_counts(docs: DataFrame, model_path: str, most_tokens: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > most_tokens) of every whole text.

    Counts are those of the sentencepiece library without begin or end tokens.
    Null text counts as empty: no bytes, no tokens. Null and repeated doc_ids are
    kept row by row; an empty table gives an empty result. Other columns are not
    read, whatever their names. A text of any length that Spark holds in a row is
    counted whole.
    """

    def run(batches):
        merger = _MERGERS.get(model_path) or _MERGERS.setdefault(model_path, Merger(model_path))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = merger.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(n > most_tokens)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
