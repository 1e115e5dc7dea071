"""Secrets in texts: fixed patterns, and values in credential contexts by their guess cost.

The guess cost of a value is that of its cheapest segmentation into words, dates,
repeats, keyboard walks and brute-force spans (after Wheeler, zxcvbn, 2016), found
by dynamic programming over its characters. Words are ranked by their number of
occurrences in all documents, behind a short list of well-known passwords. A value
that follows a credential word and costs MIN_BITS or more is added as a span of
kind ``guess``.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, stored

KINDS = ("assign", "access", "hex", "guess")
#: Words of the corpus that the dictionary holds, by count: bounds what is broadcast (some 400 KB).
DICTIONARY_WORDS = 20_000
#: Cost of a value that is reported (a thousand million million guesses).
MIN_BITS = 50.0
#: Cost of each further segment.
JOIN_BITS = 1.0
#: Letters of the dictionary's words, and characters of a unit of a repeat.
WORD_LENGTHS, MOST_UNIT = (3, 16), 16

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words after which a value may be a credential.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "accesskey", "private key", "private_key", "private-key", "privatekey", "credential", "credentials", "authorization", "auth", "bearer", "login")
_WORD = "|".join(re.escape(w) for w in sorted(CONTEXT_WORDS, key=len, reverse=True))
#: The word, then a sign or "is" (nothing for bearer), then the value up to white space, a quote or a bracket.
CONTEXT = re.compile(rf"""(?i:(?<![a-z])(?:{_WORD})(?:["']?[\x20\t]*(?:[:=]+>?|\bis\b)|(?<=bearer)(?=\x20)))[\x20\t]*(?i:bearer\x20+)?["']?([^\x20\x09-\x0D"'<>(){{}}\[\]]+)""", re.A)
_STEMS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer", "login")
_TRAILING = ".,;:!?"

#: Well-known passwords; they rank before the words of the corpus.
COMMON = ("password", "secret", "admin", "welcome", "letmein", "login", "master", "hello", "dragon", "monkey", "football", "baseball", "sunshine", "princess", "shadow", "superman", "iloveyou", "trustno", "changeme", "default", "guest", "root", "user", "test", "example", "sample", "demo", "token", "pass", "access")
#: Characters that stand for letters.
SPELLED = {"4": "a", "@": "a", "3": "e", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "!": "i"}
_PLAIN = [str.maketrans(SPELLED | {"1": one}) for one in "il"]

REFERENCE_YEAR, LEAST_YEARS = 2000, 20
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")


def _places() -> dict[str, tuple[int, int, int, bool]]:
    """Layout, row, column and whether shift is held, of each key; the alphabet is a layout of one row."""
    keys = {}
    for r, (low, high) in enumerate(zip(KEYBOARD, SHIFTED)):
        for shift, row in enumerate((low, high)):
            keys |= {c: (r, i + (r > 0), bool(shift)) for i, c in enumerate(row)}
    return keys


_KEYS = _places()
#: Steps to the neighbours of a key, whose rows are shifted by half a key.
_STEPS = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)}
_DEGREE = math.log2(len(_STEPS))


def _step(a: str, b: str):
    """The direction from one key to a neighbour on the keyboard; None where they are none."""
    p, q = _KEYS.get(a), _KEYS.get(b)
    d = (q[0] - p[0], q[1] - p[1]) if p and q else None
    return d if d in _STEPS else None


def _alphabet(a: str, b: str):
    return ord(b) - ord(a) if a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and a.islower() == b.islower() and abs(ord(b) - ord(a)) == 1 else None


def char_bits(c: str) -> float:
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log2(100)


def variations(marked: int, n: int) -> float:
    """Bits of which of n characters are marked (in upper case, shifted): none, all, or a choice."""
    return 0.0 if marked == 0 else 1.0 if marked == n else math.log2(math.comb(n, marked) + 1)


def word_bits(word: str, ranks: dict[str, int]) -> float | None:
    """The word's rank, its upper-case letters, and a bit for each kind of character that stands for a letter."""
    low = word.lower()
    best = None
    for table in (None, *_PLAIN):
        plain = low if table is None else low.translate(table)
        rank = ranks.get(plain)
        if rank and len(plain) == len(word):
            bits = math.log2(rank) + variations(sum(c.isupper() for c in word), len(word)) + len({a for a, b in zip(low, plain) if a != b})
            best = bits if best is None else min(best, bits)
    return best


_DATE = re.compile(r"(?:(\d{1,2})([-/._]?)(\d{1,2})\2(\d{4}|\d\d)|(\d{4})([-/._]?)(\d{1,2})\6(\d{1,2}))\Z", re.A)


def date_bits(text: str) -> float | None:
    """A year from 1900 to 2099, or a date: the days of a year times the years to it, and its separator."""
    if len(text) == 4 and text.isascii() and text.isdigit() and 1900 <= int(text) <= 2099:
        return math.log2(max(abs(int(text) - REFERENCE_YEAR), LEAST_YEARS))
    m = _DATE.match(text) if 6 <= len(text) <= 10 else None
    if not m:
        return None
    if m[5]:
        year, parts, sep = int(m[5]), (int(m[7]), int(m[8])), m[6]
    else:
        year, parts, sep = int(m[4]), (int(m[1]), int(m[3])), m[2]
        year += 0 if len(m[4]) == 4 else 1900 if year > 50 else 2000
    if not (1900 <= year <= 2099 and min(parts) >= 1 and min(parts) <= 12 and max(parts) <= 31):
        return None
    return math.log2(365 * max(abs(year - REFERENCE_YEAR), LEAST_YEARS)) + (2 if sep else 0)


def walk_bits(text: str, step) -> float:
    """A walk from key to key: its start, length, turns and shifted keys."""
    directions = [step(a, b) for a, b in pairwise(text)]
    turns = 1 + sum(a != b for a, b in pairwise(directions))
    shifted = sum(_KEYS[c][2] for c in text if c in _KEYS)
    return math.log2(len(_KEYS) / 2) + math.log2(len(text)) + turns * _DEGREE + math.log2(math.comb(len(directions) - 1, turns - 1)) + variations(shifted, len(text))


def _runs(value: str, step):
    """Maximal walks of three keys or more."""
    first = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or step(value[i - 1], value[i]) is None:
            if i - first >= 3:
                yield first, i
            first = i


def _repeats(value: str):
    """Maximal runs of a period, cut to whole units: first, last, unit length."""
    for unit in range(1, min(MOST_UNIT, len(value) // 2) + 1):
        first = 0
        for i in range(unit, len(value) + 1):
            if i == len(value) or value[i] != value[i - unit]:
                whole = (i - first) // unit
                if whole >= 2 and whole * unit >= 3:
                    yield first, first + whole * unit, unit
                first = i - unit + 1


def guess_cost(value: str, ranks: dict[str, int], repeats: bool = True) -> tuple[float, list[tuple[str, int, int]]]:
    """Bits of the cheapest segmentation of the value, and its segments (kind, start, end)."""
    n = len(value)
    found: dict[int, list] = {}
    for i in range(n):
        for size in range(WORD_LENGTHS[0], min(WORD_LENGTHS[1], n - i) + 1):
            part = value[i : i + size]
            bits = word_bits(part, ranks)
            if bits is not None:
                found.setdefault(i + size, []).append((bits, "word", i))
            if 4 <= size <= 10 and value[i].isdigit() and (bits := date_bits(part)) is not None:
                found.setdefault(i + size, []).append((bits, "date", i))
    for step in (_step, _alphabet):
        for a, b in _runs(value, step):
            found.setdefault(b, []).append((walk_bits(value[a:b], step), "walk", a))
    if repeats:
        for a, b, unit in _repeats(value):
            bits = guess_cost(value[a : a + unit], ranks, repeats=False)[0] + math.log2((b - a) // unit)
            found.setdefault(b, []).append((bits, "repeat", a))
    # best: of all segmentations of the first j characters; brute: of those whose last segment is brute force
    best, how = [0.0] + [math.inf] * n, [None] * (n + 1)
    brute, since = math.inf, 0
    for j in range(1, n + 1):
        opened = best[j - 1] + (JOIN_BITS if j > 1 else 0)
        if opened <= brute:
            brute, since = opened, j - 1
        brute += char_bits(value[j - 1])
        best[j], how[j] = brute, ("brute", since)
        for bits, kind, i in found.get(j, ()):
            total = best[i] + bits + (JOIN_BITS if i else 0)
            if total < best[j]:
                best[j], how[j] = total, (kind, i)
    segments, j = [], n
    while j:
        kind, i = how[j]
        segments.append((kind, i, j))
        j = i
    return best[n], segments[::-1]


def spans_of(text: str, ranks: dict[str, int], min_bits: float = MIN_BITS) -> list[tuple[int, int, int, float | None]]:
    """Start, number of the kind, end (code points) and guess bits of all spans of a text, in this order."""
    low = text.lower()
    out = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if any(w in low for w in _STEMS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(_TRAILING)
            # no character costs over 7 bits, so short values cannot reach the least
            if 7 * len(value) >= min_bits and (bits := guess_cost(value, ranks)[0]) >= min_bits:
                out.append((m.start(1), 3, m.start(1) + len(value), bits))
    return sorted(out, key=lambda s: s[:3])


def ranked_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """Ranks of COMMON and, behind them, of the corpus's most frequent words (runs of letters); ties in the order of the words.

    Counted over all texts; only the ``most`` first come to the driver.
    """
    few, many = WORD_LENGTHS
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(few, many))
    counts = stored(words.groupBy("word").count())
    # eighths of a power of two: some 500 classes of counts at most tell from where on there are enough words
    size = F.floor(8 * F.log2("count")).cast("int")
    least, n = 0, 0
    for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        least, n = r["size"], n + r["n"]
        if n >= most:
            break
    top = counts.filter(size >= least).orderBy(F.desc("count"), "word").limit(most).select("word").collect()
    ranked = dict.fromkeys([*COMMON, *(r.word for r in top)])
    return {w: i for i, w in enumerate(ranked, 1)}


def secrets(docs: DataFrame, ranks: dict[str, int] | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, found of every whole text: its spans (kind, start, end, bits), by start, kind and end.

    kind: assign, access, hex (fixed patterns), guess (the value after a credential
    word; bits is its guess cost). Offsets are code points, the end exclusive. ranks:
    the dictionary, by default that of the corpus itself. Null and empty texts have
    no spans; rows are kept one by one, also those with null or repeated doc_ids; an
    empty table gives an empty result, and other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(ranked_words(docs) if ranks is None else ranks)

    def run(batches):
        for batch in batches:
            _, off = buffers(batch.column(1))
            for first, last in blocks(off):
                part = batch.slice(first, last - first)
                found = [[{"kind": KINDS[k], "start": a, "end": b, "bits": bits} for a, k, b, bits in spans_of(t, known.value, min_bits)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int,bits:double>>")


def secret_report(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans (``kind:start:end``, comma-joined) of secrets(docs)."""
    found = secrets(docs, ranks)
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *(n(kind) for kind in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
