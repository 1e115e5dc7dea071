"""Fill-in-middle against a plain version, with the index's sharing and slots."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallystone.llm import infilling
from tallystone.llm.elias_fano import Offsets

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infilling.MARKS) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm_rate:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.fixture(scope="module")
def marked(spark, odd_docs):
    more = [(50 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", "a<", "< <S <P x>", "1 < 2 > 0 <"])] + [(100 + i, "the same text for many  documents\n") for i in range(60)]
    return odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("slot_rows, rate, spm_rate", [(500, 50, 80), (7, 100, 50)])
def test_outputs_are_those_of_a_plain_version(marked, monkeypatch, slot_rows, rate, spm_rate):
    monkeypatch.setattr(infilling, "SLOT_ROWS", slot_rows)
    want = collections.Counter(plain(r.doc_id, r.text, 42, rate, spm_rate) for r in marked.collect())
    got = infilling.fill_in_middle(marked, 42, rate, spm_rate)
    assert collections.Counter(map(tuple, got.collect())) == want
    texts = collections.Counter(r[0] for r in got.select(infilling.restored()).collect())
    assert texts == collections.Counter(r.text or "" for r in marked.collect())


def test_each_distinct_text_is_listed_once(spark, marked):
    text = F.coalesce("text", F.lit(""))
    rows = marked.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), F.xxhash64(text).alias("probe"))
    index = infilling.text_index(rows).collect()
    assert sorted(r.text for r in index) == sorted({r.text or "" for r in marked.collect()})
    for r in index:
        ends = Offsets(r.width, r.low, r.upper, r.samples).select(range(r.n + 1)).tolist()
        assert ends == [0, *(len(r.text[: m.end()].encode()) for m in TOKEN.finditer(r.text))][: r.n + 1] and len(ends) == len(TOKEN.findall(r.text)) + 1


def test_different_texts_under_one_digest_are_refused(spark):
    rows = spark.createDataFrame([(b"d", "one", 1), (b"d", "two", 1)], "digest binary, text string, probe long")
    with pytest.raises(ValueError):
        infilling.text_index(rows)


def test_a_full_filter_changes_no_result(marked, monkeypatch):
    import numpy as np

    want = sorted(map(str, infilling.infilling_report(marked).collect()))
    monkeypatch.setattr(infilling, "key_filter", lambda keys: np.full(1 << 10, ~np.uint64(0)))
    assert sorted(map(str, infilling.infilling_report(marked).collect())) == want


def test_empty_table(marked):
    assert infilling.infilling_report(marked.limit(0)).collect() == []
