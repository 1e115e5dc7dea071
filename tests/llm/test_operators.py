"""Each operator against a plain version on small tables, and its answers to odd input."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallystone.llm import archives, decontaminate, elias_fano, line_dedup, mixing, near_dedup, quality_model, quality_rules, token_counts, token_files, toxicity
from tallystone.llm import common
from tallystone.llm.queries import oracle_sql, queries

tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def invented(seed, n, syllables="the an er on ti re ou st".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = []
    base = invented(1, 120)
    for i in range(12):  # near copies: one word in forty differs
        w = base.split()
        for k in range(i % 4):
            w[40 * k % len(w)] = f"x{i}{k}"
        rows.append(" ".join(w))
    rows += [invented(2, 60)] * 5 + [None, "", " \n\t ", "one", "Two words", "a b c d"]
    rows += [invented(100 + i, r.randint(1, 90)) for i in range(30)]
    rows += ["x" * 5000, "line\n\nline\r\n " * 40, "naïve straße 中文 😀 <|endoftext|> <s> don't  stop", invented(7, 6000)]
    rows += ["Of Of Of Of Of Of Of Of Of Of Of Of Of Of", "a### b*** c&&& d### e*** f$$$ g%%% h### i*** j&&& k###"]
    return spark.createDataFrame([(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Null ids, repeated rows, a repeated id with another text, and columns with clashing names."""
    very_long = invented(8, 60000) + "\n" + "z" * 600000
    more = spark.createDataFrame([(900, very_long, "en", "s2", 5), (None, invented(1, 120), None, None, None), (None, None, None, None, None), (3, "another text for an id that is there already", "en", "s1", 3)], SCHEMA)
    extra = {c: F.lit("mine") for c in ("score", "key", "row", "salt", "hash", "n_words", "size", "bucket", "id", "part", "hit_items", "hit_spans", "label", "extra", "epochs", "_size", "_score", "_doc", "_whole", "block", "root", "digest", "inner", "text_a", "n_tokens")}
    return docs.unionByName(more).unionByName(docs.filter("doc_id < 3")).withColumns(extra)


# --- shared helpers ---------------------------------------------------------


def test_word_spans_and_hashes_are_those_of_a_regular_expression():
    rows = ["", "a", " a b ", "ab\x1c cd\n", "é ü", "a" * 300, "x y"]
    data = "".join(rows).encode()
    off = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    start, end, first = common.word_spans(np.frombuffer(data, np.uint8), off, common.NOT_SPACE)
    h = common.span_hashes(np.frombuffer(data, np.uint8), start, end)
    seen = {}
    for i, r in enumerate(rows):
        got = [data[start[k] : end[k]].decode() for k in range(first[i], first[i + 1])]
        assert got == words(r)
        for k, w in zip(range(first[i], first[i + 1]), got):
            assert seen.setdefault(w, h[k]) == h[k]
    assert len(set(seen.values())) == len(seen)


def test_key_filter_never_loses_a_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    f = common.key_filter(keys, bits=16)
    assert common.may_have(f, np.array([r.k for r in keys.collect()])).all()
    assert common.may_have(f, np.arange(20000) * 7919 + 3).mean() < 0.2
    assert not common.may_have(common.key_filter(keys.limit(0), bits=16), np.arange(10)).any()


# --- 1 and 4: classifiers ---------------------------------------------------


def labelled(spark, n=240):
    bad = ["scum", "idiot", "loser"]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 3 == 0, i % 4 == 0
        w = invented(i, 40).split()
        if toxic:
            w.insert(i % 40, bad[i % 7 % 3])
        text = " ".join(w)
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, run, label, mod, rest", [(toxicity, toxicity.toxicity, "toxic", 4, 2), (quality_model, quality_model.quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows_and_odd_tables(spark, odd, module, run, label, mod, rest):
    d, labels = labelled(spark)
    d = d.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "scum idiot loser")], "doc_id long, text string"))
    held = common.crc_mod("doc_id", mod) == rest
    got = run(d, labels, held, per_class=100).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % mod == rest) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.8 * len(out)
    # labels of held-out rows are never looked at
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    again = run(d, flipped, held, per_class=100).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got}, nan_ok=True)
    assert run(odd, labels.limit(0), held).agg(F.max("score")).first()[0] < 1e-6
    assert run(odd.limit(0), labels, held, per_class=100).count() == 0


def test_network_gradients_are_those_of_differences():
    m = quality_model.new_model()
    r = np.random.default_rng(0)
    rows = [bytes(r.integers(32, 120, size=n).astype(np.uint8)) for n in (0, 5, 300, 1000)]
    data, off = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    label, weight = np.array([0, 1, 0, 1], np.float32), np.ones(4, np.float32)
    g = quality_model.gradients(m, data, off, label, weight)

    def loss():
        p = quality_model.probabilities(m, data, off)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for k in ("combine", "chunk", "hidden", "conv", "embed"):
        flat = m[k].reshape(-1)
        i = int(np.abs(g[k]).argmax())
        before, step = flat[i], 3e-3
        flat[i] = before + step
        up = loss()
        flat[i] = before - step
        down = loss()
        flat[i] = before
        assert g[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.15, abs=2e-3), k


def test_network_scores_are_those_of_a_plain_forward_pass():
    m = quality_model.new_model(3)
    r = np.random.default_rng(4)
    rows = [b"", b"a", bytes(range(256)), *(bytes(r.integers(0, 256, size=n).astype(np.uint8)) for n in (63, 64, 65, 300, 2500))]
    got = quality_model.probabilities(m, np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
    width, stride, cell = quality_model.WIDTH, quality_model.STRIDE, quality_model.CELL
    for text, p in zip(rows, got):
        cells = max(1, -(-len(text) // (cell * stride)))
        raw = text.ljust(cells * cell * stride, b"\0")
        of_cell = []
        for c in range(cells):
            windows = [raw[i : i + width] for i in range(c * cell * stride, (c + 1) * cell * stride, stride) if i + width <= len(raw)]
            of_cell.append(np.max([sum(m["embed"][b] @ m["conv"][k * quality_model.EMBED : (k + 1) * quality_model.EMBED] for k, b in enumerate(w)) for w in windows], axis=0))
        starts = range(0, max(1, cells - quality_model.CHUNK + 1), quality_model.HOP)
        starts = sorted({*starts, max(0, cells - quality_model.CHUNK)})
        z = [float(np.maximum(np.max(of_cell[s : s + quality_model.CHUNK], axis=0) @ m["hidden"] + m["hidden_bias"], 0) @ m["chunk"]) for s in starts]
        logit = np.array([max(z), min(z), np.mean(z), np.log1p(len(text)) / 8]) @ m["combine"] + m["bias"][0]
        assert p == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_toxicity_scores_are_those_of_a_plain_sum(spark):
    d, labels = labelled(spark)
    weights, bias = toxicity.fit(d.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")))
    rows = [None, "", "scum", "You SCUM, you idiot!  ñandú İ ẞ 😀😀", invented(3, 400), "idiot " * 3000]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), weights, bias).orderBy("doc_id").collect()]
    buckets = lambda gram: int(toxicity.mix(np.uint64([gram]))[0] >> np.uint64(64 - toxicity.BITS))
    for text, p in zip(rows, got):
        code = [0x20, *(ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 0x10000 else ord(c) for c in text or ""), 0x20]
        grams = set()
        for n in toxicity.ORDERS:
            for i in range(len(code) - n + 1):
                h = 0
                for c in code[i : i + n]:
                    h = (h * 0x100000001B3 + c + 1) % (1 << 64)
                grams.add(buckets((h + n - 1) % (1 << 64)))
        z = bias + sum(float(weights[g]) for g in grams)
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    assert got[2] > got[1]


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 1000, 5000):
        cells, cell_off, first, doc, length = quality_model.layout(np.array([0, n]))
        covered = set()
        for a, k in zip(first, length):
            covered.update(range(a, a + k))
        assert covered == set(range(cells[0])) and cells[0] * quality_model.CELL * quality_model.STRIDE >= n


# --- 2: archives ------------------------------------------------------------


def test_archives_round_trip_with_revisits(spark):
    rows = [(5, "http://a/ b", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, "<p>é</p>"), (4, "http://c/", None), (7, "http://d/", ""), (8, "http://e/", "x\r\n\r\nWARC/1.0\r\n\r\ny\n\n"), (None, "http://f/", "<p>é</p>"), (11, "http://g/", "z" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in archives.archived_pages(pages.withColumn("record_type", F.lit("mine"))).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3), 4: ("response", None), 7: ("revisit", 4), 8: ("response", None), 11: ("response", None)}
    assert got[5].url == "http://a/%20b" and got[9].url == "-"
    large = {r.page_id: r.record_type for r in archives.archived_pages(pages, least_bytes=5).collect()}
    assert large[7] == "response" and large[5] == "revisit"
    assert archives.archived_pages(pages.limit(0)).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        raw = archives.arc_description(version, "x.arc", "20200102030405") + b"\n" + archives.arc_record(version, "http://a/", "1.2.3.4", "20200102030405", "text/html", b"body\n\n") + b"\n"
        import gzip

        (got,) = list(archives.arc_records(gzip.compress(raw)))
        assert got[0] == version and got[2] == b"body\n\n" and got[1]["IP-address"] == "1.2.3.4" and set(got[1]) == set(archives.ARC_FIELDS[version])
        with pytest.raises(ValueError):
            list(archives.arc_records(gzip.compress(raw[:-5])))
    assert archives.warc_date("20200102030405") == "2020-01-02T03:04:05Z"


def test_records_that_are_no_http_messages_and_damaged_files(spark, tmp_path):
    import gzip

    record = lambda body, url="http://a/": archives.arc_record(1, url, "1.2.3.4", "20200102030405", "text/dns", body) + b"\n"
    head = archives.arc_description(1, "x.arc", "20200102030405") + b"\n"
    page = lambda key: b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX-Record-Key: " + key + b"\r\n\r\nsame"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(head + record(b"20200102 dns answer") + record(page(b"7")) + record(page(b"no number")) + record(page(b"9"))))
    (tmp_path / "arc" / "b.arc.gz").write_bytes(gzip.compress(head + record(page(b"3")) + b"http://b/ 1.2.3.4 20200102030405 text/html many\n"))
    (tmp_path / "arc" / "c.arc.gz").write_bytes(gzip.compress(head + record(b"x" * 1000))[:-30])
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    with pytest.raises(Exception, match="length|Damaged|End-of-stream|EOF"):
        archives.read_arc(spark, arc).collect()
    archives.convert(spark, arc, warc, damaged="leave")
    rows = archives.read_warc(spark, warc).collect()
    assert sorted((r.record_type, r.record_key or "", r.refers_to_key or "", r.payload_bytes) for r in rows) == sorted([("response", "", "", 19), ("response", "3", "", 4), ("revisit", "7", "3", 4), ("revisit", "9", "3", 4), ("revisit", "no number", "3", 4)])


# --- 3: line chunks ---------------------------------------------------------


def test_repeated_chunks_leave_all_but_their_first_place(spark, docs):
    passage = "\n".join(invented(900 + i, 12) for i in range(8))
    long = invented(77, 70)
    rows = [(i, invented(i, 30) + "\n" + (passage + "\n" if i % 2 else "") + invented(50 + i, 9) + ("\n" + long if i in (2, 5) else ""), "en", "s", 0) for i in range(8)]
    d = docs.filter("doc_id >= 10").unionByName(spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows], SCHEMA)).withColumn("n_lines", F.lit("mine"))
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(d).collect()}
    source = {r.doc_id: r.text for r in d.collect()}
    count = collections.Counter(x for t in source.values() if t is not None for x in t.split("\n"))
    places = collections.defaultdict(list)
    for i, t in sorted(source.items()):
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        lines = t.split("\n")
        b = np.frombuffer(t.encode(), np.uint8)
        again = np.array([count[x] > 1 for x in lines])
        _, first, n, *_ = line_dedup.line_chunks(b, np.array([0, len(b)]), line_dedup.DIVISOR, line_dedup.LONG_WORDS, lambda h: again)
        assert sum(again) == n.sum()
        for f, k in zip(first.tolist(), n.tolist()):
            part = lines[f : f + k]
            if sum(bool(words(x)) for x in part) >= 2 or len(words(" ".join(part))) >= line_dedup.LONG_WORDS:
                places["\n".join(part)].append((i, f, k))
    gone = collections.defaultdict(set)
    for where in places.values():
        for i, f, k in where[1:]:
            gone[i].update(range(f, f + k))
    for i, t in source.items():
        if t is not None:
            assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            assert got[i].n_removed_lines == len(gone[i])
    assert long in got[1002].text and long not in got[1005].text
    assert passage in got[1001].text and all(got[1000 + i].n_removed_lines == 8 + (i == 5) for i in (3, 5, 7))
    assert line_dedup.remove_repeated_chunks(d.limit(0)).count() == 0


def test_a_full_line_filter_changes_no_result(spark, monkeypatch):
    # a unique line that the filter lets through by mistake stands before a passage of short lines
    passage = "\n".join(invented(900 + i, 12) for i in range(3))
    d = spark.createDataFrame([(i, invented(i, 30) + "\n" + passage + "\n" + invented(50 + i, 9), "en", "s", 0) for i in range(8)], SCHEMA)
    monkeypatch.setattr(line_dedup, "key_filter", lambda keys: np.full(1 << 6, ~np.uint64(0)))
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(d).collect()}
    assert got[0].n_removed_lines == 0
    assert all(got[i].text == invented(i, 30) + "\n" + invented(50 + i, 9) for i in range(1, 8))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_short_passages_go_from_copied_documents_and_after_blank_lines(spark, n):
    passage = [invented(900 + i, 12) for i in range(n)]
    body = lambda k: [invented(100 * k + j, 8) for j in range(6)]
    planted = lambda k: body(k)[:3] + passage + body(k)[3:]
    lines = {0: planted(1), 1: planted(2), 2: planted(2), 3: body(3)[:3] + [""] + passage + ["", *body(3)[3:]], 4: planted(4), 5: ["x", "", "y"]}
    d = spark.createDataFrame([(i, "\n".join(x), "en", "s", 0) for i, x in lines.items()], SCHEMA)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.remove_repeated_chunks(d).collect()}
    assert got[0] == lines[0] and got[5] == lines[5]
    # the passage stands in document 0 and the copied body in document 1
    assert got[1] == body(2) and got[4] == body(4) and [x for x in got[3] if x] == body(3)
    assert not set(got[2]) & set(lines[2])


def test_chunk_boundaries_resist_shifts():
    lines = [invented(i, 5) for i in range(200)]

    def chunks(x):
        b = np.frombuffer("\n".join(x).encode(), np.uint8)
        _, first, n, *_ = line_dedup.line_chunks(b, np.array([0, len(b)]), 3, 50, lambda h: np.ones(len(h), bool))
        return {"\n".join(x[f : f + k]) for f, k in zip(first.tolist(), n.tolist())}

    assert len(chunks(lines) & chunks(["new", *lines])) >= len(chunks(lines)) - 2


def test_line_dedup_on_odd_tables(odd):
    out = line_dedup.remove_repeated_chunks(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)


# --- 5: decontamination -----------------------------------------------------

ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def benchmark(spark):
    base = invented(1, 120).split()
    rows = [(1, " ".join(base[20:45])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, "one"), (6, " ".join(base[30:60]).upper()), (6, "naïve straße"), (None, invented(2, 15))]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_hits_are_those_of_every_window(spark, docs, texts, benchmark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXT_BYTES", block)
    windows = {}
    for item, t in [(r.item_id, r.text) for r in benchmark.collect()]:
        w = ITEM.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).update([] if item is None else [str(item)])
    got = {r.doc_id: r for r in decontaminate.report(docs, benchmark).collect()}
    for i, t in texts.items():
        w, hit, items = ITEM.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    items |= windows[tuple(w[p : p + k])]
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        assert want == (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated)
    assert sum(r.contaminated for r in got.values()) >= 15


def test_spans_or_documents_go(odd, benchmark):
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and not decontaminate.report(kept, benchmark).filter("contaminated").count()
    assert kept.count() + decontaminate.report(odd, benchmark).filter("contaminated").count() == odd.count()
    cut = decontaminate.decontaminate(odd, benchmark, remove="spans")
    assert cut.count() == odd.count()
    assert {r.text for r in cut.filter("doc_id = 21").collect()} == {""}
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    assert not rows(kept) - rows(odd) and not rows(cut.drop("text")) - rows(odd.drop("text"))
    assert decontaminate.report(odd.limit(0), benchmark).count() == 0
    assert decontaminate.report(odd, benchmark.limit(0)).filter("contaminated").count() == 0


# --- 6: near duplicates -----------------------------------------------------


def groups(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_are_those_of_all_pairs(docs, texts):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, words=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == groups(texts, 4, 80)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_a_chain_of_near_copies_is_one_group_and_a_crowd_below_the_threshold_is_none(spark):
    base = invented(11, 200).split()
    chain = [" ".join(base[: 200 - 6 * i]) for i in range(12)]  # neighbours are near, ends are not
    crowd = []
    for i in range(60):  # like one text, but not enough like each other
        w = invented(12, 100).split()
        r = random.Random(i)
        for p in r.sample(range(100), 4):
            w[p] = f"y{i}{p}"
        crowd.append(" ".join(w))
    rows = dict(enumerate(chain + crowd))
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d, words=4).collect()}
    assert got == groups(rows, 4, 80)
    assert {got[i][1] for i in range(12)} == {0}


def test_pairs_under_the_signature_distance_always_share_a_key(spark):
    r = np.random.default_rng(1)
    n = near_dedup.CHUNKS * near_dedup.CHUNK_SIZE
    a = r.integers(0, 1 << 16, n).astype(np.uint16)
    rows = [(0, bytearray(a.tobytes()))]
    for i in range(1, 60):
        b = a.copy()
        at = r.choice(n, near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1, replace=False)
        b[at] += 1
        rows.append((i, bytearray(b.tobytes())))
    keys = near_dedup.chunk_keys(spark.createDataFrame(rows, "id long, signature binary"), near_dedup.CHUNKS, near_dedup.CHUNK_SIZE, near_dedup.ERRORS)
    first = keys.filter("id = 0").select("key")
    assert keys.join(first, "key", "left_semi").select("id").distinct().count() == 60


@pytest.mark.parametrize("salt_rows", [7, 40])
def test_crowded_buckets_in_small_blocks_give_the_same_groups(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(near_dedup, "SALT_ROWS", salt_rows)
    rows = {}
    for i in range(160):  # one passage in all, so that the sets are alike but mostly not near
        r = random.Random(i // 2)
        own = "".join(f" q{i // 2}{k}" for k in range(r.randint(5, 45)))
        rows[i] = invented(12, 90) + own + (f" last{i}" if i % 4 == 1 else "")
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d, words=4).collect()}
    assert got == groups(rows, 4, 80)


def test_a_doc_id_with_several_texts_joins_their_groups(spark):
    x, y, z = invented(21, 40), invented(22, 40), invented(23, 40)
    rows = [(1, x), (2, x), (2, y), (2, y), (5, z), (6, z), (6, y), (7, "other words of its own here"), (2, None), (5, z)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles > 0, r.component_id) for r in got) == collections.Counter((i, bool(t), 7 if i == 7 else 1 if t else 2) for i, t in rows)


def test_near_duplicates_of_odd_tables(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 90)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(91)} | {1000 + i: 1000 for i in range(80)}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7: rules ---------------------------------------------------------------


def plain_measures(t):
    t = t or ""
    w = words(t)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measures_and_verdicts(odd):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd), quality_rules.V2).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text), r.text
        assert r.kept == (r.fail_bits & quality_rules.V2.mask == 0)
        assert bool(r.fail_bits & quality_rules.BASE.mask) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_ablations_count_what_a_policy_without_a_rule_keeps(docs):
    led = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablations(led, quality_rules.V2).collect():
        bit, mask = quality_rules.BIT[r.rule], quality_rules.V2.mask
        assert (r.n_failed, r.n_only) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits))
        assert (r.n_kept_without, r.n_kept) == (sum(not b & mask & ~bit for b in bits), sum(not b & mask for b in bits))
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_native_operators_have_no_python_in_their_plans(docs):
    for df in (quality_rules.ledger(docs), mixing.plan_mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- 8: token files ---------------------------------------------------------


def test_elias_fano_round_trip_and_size():
    r = np.random.default_rng(3)
    for values in ([0], [0, 0, 0], [0, 7], [0, 1 << 40], np.concatenate([[0], np.cumsum(r.integers(0, 900, 5000))]), np.concatenate([[0], np.cumsum(r.integers(0, 2, 3000))])):
        values = np.array(values, np.int64)
        coded = elias_fano.encode(values)
        got = elias_fano.Offsets(*coded)
        assert (got.select(np.arange(len(values))) == values).all() and got.select(len(values) - 1)[0] == values[-1]
    assert sum(map(len, elias_fano.encode(np.arange(100000) * 500)[1:])) < 100000 * 1.6


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_token_files_are_those_of_the_library(docs, texts, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.token_files(docs, path, 2).collect()}
    at = 0
    for i in sorted(texts):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_encoder_cuts_only_where_the_library_does(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 200)
    e = token_files.Encoder(tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = list("aetn  \n\t.,'é中1") + ["ab.", "the,", "on!!", "it's.", " \n", "<|endoftext|>", "\0", "😀", " ", "\x1c"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    got = [x for a in range(0, len(rows), 60) for x in e.encode(rows[a : a + 60])]
    assert got == e.whole(rows)


def test_token_files_of_odd_tables(odd):
    path = tokenizers.path("byte_bpe_50k.json")
    got = token_files.token_files(odd, path, 2).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert token_files.token_files(odd.limit(0), path, 2).count() == 0


# --- 9: mixing --------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("ranges, inner_bits", [(1, 1), (1, 10), (3, 4), (1024, 10)])
def test_mix_takes_each_sources_target(docs, texts, monkeypatch, ranges, inner_bits):
    monkeypatch.setattr(mixing, "INNER_BITS", inner_bits)
    rows = mixing.plan_mix(docs, ranges=ranges).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    targets = plain_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
    for s, t in targets.items():
        assert taken[s] == int(t + 1e-9)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.plan_mix(docs.repartition(5)).collect())


def test_mixed_documents_have_the_words_of_the_plan(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words_ = collections.Counter()
    for r in out.collect():
        words_[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in words_.items() if v} == {r.doc_id: r.taken for r in mixing.plan_mix(docs).collect() if r.taken}


def test_mix_of_odd_tables(odd, docs):
    assert mixing.plan_mix(odd).count() == odd.count()
    assert mixing.plan_mix(odd.limit(0)).count() == 0
    assert mixing.plan_mix(docs.filter("doc_id = 17")).first().taken == 0


def test_mixed_documents_of_the_odd_table_have_the_words_of_the_plan(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    got, want = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    for r in mixing.plan_mix(odd).collect():
        want[r.doc_id] += r.taken
    assert +got == +want and got[None]


def test_only_equal_or_linked_rows_of_a_doc_id_go(odd):
    texts_ = collections.Counter((r.doc_id, r.text) for r in near_dedup.without_linked_repeats(odd).collect())
    assert texts_ == collections.Counter({(r.doc_id, r.text): 1 for r in odd.collect()})
    near = odd.filter("doc_id = 3 and text like 'another%'").unionByName(odd.filter("doc_id < 3").withColumn("doc_id", F.lit(3).cast("long")))
    assert near_dedup.without_linked_repeats(near, words=4).count() == 2


# --- 10: token counts -------------------------------------------------------


def test_counts_are_those_of_the_library(odd):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.token_counts(odd, path, most_tokens=1000).collect()
    source = collections.Counter((r.doc_id, len((r.text or "").encode()), len(m.encode(r.text or ""))) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == source
    assert all(r.over_limit == (r.n_tokens > 1000) for r in rows)
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def test_merges_of_random_strings(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 100)
    path = tokenizers.path("piece_bpe_32k.model")
    m, e = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Merger(path)
    r = random.Random(2)
    parts = list("aetnoils  \n\t.,▁éß中") + ["the", "ing", " \n", "<s>", "\0", "😀", "ttt"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["".join(r.choice("abetn") for _ in range(3000)), "a" * 4000, " " * 500, "\n" * 300]
    got = [n for a in range(0, len(rows), 50) for n in e.count(rows[a : a + 50])]
    assert got == [len(m.encode(t)) for t in rows]


# --- the pipeline -----------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    benchmark = common.read_table(spark, sf_dir, "benchmark")
    good = common.stored(corpus_pipeline.quality(spark, docs, sf_dir))
    labels = {r.doc_id: r.quality for r in common.read_table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    marks = [(labels[i], i in kept) for i in labels]
    assert sum(a == b for a, b in marks) >= 0.9 * len(marks)
    one = common.stored(corpus_pipeline.near_duplicates(spark, good, sf_dir))
    want = groups({r.doc_id: r.text for r in good.collect()}, 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, root) in want.items() if i == root}
    clean = common.stored(corpus_pipeline.decontaminate(spark, one, sf_dir))
    hit = decontaminate.report(one, benchmark).filter("contaminated")
    assert clean.count() == one.count() - hit.count() and not clean.join(hit, "doc_id", "left_semi").count()
    mixed = common.stored(corpus_pipeline.mix(spark, clean, sf_dir))
    out = corpus_pipeline.tokens(spark, mixed, sf_dir)
    assert out.count() == mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_odd_tables(spark, sf_dir, odd):
    seen = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
        if name == "tokens":
            assert out.count() == odd.count()
            continue
        assert out.columns == odd.columns
        assert {c: {r[c] for r in out.select(c).distinct().collect()} for c in ("_score", "hit_items", "extra", "n_words")} == {c: {"mine"} for c in ("_score", "hit_items", "extra", "n_words")}
        if name != "mix":
            assert not seen(out) - seen(odd)
        if name == "near_duplicates":
            assert {i for i, _ in seen(out)} >= {None, 900, 17, 18}


def test_queries_agree_with_their_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        name = t.removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{sf_dir}/{t}'")
    for name, sql in oracle_sql().items():
        want = c.sql(sql)
        got = queries()[name](spark, sf_dir)
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        at = [want.columns.index(x) for x in columns]
        assert sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()) == sorted(str(tuple(r[x] for x in columns)) for r in got.collect()), name
