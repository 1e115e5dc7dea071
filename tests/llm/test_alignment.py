"""Token alignment against plain loops over both libraries' tokens."""

import collections
import hashlib

import numpy as np
import pytest

from tallystone.llm import alignment

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Result columns of each text by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    plain_bytes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain_bytes}
    shown |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain_bytes)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    rows, counts = [], collections.Counter()
    for text in texts:
        a = [(i, bytes(shown[c] for c in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in two.encode(text or "")]
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, of = 0, {}
            for i, x in side:
                at += len(x)
                of[at] = i
            ends.append(of)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in of.items() if before < e <= cut) for of in ends))
            before = cut
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        counts.update(links)
        rows.append((a, b, groups, links))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, groups, links in rows
    ]


def test_alignment_is_that_of_plain_loops(odd_docs):
    have = odd_docs.select("doc_id", "text").collect()
    short = [r for r in have if len(r.text or "") < 60000]
    df = odd_docs.filter("coalesce(length(text), 0) < 60000")
    want = collections.Counter(zip([r.doc_id for r in short], plain([r.text for r in short])))
    got = collections.Counter((r[0], tuple(r[1:])) for r in alignment.alignment(df, A, B).collect())
    assert got == want


def test_empty_table_and_very_long_text(odd_docs):
    assert alignment.alignment(odd_docs.limit(0), A, B).collect() == []
    rows = alignment.alignment(odd_docs, A, B).collect()
    assert len(rows) == odd_docs.count()
    assert max(r.n_a for r in rows) > 20000 and all(r.n_links == r.n_groups for r in rows)


def test_ids_are_those_of_the_library_whatever_the_path():
    one = alignment.ByteLevel(A)
    assert one.fast is not None
    texts = [" plain", "  a\n\n b ", "x" * 2000, "\n" * 900 + "b", "<|endoftext|>", "日本 語", "it's 12abc"]
    ids = lambda tokenizer, texts: [np.frombuffer(x, np.int32).tolist() for x in tokenizer.encode(texts)]
    assert ids(one, texts) == [one.exact(t) for t in texts]
    one.fast = None
    assert ids(one, texts) == [one.exact(t) for t in texts]
    assert b"".join(one.bytes[i] for i in ids(one, ["naïve 中"])[0]) == "naïve 中".encode()
    two = alignment.Pieces(B)
    assert two.cut
    texts = ["plain words", "a\nb\n\nc", "\n", "two  spaces", " lead", "naïve 中\n<0x0A> <s>", "! ! !!\n! b", "x" * 300]
    assert ids(two, texts) == two.model.encode(texts) == ids(two, texts)
    assert two.encode(["a▁b", "▁"]) == [None, None]


def test_nothing_but_encoding_is_python(odd_docs):
    tokens = alignment.token_ends(odd_docs, A, B)
    plan = alignment.aligned(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array_intersect" in plan and "BatchEvalPython" not in plan
