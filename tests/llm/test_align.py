"""Alignment against a plain version on whole texts; matrix products against numpy."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tracesieve.llm import align, csr
from tracesieve.llm.common import table

A = Tokenizer.from_file(align.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)


def byte_level():
    chars = align.byte_characters()
    return {i: bytes(chars.get(c, 0) for c in t) if t != "<|endoftext|>" else t.encode() for t, i in A.get_vocab().items()}


A_BYTES = byte_level()


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def tokens(text):
    """(start, end, id) of both sides, or nothing if a side does not give the bytes back."""
    whole, sides = b" " + (text or "").encode(), []
    for ids, of in ((A.encode(" " + (text or ""), add_special_tokens=False).ids, A_BYTES.get), (B.encode(text or ""), b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        if not text or b"".join(of(i) for i in ids) != whole:
            return [], []
        sides.append(out)
    return sides


def plain(texts):
    rows, corpus = [], Counter()
    for text in texts:
        a, b = tokens(text)
        cuts = sorted({t[1] for t in a} & {t[1] for t in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([t[2] for t in a if low <= t[0] < cut], [t[2] for t in b if low <= t[0] < cut]) if len(a) < 3000 else None)
            low = cut
        if len(a) >= 3000:  # the same, linear
            bounds = [0, *cuts]
            of = lambda side: [[i for _, _, i in side[x:y]] for x, y in zip(*(lambda p: (p, p[1:]))(np.searchsorted([t[0] for t in side], bounds).tolist()))]
            groups = list(zip(of(a), of(b), strict=True))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        corpus.update(links.keys())
        digest = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    return [
        (na, nb, ng, sum(links.values()), sum(t for p, t in links.items() if corpus[p] == best[p[0]]), sum(t * corpus[p] for p, t in links.items()), sha)
        for na, nb, ng, links, sha in rows
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "it's we'll I 'm", "x ' s", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a ▁ b", "a▁b",
    "\x00", "a\x00b c", "\t\tif x:\n\t\treturn  1", "😀😀 👩‍👩‍👧 é é", "日本語 の 文章", "\u00a0x \u2003 y", "\u200bx \ufeffy", "\x1c \x1f x", "\x85 x \x85", "a" * 3000, "ab" * 2000 + " " + "1" * 500,
    "�", "ﷺ ﬁ", "x\r\ny\rz", "word " * 300, "?!,.;: --- ... 12,345.67",
]


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain([r.text for r in rows]), strict=True))
    got = align.aligned_documents(docs)
    assert got.columns == ["doc_id", *COLUMNS]
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("chunk, entries", [(5_000_000, 1_000_000), (3000, 50)])
def test_odd_texts(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(align, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(align, "PRODUCT_ENTRIES", entries)
    rng = random.Random(chunk)
    mixed = ["".join(rng.choices(" \n\tab'sé▁1.日😀", k=rng.randint(1, 80))) for _ in range(150)]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(ODD + mixed + mixed[:20])]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit(1)).withColumn("links", F.lit(1)).repartition(3))


def test_documents(spark):
    check(spark, table(spark, SF, "documents"))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned_documents(none).collect() == [] and align.overlap_links(none).collect() == []


def test_overlaps(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    for r in align.overlap_links(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b = tokens(rows[r.doc_id][1])
        assert [(t.start, t.end, t.id) for t in r.a] == a and [(t.start, t.end, t.id) for t in r.b] == b
        want = []
        low = 0
        for i, (s, e, _) in enumerate(a):
            while b[low][1] <= s:
                low += 1
            j = low
            while j < len(b) and b[j][0] < e:
                want.append((i, j, min(e, b[j][1]) - max(s, b[j][0])))
                j += 1
        assert [tuple(o) for o in r.overlaps] == want
        cuts = sorted({t[1] for t in a} & {t[1] for t in b})
        for side in (r.a, r.b):
            assert [t.grp for t in side] == [sum(c <= t.start for c in cuts) for t in side]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_products(n, k, m, rng):
    make = lambda r, c: np.array([[rng.choice([0, 0, 1, 3]) for _ in range(c)] for _ in range(r)], np.int64).reshape(r, c)
    x, y = make(n, k), make(k, m)
    of = lambda d: csr.from_entries(*np.nonzero(d), d[np.nonzero(d)], *d.shape)

    def dense(s):
        out = np.zeros((s.rows, s.width), np.int64)
        out[s.row_of(), s.column] = s.value
        return out

    assert (dense(csr.product(of(x), of(y))) == x @ y).all()
    parts = [dense(p) for _, p in csr.products(of(x), of(y), rng.choice([1, 5, 100]))]
    assert (np.concatenate([np.zeros((0, m), np.int64), *parts]) == x @ y).all()
    assert (of(x).row_sums() == x.sum(1)).all()
