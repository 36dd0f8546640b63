"""Automata against dictionaries; collocations against plain counting, on odd rows and over cut ranges."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracesieve.llm import automata, phrases

TEXT = pa.large_string()


def from_counts(counts):
    keys = sorted(counts, key=lambda g: [w.encode() for w in g])
    words = pa.array(sorted({w for g in keys for w in g}, key=str.encode), TEXT)
    ids = np.stack([automata.number(words, pa.array([g[k] for g in keys], TEXT)) for k in range(len(keys[0]))], 1)
    return automata.build(words, ids, np.array([counts[g] for g in keys], np.int64))


def to_counts(words, ids, weight):
    names = words.to_pylist()
    return {tuple(names[i] for i in row): int(w) for row, w in zip(ids, weight, strict=True)}


GRAMS = st.integers(1, 3).flatmap(lambda n: st.lists(
    st.dictionaries(st.tuples(*[st.sampled_from(["a", "b", "á", "\x01", "zz", "😀", "ab"])] * n), st.integers(1, 5), min_size=1, max_size=30), min_size=2, max_size=3,
))


@settings(max_examples=200, deadline=None)
@given(GRAMS)
def test_automata_hold_unite_compose_and_cut(tables):
    autos = [automata.from_bytes(from_counts(t).to_bytes()) for t in tables]
    for auto, table in zip(autos, tables, strict=True):
        assert to_counts(auto.words, *auto.paths()) == table
    words, ids, weight = automata.union(autos)
    total = sum(map(Counter, tables), Counter())
    assert to_counts(words, ids, weight) == total
    one = automata.build(words, ids, weight)
    for auto, table in zip(autos, tables, strict=True):
        got, f = automata.compose(auto, one)
        assert to_counts(auto.words, got, f) == {g: total[g] for g in table}
        got, f = automata.compose(one, auto)
        assert to_counts(words, got, f) == table
    keys = sorted({tuple(w.encode() for w in g) for g in tables[0]})[:4]
    bounds = automata.range_bounds(words, ids, [[w.decode() for w in k] for k in keys])
    ordered = sorted(tuple(w.encode() for w in g) for g in total)
    assert list(bounds) == [sum(g < k for g in ordered) for k in keys]


def test_equal_states_are_shared():
    auto = from_counts({(f"x{i}", "y", z): 1 for i in range(50) for z in "pq"})
    assert [len(s) for s in auto.symbol] == [50, 1, 2]
    other = from_counts({("a", "y", "p"): 1, ("b", "y", "p"): 2})
    assert [len(s) for s in other.symbol] == [2, 2, 2]


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out, longer = defaultdict(list), defaultdict(int)
    for (lang, g), a in f.items():
        if len(g) == 3 and a >= least:
            for inner in (g[:2], g[1:]):
                longer[lang, inner] = max(longer[lang, inner], a)
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and not (longer[lang, g] and 100 * longer[lang, g] >= 50 * a):
            score, _, left, right = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_NGRAMS", 40)
    monkeypatch.setattr(phrases, "MARK_EVERY", 5)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 64)


def test_odd_rows_over_many_ranges(spark, small_ranges):
    rng = random.Random(3)
    words = ["the", "The", "of", "x", "\x01", "ñ", "Á", "a b", "e\tf", "end.", "end,of", "new\nline", "\x0b", "...", "日本", " ", "long" * 500]
    rows = [(" ".join(rng.choices(words, [9, 5, 7] + [1] * 14, k=rng.randint(0, 60))), rng.choice(["en", "fr", None, "und", "", "e n"])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("   ", "en"), ("one", "en"), (rows[0][0], "en")] + [("very common pair here " * 40, "en")] * 30 + [("w " * 3000, "fr")]
    docs = spark.createDataFrame([(i % 7, t, lang, 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, f long, part long").repartition(5)
    for least, top in ((10, 2000), (2, 7)):
        got = [tuple(r) for r in phrases.collocations(docs, least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least, top)
    shards = docs.select("text", "lang").mapInArrow(phrases._shards(2, np.full(phrases.BITS // 8, 255, np.uint8)), phrases.SHARD)
    assert len(phrases.range_keys(shards)) > 10


def test_nothing_frequent_and_no_rows(spark):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 4_000_000  # 10^6 * n^2 passes 2^63
    docs = spark.range(1).selectExpr(f"repeat('new york ', {n}) as text", "'en' as lang")
    got = [(r.phrase, r.rank, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs).collect()]
    # Both cuts of a triple weigh the same after flooring: the first one counts. The pairs lie in the triples.
    assert sorted(got) == [("new york new", 1, n - 1, n, n - 1, 2 * n, 999999), ("york new york", 2, n - 1, n, n, 2 * n, 999999)]
