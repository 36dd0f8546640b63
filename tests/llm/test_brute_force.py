"""Results against plain Python versions, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tracesieve.llm import language, licenses, mixing, pieces, private, quality, simhash, toxicity, vectors
from tracesieve.llm import textarrays as A
from tracesieve.llm.common import components, table

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    return sorted(out)


TRICKY = (
    "x a@b.c%z@y.z a@b.c+d@e.f +1 234 567 89012 4111 1111 1111 1111 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4",
    "ñ é 4111-1111-1111-1111+4412345678901 99@a.b a@b a@b. a.b.c@d-e.f..g +1(23)45.67-89",
)


def test_private_base_spans(spark, odd):
    more = spark.createDataFrame([(2000 + i, t, None, None, None) for i, t in enumerate(TRICKY)], odd.schema)
    docs = odd.where("doc_id is null or doc_id <> 105").unionByName(more).unionByName(table(spark, SF, "documents").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in private.private_data(docs).where("doc_id is not null").collect():
        want = base_spans(texts[r.doc_id])
        counts = [sum(s[3] == k for s in want) for k, _ in PATTERNS]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_private_contexts_find_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220", "4000000000000002", "5105105105105100", "4539578763621486"]
    rows = [(i, f"payment by card no {c} done") for i, c in enumerate(cards) if luhn(c)] * 1
    rows += [(50, "payment by card no 4111111111111112 done"), (51, "weighs 4111111111111112 grams"), (52, "card no 123456")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.private_data(docs).collect()}
    assert got[50] == "id:19:35" and got[51] == "" and got[52] == ""
    masked = {r.doc_id: r.text for r in private.masked(docs).collect()}
    assert masked[50] == "payment by card no [ID] done" and masked[0] == "payment by card no [CARD] done" and masked[51].startswith("weighs 4")


def test_masking_covers_every_span(spark, odd):
    text = "a@b.cd, then +4412345678901 and 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, None, None, None)], odd.schema)
    got = private.masked(docs).collect()
    assert {r.text for r in got} == {"[EMAIL], then [PHONE] and [CARD]."} and len(got) == 3
    assert {r.n_chars for r in got} == {len("[EMAIL], then [PHONE] and [CARD].")}


def test_license_places(spark, odd):
    texts = ["MIT License, mit-license MIT\nLICENSE", "the GNU General Public License apache license", "mit licenſe Kit", "licensed under cc by nc 4.0", None, ""]
    texts += ["Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        found = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[3].labels == "cc-by-nc" and got[6].labels == "mit-notice" and 0.7 <= got[6].score < 1


def test_texts_without_a_license_are_only_counted(spark):
    """The words that decide whether a text is scanned are in every span that can be verified."""
    texts = []
    for _, passage in licenses.TEMPLATES:
        words = re.findall(r"[a-z0-9]+", passage)
        for gap in range(len(words)):  # each start, and a hole in the middle
            texts += [" ".join(words[gap:]), " ".join(words[: len(words) - gap]), " ".join([*words[:gap], "x", *words[gap + 1 :]]).upper()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "plain words", "a MIT one"])], "doc_id long, text string")
    words = docs.selectExpr("doc_id", "xxhash64(text) as h").join(docs.select("doc_id", licenses.word_array(docs.text).alias("words")), "doc_id")
    spans = {r.doc_id for r in licenses.verified_spans(words).collect()}
    kept = {r.doc_id for r in docs.where(licenses._may_hold(F.lower("text"), licenses.TEMPLATES)).collect()}
    assert len(spans) > len(licenses.TEMPLATES) and spans <= kept and not {len(texts), len(texts) + 1} & kept
    assert {r.doc_id for r in licenses.license_scan(docs).where("score > 0").collect()} >= spans


def test_long_documents_are_cut_at_their_word(spark):
    long = "  " + "wort " * 150_000
    docs = spark.createDataFrame([(1, long, "a", len(long)), (2, "x y z", "b", 5)], "doc_id long, text string, source string, n_chars long")
    got = {(r.doc_id, len(r.text.split())) for r in mixing.repeated_documents(docs).collect()}
    taken = {r.source: r.taken for r in mixing.mix_sources(docs).select("source", (F.col("mix.whole") * F.col("mix.size") + F.col("mix.extra")).alias("taken")).collect()}
    assert taken == {"a": 150_003 - 9, "b": 9} and got == {(1, 149_994), (2, 3)}


def brute_encode(text, key, dropout):
    """One agenda, a heap, for the whole text."""
    v, m = pieces.pieces(), pieces.marked(A.texts(pa.array([text])))
    n = len(m.codes)
    symbol, end, alive = [int(v.char[c]) if c <= 0x10FFFF else -1 for c in m.codes], list(range(1, n + 1)), [True] * n
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    merges = {int(p): (int(r), int(x)) for p, r, x in zip(v.pair, v.rank, v.result, strict=True)}
    agenda, keys = [], np.array([key], np.uint64)

    def push(i, j):
        if min(i, j) >= 0 and min(symbol[i], symbol[j]) >= 0 and (got := merges.get(symbol[i] * v.size + symbol[j])):
            heapq.heappush(agenda, (got[0], i, j, end[j], symbol[i], symbol[j], got[1]))

    for i in range(n - 1):
        push(i, i + 1)
    while agenda:
        _, i, j, stop, a, b, new = heapq.heappop(agenda)
        if not (alive[i] and alive[j] and after[i] == j and end[j] == stop and (symbol[i], symbol[j]) == (a, b)):
            continue
        if dropout and pieces.coins(keys, np.array([i]), np.array([j]), np.array([stop]))[0] < dropout:
            continue
        symbol[i], end[i], alive[j], after[i] = new, stop, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    return [symbol[i] for i in range(n) if alive[i]]


def encode(texts, dropout, seed=pieces.SEED):
    ids, bounds = pieces.encode(A.texts(pa.array(texts)), pieces.text_keys(np.arange(len(texts)), seed), dropout)
    assert pieces.decode(ids, bounds) == texts
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_pieces_against_agenda_and_library(spark):
    texts = [r.text[:1500] for r in table(spark, SF, "documents").limit(40).collect()] + ["", " ", "  a  b ", "\n\n a\tb ", "日本語テキスト 😀", "x" * 700]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert encode(texts, 0.0) == library.encode(texts)
    keys = pieces.text_keys(np.arange(len(texts)))
    got = encode(texts, 0.15)
    for text, key, ids in zip(texts, keys, got, strict=True):
        want = brute_encode(text, key, 0.15)
        if -1 not in want:
            assert ids == want
    assert got != encode(texts, 0.15, seed=21) and got == encode(texts, 0.15)
    encode(["▁ is kept", "a▁b \u0000 ퟿", *texts], 0.3)


def test_decoding_gives_the_texts_back(spark, odd):
    both = pieces.encode_documents(odd.where("doc_id is not null")).select("doc_id", "lossless", pieces.decoded("ids").alias("back"))
    joined = odd.join(both, "doc_id").where("doc_id <> 106")
    assert joined.where("not lossless or coalesce(text, '') <> back").count() == 0


def near_classes(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= simhash.BITS:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("block", [3, simhash.BLOCK])
def test_fingerprints_link_like_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    heart = rng.integers(0, 2**63, 12)
    values = [int(h) for h in heart]
    for _ in range(400):  # walks around a few hearts: chains and large groups
        value = values[rng.integers(len(values))] if rng.random() < 0.5 else int(heart[0])
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            value ^= 1 << int(bit)
        values.append(value)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    classes = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, rep long")
    got = dict(components(simhash.links(classes, block)).collect())
    assert [got.get(i, i) for i in range(len(values))] == near_classes(values)


def test_near_duplicates_against_brute_force(spark, odd):
    got = simhash.near_duplicates(odd.where("doc_id is not null")).dropDuplicates().collect()
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    ids = sorted(texts)
    prints = []
    for i in ids:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[i] or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    want = {i: (p, ids[c]) for i, p, c in zip(ids, prints, near_classes(prints), strict=True)}
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == want
    kept = simhash.one_of_each(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert sum(r.doc_id is None for r in kept) == 2


def test_components_of_paths_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(300 - i, 300) for i in range(1, 40)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {i: 261 for i in range(261, 301)}
    assert got == want


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    hearts = rng.standard_normal((60, 24))
    x = np.concatenate([hearts[rng.integers(0, 60, 700)] + 0.12 * rng.standard_normal((700, 24)), hearts[:1] + 0.02 * rng.standard_normal((150, 24))])
    x = x.astype(np.float32)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, recall = vectors.near_vectors(data)
    got = got.toPandas().set_index("vec_id").sort_index()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= vectors.THRESHOLD).sum(1) - 1
    assert (got.n_links.to_numpy() <= true).all() and got.n_links.sum() >= 0.9 * true.sum() and recall >= 0.9
    assert got.loc[700:, "component_id"].nunique() == 1
    assert vectors.linked_counts.__defaults__[1] == vectors.BLOCK


def test_tight_groups_that_touch(spark):
    """Groups that fill every list with their own members, in pairs at 0.957 to each other."""
    rng = np.random.default_rng(9)
    pairs = np.linalg.qr(rng.standard_normal((64, 12)))[0].T  # a centre and a direction for each pair
    angle = np.arccos(0.957)
    centres = np.concatenate([[c, np.cos(angle) * c + np.sin(angle) * t] for c, t in zip(pairs[:6], pairs[6:])])
    x = np.repeat(centres, 40, axis=0) + 1e-3 * rng.standard_normal((480, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, recall = vectors.near_vectors(data)
    got = got.toPandas().set_index("vec_id").sort_index()
    true = (x @ x.T >= vectors.THRESHOLD).sum(1) - 1
    assert true.sum() == 37_920 and got.n_links.tolist() == true.tolist() and recall == 1.0
    assert got.component_id.tolist() == [i // 80 * 80 for i in range(480)]


def test_orders_without_other_components_give_no_pairs():
    import pandas as pd

    sketch = np.zeros((5, vectors.WORDS + 1), np.int64)
    frame = pd.DataFrame({"turn": 0, "key": 0, "node": range(5), "s": list(sketch)})
    assert list(vectors._others_in_order(iter([frame, frame]))) == []
    sketch[3:, vectors.WORDS] = 7
    frame["s"] = list(sketch)
    split = [frame.iloc[:2], frame.iloc[2:4], frame.iloc[4:]]
    for frames in ([frame], split):
        found = {(u, w) for p in vectors._others_in_order(iter(frames)) for u, w in zip(p["u"], p["w"])}
        assert found == {(a, b) for x in (0, 1, 2) for y in (3, 4) for a, b in ((x, y), (y, x))}
    assert list(vectors._neighbours_in_order(iter([frame.iloc[:1]]))) == []


def test_vector_counts_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + 0.2 * rng.standard_normal((90, 8))
    nodes = spark.createDataFrame([(i, 1 + i % 3, v.tolist()) for i, v in enumerate(x)], "node long, n long, v array<double>")
    joined = nodes.select("node", F.lit(0).cast("long").alias("component"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(90, dtype=bool)
    want = dict(enumerate((links @ (1 + np.arange(90) % 3)).tolist()))
    for block in (7, 1000):
        assert dict(vectors.linked_counts(joined, nodes, 0.95, block).collect()) == want


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.3), *(lambda t: (t, rng.integers(1, 5, len(t))))(np.unique(rng.integers(0, 40, rng.integers(1, 9))))) for i in range(700)]
    index = toxicity.build_index(rows, rng.random(40) + 1)
    place_of = {int(i): k for k, i in enumerate(index.ids)}
    x = index.vectors([(r[2], r[3]) for r in rows[:120]])
    every = index.vectors([(rows[i][2], rows[i][3]) for i in index.ids])
    cosine, place = index.nearest(x, 10)
    full = x @ every.T
    assert np.allclose(cosine, -np.sort(-full, axis=1)[:, :10])
    assert (place[np.arange(120), 0] >= 0).all() and place_of[0] in place[0]


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97 and found.score.between(0, 1).all()
    scored = docs.select("doc_id", quality.score(F.col("text"), quality.fit(docs, labels)).alias("score")).join(labels, "doc_id").toPandas()
    assert ((scored.score >= quality.CUT) == scored.quality).mean() > 0.95
    toxic = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (toxic.predicted == toxic.toxic).mean() > 0.9 and toxic.score.between(0, 1).all()


def test_trees_learn_and_fall_back():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    score = quality.fit_trees(x, y).score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    assert quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_document_frequency_counts_rows_over_all_tasks(spark):
    rows = [[0, 2], [2], [], None, [1, 2]] * 7
    ids = spark.createDataFrame([(r,) for r in rows], "ids array<int>").repartition(3)
    assert toxicity.document_frequency(ids, 4).tolist() == [7, 7, 21, 0]
    assert toxicity.document_frequency(ids.limit(0), 0).tolist() == []


def test_toxicity_searches_every_word(spark):
    rng = np.random.default_rng(6)
    word = lambda k: "w" + "".join(chr(97 + int(c)) for c in str(k))
    texts = [f"common {' '.join(word(k) for k in rng.integers(0, 400, 6))}" for _ in range(300)] + ["", "unheard", "solitary common"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for labelled in (15, 300):
        y = rng.random(labelled) < 0.4
        labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
        sample, vocabulary = toxicity.fit_vocabulary(docs, labels)
        examples = sorted(r.doc_id for r in sample.collect())
        words = sorted({w for i in examples for w in texts[i].split()})
        assert len(vocabulary) == len(words) and (labelled > 20 or len(examples) < 20)
        count = np.array([[t.split().count(w) for w in words] for t in texts], float)
        idf = np.log((1 + len(texts)) / (1 + (count > 0).sum(0))) + 1
        rows = [(i, int(y[i]), np.flatnonzero(count[i]), count[i][count[i] > 0]) for i in examples]
        x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf * toxicity.association(rows, len(words))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        cosine = x @ x[examples].T
        for i in range(len(texts)):
            want = np.sort(cosine[i])[::-1][:3]
            assert np.allclose([cosine[i][examples.index(e)] for e in got[i].evidence], want[want > 0])
        assert len(got[302].evidence) == 3 and got[301].evidence == [] and got[300].evidence == []


def test_search_with_rare_and_frequent_terms_is_exact():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        ids = np.unique(np.concatenate([rng.integers(0, 30, 10), rng.integers(30, 3000, 20)]))
        rows.append((i, int(rng.random() < 0.3), ids, rng.integers(1, 5, len(ids))))
    index = toxicity.build_index(rows, rng.random(3000) + 1)
    assert 0 < (index.column >= 0).sum() < 100 and len(index.places) > 5000
    every = index.vectors([(rows[i][2], rows[i][3]) for i in index.ids])
    cosine, place = index.nearest(index.vectors([(r[2], r[3]) for r in rows[:150]]), 10)
    full = index.vectors([(r[2], r[3]) for r in rows[:150]]) @ every.T
    want = np.lexsort((np.broadcast_to(np.arange(500), full.shape), -full.round(12)), axis=1)[:, :10]
    assert (place == want).all() and np.allclose(cosine, np.take_along_axis(full, want, 1))


def test_audit_weighs_nodes_alike_and_draws_until_some_link(spark):
    rng = np.random.default_rng(9)
    heart, alone, pairs = rng.standard_normal((1, 32)), rng.standard_normal((700, 32)), rng.standard_normal((60, 32))
    group, twins = heart + 0.01 * rng.standard_normal((200, 32)), pairs + 0.01 * rng.standard_normal((60, 32))
    def nodes(*parts):
        rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate(parts))]
        return spark.createDataFrame(rows, "node long, n long, v array<double>").cache()
    counts = spark.createDataFrame([(i, 199) for i in range(200)], "node long, links long")
    assert abs(vectors.audit(nodes(group, pairs, twins), counts, queries=10**6) - 200 / 320) < 1e-9
    rare = nodes(alone, pairs[:2], twins[:2])
    assert vectors.audit(rare, counts.limit(0), queries=8) == 0.0
    assert vectors.audit(nodes(alone), counts.limit(0), queries=8, most=32) is None and vectors.audit(nodes(alone), counts.limit(0)) == 1.0
