"""Phrase collocations from weighted acyclic automata.

Every shard of the corpus turns its sorted n-grams of one length into a count transducer
(``automata``). Transducers are cut at common keys into prefix ranges, and each range is
one small group: the union of its transducers with summed weights. Counts are exact; a
phrase can only be frequent if its parts are, so longer n-grams are collected where a
fixed-size bitmap of frequent shorter ones allows them (false positives cost time only).
The parts of the candidates form acceptors, which are composed with the count transducers
of the same prefix range.

Odd rows: a null text is empty, a null language is ``und``; a document counts as often as
its row is repeated; ids do not matter. Words and phrases may be of any length, texts are
read whole. Ties of score go to the more frequent phrase, then to byte order. No rows, or
no phrase with enough occurrences, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm import automata
from tracesieve.llm.common import small_batches
from tracesieve.llm.textarrays import mix
from tracesieve.operators.ordering import number_rows
from tracesieve.session import cut

LEAST, TOP, LONGEST = 10, 2000, 3
#: Words of a shard that are counted together; n-grams in a prefix range; one n-gram in so many marks the cuts.
SHARD_WORDS, RANGE_NGRAMS, MARK_EVERY = 2_000_000, 500_000, 25_000
#: Bits of the bitmap of frequent n-grams: 8 MB at every size of the corpus.
BITS = 1 << 26
BREAK = "\n"
_TEXT = pa.large_string()

SHARD = "lang string, ngrams long, total long, marks array<string>, automaton binary"
SLICE = "part long, lang string, automaton binary"
COUNTED = "part long, lang string, phrases array<string>, f array<long>, slots array<long>, automaton binary"


def corpus_words(text: pa.Array) -> pa.Array:
    """Words of all texts in order; ``BREAK`` stands between pieces and texts."""
    x = pc.ascii_lower(pc.fill_null(text.cast(_TEXT), ""))
    x = pc.replace_substring_regex(x, "[.,;:!?\n\x0b\x0c\r]+", f" {BREAK} ")
    x = pc.replace_substring(pc.binary_join_element_wise(x, pa.scalar(BREAK, _TEXT), pa.scalar(" ", _TEXT)), "\t", " ")
    words = pc.list_flatten(pc.split_pattern(x, " "))
    return words.filter(pc.not_equal(words, ""))


def slot(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))


def joined_slots(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One hash for each n-gram, from those of its words."""
    out = hashes[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out = mix(out + np.uint64(k)) ^ hashes[ids[:, k]]
    return out % np.uint64(BITS)


def _allowed(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def shard_automaton(lang: str, flat: pa.Array, n: int, bitmap: np.ndarray | None):
    """Alphabet, sorted n-grams and counts of a run of words; for n > 1 only those whose parts of n - 1 words are allowed."""
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    codes = rank[coded.indices.to_numpy()]
    mark = automata.number(words, pa.array([BREAK], _TEXT))[0]
    good = codes != mark
    starts = np.flatnonzero(good[: len(good) - n + 1]) if len(good) >= n else np.zeros(0, np.int64)
    for k in range(1, n):
        starts = starts[good[starts + k]]
    if n > 1 and len(starts):
        hashes = slot(lang, words)
        runs = np.stack([codes[k : len(codes) - (n - 2) + k] for k in range(n - 1)], 1)
        fine = _allowed(bitmap, joined_slots(hashes, runs))
        starts = starts[fine[starts] & fine[starts + 1]]
    if not len(starts):
        return None
    ids = np.stack([codes[starts + k] for k in range(n)], 1)
    return words, *automata.summed(ids, np.ones(len(starts), np.int64), len(words))


def _shards(n: int, bitmap: np.ndarray | None):
    def flush(held: dict[str, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            flat = pa.concat_arrays(held[lang])
            for at in range(0, len(flat), SHARD_WORDS):
                # Runs overlap by n - 1 words: every n-gram starts in exactly one.
                made = shard_automaton(lang, flat.slice(at, SHARD_WORDS + n - 1), n, bitmap)
                if made:
                    words, ids, weight = made
                    data = automata.build(words, ids, weight).to_bytes()
                    drawn = ids[xxhash.xxh64_intdigest(data) % MARK_EVERY :: MARK_EVERY]
                    marks = automata.joined(words, drawn).to_pylist()
                    yield _batch(SHARD, [lang], [len(ids)], [int(weight.sum())], [marks], [data])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        total = 0
        for batch in batches:
            langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und")
            for lang in pc.unique(langs).to_pylist():
                flat = corpus_words(batch.column("text").filter(pc.equal(langs, lang)))
                held.setdefault(lang, []).append(flat)
                total += len(flat)
            if total >= SHARD_WORDS:
                yield from flush(held)
                total = 0
        yield from flush(held)

    return count


_ARROW = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return pa.record_batch([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def range_keys(shards: DataFrame) -> list[tuple[str, list[str]]]:
    """Sorted (lang, words) at which ranges are cut, so that each holds about ``RANGE_NGRAMS`` n-grams.

    The marks come to the driver: some hundred bytes for each ``RANGE_NGRAMS`` n-grams.
    They only balance the work.
    """
    total = shards.agg(F.sum("ngrams")).first()[0] or 0
    marks = shards.select("lang", F.explode("marks").alias("mark")).collect()
    keys = sorted((r.lang.encode(), [w.encode() for w in r.mark.split(" ")]) for r in marks)
    ranges = max(1, total // RANGE_NGRAMS)
    chosen = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    distinct = [k for i, k in enumerate(chosen) if i == 0 or k != chosen[i - 1]]
    return [(lang.decode(), [w.decode() for w in words]) for lang, words in distinct]


def cut_at(lang: str, words: pa.Array, ids: np.ndarray, weight: np.ndarray, keys: list) -> Iterator[tuple[int, bytes]]:
    """(range, automaton) of the prefix ranges that sorted n-grams of one language fall into."""
    mine = [i for i, key in enumerate(keys) if key[0] == lang]
    low = mine[0] if mine else sum(key[0].encode() < lang.encode() for key in keys)
    bounds = [0, *automata.range_bounds(words, ids, [keys[i][1] for i in mine]), len(ids)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            yield low + k, automata.build(words, ids[a:b], weight[a:b]).to_bytes()


def _sliced(keys: list):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                auto = automata.from_bytes(data.as_py())
                for part, piece in cut_at(lang, auto.words, *auto.paths(), keys):
                    yield _batch(SLICE, [part], [lang], [piece])

    return slices


def _by_lang(group: pa.Table) -> Iterator[tuple[str, list[automata.Automaton]]]:
    for lang in pc.unique(group.column("lang")).to_pylist():
        rows = group.filter(pc.equal(group.column("lang"), lang))
        yield lang, [automata.from_bytes(x.as_py()) for x in rows.column("automaton")]


def _united(least: int):
    def unite(group: pa.Table) -> pa.Table:
        """Union of the automata of a range; n-grams with at least ``least`` occurrences stay."""
        part, out = group.column("part")[0].as_py(), []
        for lang, parts in _by_lang(group):
            words, ids, weight = automata.union(parts)
            kept = weight >= least
            if kept.any():
                auto = automata.build(words, ids[kept], weight[kept])
                own, f = auto.paths()
                slots = joined_slots(slot(lang, auto.words), own).astype(np.int64)
                out.append(_batch(COUNTED, [part], [lang], [automata.joined(auto.words, own).to_pylist()], [f], [slots], [auto.to_bytes()]))
        return pa.Table.from_batches(out or [_batch(COUNTED, *[[]] * 6)])

    return unite


def count_phrases(docs: DataFrame, n: int, bitmap: np.ndarray | None, least: int) -> tuple[DataFrame, DataFrame, list]:
    """Count transducers of the frequent n-grams by prefix range, words per language, and the cut keys."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = cut(docs.select("text", "lang").mapInArrow(_shards(n, bitmap), SHARD))
    keys = range_keys(shards)
    slices = shards.select("lang", "automaton").mapInArrow(_sliced(keys), SLICE)
    counted = cut(slices.groupBy("part").applyInArrow(_united(least), COUNTED))
    return counted, shards.groupBy("lang").agg(F.sum("total").alias("n")), keys


def frequent_bitmap(counted: DataFrame) -> np.ndarray:
    """Bit of every frequent n-gram; at most ``BITS`` / 8 bytes."""
    slots = counted.select(F.explode("slots").alias("s")).select((F.col("s") + 1).alias("s"))
    rows = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r.bits, np.uint8)
        bitmap[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(part)] = part
    return bitmap


def _wanted(first: int, last: int, keys: list):
    """Acceptors of the words ``first`` to ``last`` of the n-grams of each automaton, by prefix range."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                auto = automata.from_bytes(data.as_py())
                ids, weight = auto.paths()
                ids, weight = automata.summed(ids[:, first:last], weight, len(auto.words))
                for part, piece in cut_at(lang, auto.words, ids, weight, keys):
                    yield _batch(SLICE, [part], [lang], [piece])

    return parts


def _composed(counts: pa.Table, wanted: pa.Table) -> pa.Table:
    """Occurrences of the wanted n-grams of a range."""
    schema = "lang string, part string, f long"
    have = {lang: autos[0] for lang, autos in _by_lang(counts)} if counts.num_rows else {}
    out = []
    for lang, acceptors in _by_lang(wanted) if wanted.num_rows else ():
        if lang in have:
            acceptor = automata.build(*automata.union(acceptors))
            ids, f = automata.compose(acceptor, have[lang])
            names = automata.joined(acceptor.words, ids).cast(pa.string())
            out.append(pa.record_batch([pa.array([lang] * len(ids), pa.string()), names, pa.array(f)], ["lang", "part", "f"]))
    return pa.Table.from_batches(out or [_batch(schema, [], [], [])])


def part_counts(levels: dict[int, tuple[DataFrame, list]]) -> DataFrame:
    """(lang, part, f) of all parts of the frequent phrases of two and more words."""
    found = []
    for size in range(1, LONGEST):
        counted, keys = levels[size]
        wanted = [
            levels[n][0].select("lang", "automaton").mapInArrow(_wanted(at, at + size, keys), SLICE)
            for n in range(size + 1, LONGEST + 1) for at in ({0, n - size})
        ]
        asked = wanted[0]
        for more in wanted[1:]:
            asked = asked.unionByName(more)
        have = counted.select("part", "lang", "automaton")
        found.append(have.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_composed, "lang string, part string, f long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    a: occurrences of the phrase, l and r: of the parts of its weakest cut, n: all words.
    A phrase inside a longer one with at least half its occurrences is left out.
    """
    levels, bitmap = {}, None
    for n in range(1, LONGEST + 1):
        counted, words, keys = count_phrases(docs, n, bitmap, least)
        levels[n] = counted, keys
        if n == 1:
            totals = words
        if n < LONGEST:
            bitmap = frequent_bitmap(counted)
    sizes = [
        levels[n][0].select("lang", F.explode(F.arrays_zip("phrases", "f")).alias("x")).select("lang", F.lit(n).alias("size"), F.col("x.phrases").alias("phrase"), F.col("x.f").alias("a"))
        for n in range(2, LONGEST + 1)
    ]
    phrases = sizes[0]
    for more in sizes[1:]:
        phrases = phrases.unionByName(more)
    words = F.split("phrase", " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("l"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("r"),
    ))
    needs = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut"))
    sides = needs.select("lang", "phrase", "a", "cut.k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("cut.l").alias("part")), F.struct(F.lit("r").alias("side"), F.col("cut.r").alias("part")),
    )).alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part")
    known = sides.join(part_counts(levels), ["lang", "part"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = known.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"),
    )
    scored = pairs.withColumn("square", big("a") * big("a")).withColumn("lr", big("l") * big("r"))
    scored = scored.withColumn("score", F.expr("(square * 1000000BD) div lr"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    held = phrases.where("size > 2").select("lang", "a", F.explode(_inner(words, F.col("size"))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").where("longer is null or 100 * cast(longer as decimal(19,0)) < 50 * cast(a as decimal(19,0))")
    ordered = kept.select("lang", (-F.col("cut.score")).alias("below"), (-F.col("a")).alias("rarer"), "phrase", "cut.l", "cut.r")
    best = number_rows(ordered, ["below", "rarer", "phrase"], "rank", ["lang"]).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", (-F.col("rarer")).alias("a"), "l", "r", "n", (-F.col("below")).alias("score"))


def _inner(words, size):
    """Distinct shorter phrases of two and more words that lie in a phrase."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda at: F.array_join(F.slice(words, at, m), " "),
    )))
    return F.array_distinct(spans)
