"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm.common import components, discard, small_batches
from tracesieve.session import cut

WIDTH = 4
SEED = 42
BITS = 4
#: Ring of segments: six segments of 10 or 11 bits, at most four differing bits.
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows of one bucket that are compared in one piece; larger buckets go in pairs of blocks.
BLOCK = 2048
#: Groups up to this size are compared with vectorised shifts, larger ones by search.
SMALL = 16


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half the shingle hashes; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(last)), np.uint64, last)
    votes = np.zeros(64, np.int64)
    for start in range(0, last, 65536):
        piece = hashes[start : start + 65536]
        votes += _votes(piece)
    return int(np.bitwise_or.reduce(np.where(2 * votes > last, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


@F.arrow_udf(T.LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        values = np.fromiter((fingerprint_of(x.as_py()) for x in column), np.uint64, len(column))
        yield pa.array(values.view(np.int64))


def _mask(segments) -> np.uint64:
    return np.uint64(sum(((1 << n) - 1) << at for at, n in segments))


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """Masks of the chains of 2, 3, ... segments from ``start`` on the ring, with their budgets."""
    ring = [SEGMENTS[(start + k) % len(SEGMENTS)] for k in range(len(SEGMENTS))]
    return [(_mask(ring[:n]), n * BITS // len(SEGMENTS)) for n in range(2, len(SEGMENTS) + 1)]


KEYS = tuple(combinations(range(len(SEGMENTS)), 2))
CHAINS = tuple(tuple(chain_masks(s)) for s in range(len(SEGMENTS)))


def near(x: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """Which differences ``x`` of bucket ``key`` link.

    Two segments are equal in a bucket. By the pigeonring principle a linking pair has a
    segment from which every chain stays within its proportional budget; that segment is
    equal, so it is one of the two in some bucket. Chains prune before the full check.
    """
    keys = np.broadcast_to(np.asarray(key), x.shape)
    good = np.zeros(x.shape, bool)
    for place, segments in enumerate(KEYS):
        at = np.flatnonzero(keys == place) if np.ndim(key) else (np.arange(len(x)) if place == key else ())
        if not len(at):
            continue
        for start in segments:
            left = at
            for mask, budget in CHAINS[start]:
                left = left[np.bitwise_count(x[left] & mask) <= budget]
            good[left] = True
    return good


def _search(fps: np.ndarray, key: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one group."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            found = near(fps[left] ^ fps[at], key)
            edges += [(at, b) for b in left[found]]
            todo += list(left[found])
            left = left[~found]
    return edges


def _bucket_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning links of the groups (key, value, part), which arrive sorted."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        group = frame[["key", "value", "part"]].to_numpy()
        change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        last = change[-1] if len(change) else 0
        rest = frame.iloc[last:].reset_index(drop=True)
        if last:
            yield _links(frame.iloc[:last], np.concatenate([[0], change]))
    if rest is not None and len(rest) > 1:
        yield _links(rest, np.array([0, len(rest)]))


def _links(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    fps, rep, key = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy(), frame["key"].to_numpy()
    sizes = np.diff(bounds)
    a, b = [], []
    group = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1), sizes)
    for shift in range(1, SMALL):
        pair = np.flatnonzero((group[:-shift] == group[shift:]) & (group[:-shift] >= 0)) if shift < len(group) else ()
        if not len(pair):
            break
        pair = pair[near(fps[pair] ^ fps[pair + shift], key[pair])]
        a.append(rep[pair])
        b.append(rep[pair + shift])
    for g in np.flatnonzero(sizes > SMALL):
        lo, hi = bounds[g], bounds[g + 1]
        found = np.array(_search(fps[lo:hi], int(key[lo])), np.int64).reshape(-1, 2)
        a.append(rep[lo:hi][found[:, 0]])
        b.append(rep[lo:hi][found[:, 1]])
    return pd.DataFrame({"a": np.concatenate([*a, []]).astype(np.int64), "b": np.concatenate([*b, []]).astype(np.int64)})


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all near fingerprints of ``classes`` (fp, rep).

    Each fingerprint goes into a bucket for each pair of segments. A bucket over
    ``block`` rows is compared in pairs of blocks, so a task holds two blocks at most
    and a full bucket is spread over many tasks; each piece returns a spanning forest,
    never all its pairs.
    """
    def bits(pair):
        at, n = SEGMENTS[pair[0]]
        to, m = SEGMENTS[pair[1]]
        low = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
        return low * (1 << m) + F.shiftrightunsigned("fp", to).bitwiseAND(F.lit((1 << m) - 1))

    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), bits(pair).alias("value")) for k, pair in enumerate(KEYS)]))
    rows = classes.select("fp", "rep", entries.alias("e")).select("e.key", "e.value", "fp", "rep")
    full = rows.groupBy("key", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    full = cut(full.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    rows = rows.join(full, ["key", "value"])
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
    rows = rows.withColumn("part", F.explode(others))
    rows = rows.repartition("key", "value", "part").sortWithinPartitions("key", "value", "part")
    return rows.select("key", "value", "part", "fp", "rep").mapInPandas(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Texts without words, empty and null ones have fingerprint 0 and link like others.
    Repeated rows give repeated rows. A row without an id takes part in no link and is
    its own component (null). Equal fingerprints are folded before the search.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select("doc_id", fingerprint("text").alias("fp")))
    classes = cut(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes, block))
    named = cut(
        classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    discard(classes)
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", own)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group; of its repeated rows one.

    Rows without an id stay: nothing shows that they repeat anything. Texts without words
    (null ones too) have one fingerprint and so are one group. Of an id with several texts one
    row stays, if its id leads its group. Texts are read whole, however long. An empty table
    gives an empty one.
    """
    groups = near_duplicates(docs.where(F.col("doc_id").isNotNull()))
    keep = cut(groups.where("doc_id = component_id").select("doc_id").distinct())
    # one shuffle of the texts by id at every size; repeated rows are dropped within it
    kept = docs.join(keep.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
