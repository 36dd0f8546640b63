"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm.common import components, discard
from tracesieve.session import cut

THRESHOLD = 0.95
#: Length of the neighbour lists at first; doubled while the audit is not content.
LIST = 8
ROUNDS = 6
#: Sketch bits; pairs at ``THRESHOLD`` differ in about a tenth of them.
BITS, SEED = 256, 7
#: Sorted orders for the first graph, and how far neighbours are taken in each.
ORDERS, REACH = 8, 3
#: Bits beyond the expected difference (in standard deviations) at which an exact check is still made.
MARGIN = 6.0
#: Vectors asked against all others to measure recall, and the recall that is needed.
AUDIT, RECALL = 256, 0.98
#: Vectors with a link that the audit wants among those asked, and the most it asks for that.
LINKED, ASKED = 64, 16_384
BLOCK = 512
WORDS = BITS // 64


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketch(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signs of ``BITS`` random projections, as longs."""
    planes: dict[int, np.ndarray] = {}
    for column in vectors:
        sizes = np.asarray(pa.compute.list_value_length(column))
        out = np.zeros((len(column), WORDS), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size not in planes:
                planes[size] = np.random.default_rng([SEED, int(size)]).standard_normal((int(size), BITS))
            x = np.array(column.take(pa.array(at)).to_pylist(), np.float64)
            out[at] = np.packbits(x @ planes[size] > 0, axis=1).view(np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * WORDS, pa.int32()), pa.array(out.ravel()))


def _apart(a: Column, b: Column) -> Column:
    """Differing sketch bits."""
    total = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for k in range(1, WORDS):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return total


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one vector per id in double precision, without those that link with nothing."""
    v = F.col("embedding").cast("array<double>")
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _neighbours_in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of rows at most ``REACH`` apart in a sorted partition, both ways."""
    tail = None
    for frame in frames:
        frame = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
        new_from = 0 if tail is None else len(tail)
        turn, node = frame["turn"].to_numpy(), frame["node"].to_numpy()
        sketch = np.stack(frame["s"].to_numpy()) if len(frame) else np.zeros((0, WORDS), np.int64)
        parts = []
        for step in range(1, REACH + 1):
            i = np.arange(max(0, new_from - step), len(frame) - step)
            i = i[turn[i] == turn[i + step]]
            parts += [(i, i + step), (i + step, i)]
        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(a):
            yield _pairs(node, sketch, a, b)
        tail = frame.tail(REACH).reset_index(drop=True)


def _pairs(node: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    d = np.bitwise_count((sketch[a, :WORDS] ^ sketch[b, :WORDS]).view(np.uint64)).sum(1)
    return pd.DataFrame({"u": node[a], "w": node[b], "su": list(sketch[a]), "sw": list(sketch[b]), "d": d.astype(np.int32)})


def _others_in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of each row with the last ``REACH`` rows before its run of one component, both ways.

    The component is the last entry of the sketch. Of a long run only the ends are kept.
    """
    tail = None
    for frame in frames:
        frame = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
        n, new_from = len(frame), 0 if tail is None else len(tail)
        if not n:
            continue
        turn, node, sketch = frame["turn"].to_numpy(), frame["node"].to_numpy(), np.stack(frame["s"].to_numpy())
        begins = np.ones(n, bool)
        begins[1:] = (turn[1:] != turn[:-1]) | (sketch[1:, WORDS] != sketch[:-1, WORDS])
        start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        parts = []
        for step in range(1, REACH + 1):
            i = np.arange(new_from, n)
            i = i[start[i] >= step]
            j = start[i] - step
            met = (turn[i] == turn[j]) & (sketch[i, WORDS] != sketch[j, WORDS])
            parts += [(i[met], j[met]), (j[met], i[met])]
        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(a):
            yield _pairs(node, sketch, a, b)
        last = int(start[-1])
        tail = frame.iloc[[*range(max(0, last - REACH), last), *range(max(last, n - REACH), n)]].reset_index(drop=True)


def _order_keys(orders: int):
    """UDF from a sketch to one long per order: 63 of its bits, drawn anew for each order."""

    def run(sketches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        draw = np.random.default_rng(SEED)
        chosen = [draw.permutation(BITS)[:63] for _ in range(orders)]
        for column in sketches:
            bits = np.unpackbits(np.array(column.to_pylist(), np.int64).reshape(-1, WORDS).view(np.uint8), axis=1)
            keys = np.zeros((len(column), orders), np.int64)
            for turn, places in enumerate(chosen):
                packed = np.ascontiguousarray(np.packbits(bits[:, places], axis=1))  # the first bit weighs most
                keys[:, turn] = (packed.view(">u8")[:, 0] >> np.uint64(1)).astype(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * orders, pa.int32()), pa.array(keys.ravel()))

    run.__annotations__ = {"sketches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def first_graph(nodes: DataFrame, orders: int = ORDERS, apart: bool = False) -> DataFrame:
    """Candidate pairs from several orders of the sketches, each over other bits; ``apart``: of different components.

    Rows are dealt by range with the node as tie-breaker, so equal sketches do not meet
    in one task.
    """
    rows = nodes.select("node", "s", F.posexplode(_order_keys(orders)(F.slice("s", 1, WORDS))).alias("turn", "key"))
    rows = rows.repartitionByRange("turn", "key", "node").sortWithinPartitions("turn", "key", "node")
    return rows.mapInPandas(_others_in_order if apart else _neighbours_in_order, "u long, w long, su array<long>, sw array<long>, d int")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, with the distance that a better neighbour must beat."""
    one = pairs.groupBy("u", "w").agg(F.first("su").alias("su"), F.first("sw").alias("sw"), F.first("d").alias("d"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy("d", "w")
    kept = one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    full = F.max(F.when(F.col("r") == k, F.col("d"))).over(Window.partitionBy("u"))
    return kept.withColumn("worst", F.coalesce(full, F.lit(BITS + 1))).drop("r")


def descend(nodes: DataFrame, k: int = LIST, orders: int = ORDERS, rounds: int = ROUNDS, apart: bool = False) -> DataFrame:
    """Neighbour lists (u, w, su, sw, d): refined until few entries change.

    ``apart`` keeps to pairs of different components, which the sketches then carry as last entry.

    A round joins each list with the lists of its members; only pairs in which one entry
    is new are looked at, and only those that beat the node's worst neighbour go on.
    """
    graph = cut(_best(first_graph(nodes, orders, apart).withColumn("fresh", F.lit(1)), k))
    n = nodes.count()
    for _ in range(rounds):
        left = graph.select("u", F.col("w").alias("via"), "su", "worst", F.col("fresh").alias("f1"))
        right = graph.select(F.col("u").alias("via"), "w", "sw", F.col("fresh").alias("f2"))
        found = (
            left.join(right, "via").where("u <> w and f1 + f2 > 0").where(_foreign(F.col("su"), F.col("sw")) if apart else F.lit(True)).withColumn("d", _apart(F.col("su"), F.col("sw")).cast("int"))
            .where("d < worst").select("u", "w", "su", "sw", "d", F.lit(1).alias("fresh"))
        )
        old = graph.select("u", "w", "su", "sw", "d", F.lit(0).alias("fresh"))
        back = old.select(F.col("w").alias("u"), F.col("u").alias("w"), F.col("sw").alias("su"), F.col("su").alias("sw"), "d", F.lit(1).alias("fresh"))
        refined = cut(_best(old.unionByName(found).unionByName(back), k))
        discard(graph)
        graph = refined
        if graph.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0] <= 0.005 * n * k:
            break
    return graph


def _foreign(a: Column, b: Column) -> Column:
    return F.get(a, F.lit(WORDS)) != F.get(b, F.lit(WORDS))


def _cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(a) == F.size(b), dot / norm(a) / norm(b))


def sketch_limit(threshold: float) -> int:
    """Differing bits beyond which a pair at ``threshold`` is not expected."""
    p = float(np.arccos(threshold) / np.pi)
    return int(BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p)))


def threshold_edges(graph: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of the graph whose exact cosine is at least ``threshold``."""
    pairs = graph.where(F.col("d") <= sketch_limit(threshold)).select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    return pairs.where(_cosine(F.col("va"), F.col("vb")) >= threshold).select("a", "b")


def linked_components(nodes: DataFrame, k: int, orders: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of all nodes with a link.

    A list whose last entry is still within the sketch limit is saturated: its node may link
    with more, and with nodes of other components, which its own group keeps out of the list.
    So the saturated nodes descend again with lists that hold nodes of other components only,
    until no link joins two components any more. Inside a component ``linked_counts`` is exact.
    """
    graph = descend(nodes.select("node", "s"), k, orders)
    full = graph.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("entries"), F.max("d").alias("last"))
    full = cut(full.where((F.col("entries") >= k) & (F.col("last") <= sketch_limit(threshold))).select("node"))
    edges = cut(threshold_edges(graph, nodes, threshold))
    joined = cut(components(edges))
    while not full.isEmpty():
        named = nodes.join(full, "node").join(joined, "node", "left")
        named = cut(named.select("node", F.concat("s", F.array(F.coalesce("component", "node"))).alias("s")))
        if named.select(F.element_at("s", -1)).distinct().limit(2).count() < 2:
            break
        found = cut(threshold_edges(descend(named, LIST, orders, apart=True), nodes, threshold))
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        joined = cut(components(edges))
    return joined


def _unit_rows(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in frame["v"]])
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _count_links(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links of each row within its piece (component, part), which arrive sorted; rows of side 1 meet side 0."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        group = frame[["component", "part"]].to_numpy()
        change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        bounds = [0, *change]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield _piece(frame.iloc[lo:hi], threshold)
        rest = frame.iloc[bounds[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield _piece(rest, threshold)


def _piece(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    x, n, mine, other = _unit_rows(frame), frame["n"].to_numpy(), frame["mine"].to_numpy(), frame["other"].to_numpy()
    links = (x @ x.T) >= threshold
    np.fill_diagonal(links, False)
    links &= (mine[:, None] == other[None]) & (other[:, None] == mine[None])
    return pd.DataFrame({"node": frame["node"].to_numpy(), "links": links @ n})


def linked_counts(joined: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, links): how many vectors each node links with inside its component, exactly.

    So a saturated list is enlarged to the whole component.
    Components over ``block`` nodes are compared in pairs of blocks in separate tasks;
    counts leave a task, pairs do not.
    """
    sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
    sizes = cut(sizes.select("component", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    rows = joined.join(nodes.select("node", "n", "v"), "node").join(sizes, "component")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
    rows = rows.repartition("component", "part").sortWithinPartitions("component", "part").select("component", "part", "node", "n", "v", "mine", "other")
    pieces = rows.mapInPandas(lambda frames: _count_links(frames, threshold), "node long, links long")
    return pieces.groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT, most: int = ASKED) -> float | None:
    """Mean share of its true links that ``counts`` (node, links) has of a node with links.

    Each node counts alike, whatever the size of its group. About ``queries`` nodes (by
    hash) are asked, then four times as many until ``LINKED`` of them have a link or all
    or ``most`` are asked. None if a part was asked and none of it has a link: not measured.
    """
    total = nodes.count()
    while True:
        linked, recall = _recall(nodes, counts, threshold, min(1.0, queries / max(1, total)))
        if linked >= LINKED or queries >= min(total, most):
            return recall if linked else 1.0 if queries >= total else None
        queries = min(4 * queries, most)


def _recall(nodes: DataFrame, counts: DataFrame, threshold: float, share: float) -> tuple[int, float | None]:
    """How many nodes of a share have links, and their mean recall.

    The nodes asked go to every task, where blocks of all nodes meet them.
    """
    asked = [(r.node, r.v) for r in nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(10**9)) < int(share * 10**9)).select("node", "v").collect()]
    if not asked:
        return 0, None
    ids, vectors = np.array([a[0] for a in asked]), [np.asarray(a[1]) for a in asked]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = frame[sizes == size]
                same = [i for i, v in enumerate(vectors) if len(v) == size]
                for lo in range(0, len(same), BLOCK):
                    at = same[lo : lo + BLOCK]
                    q = np.stack([vectors[i] for i in at])
                    links = (q / np.sqrt((q**2).sum(1, keepdims=True))) @ _unit_rows(part).T >= threshold
                    links &= ids[at][:, None] != part["node"].to_numpy()[None]
                    yield pd.DataFrame({"node": ids[at], "true": links @ part["n"].to_numpy()})

    true = nodes.select("node", "n", "v").mapInPandas(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    got = true.where(F.col("true") > 0).join(counts, "node", "left").agg(F.count("*"), F.avg(share)).first()
    return got[0], got[1]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float | None]:
    """(vec_id, n_links, component_id, kept) with one row per id, and the measured recall.

    Equal vectors are folded first. The search is repeated with lists and orders twice as
    large while the audit finds less than ``RECALL`` of a node's true links, or cannot
    measure it and still finds new ones. The first graph's orders grow with the logarithm of the rows. A vector that is
    null, empty, zero or has null or non-finite components links with nothing; vectors of
    different length do not link. Rows that repeat an id count once, with the smallest of
    their usable vectors; rows without an id are left out.
    """
    good = cut(usable(vectors))
    folded = good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = cut(folded.select("node", "n", "v", _sketch("v").alias("s")))
    total = nodes.count()
    k, orders, known = LIST, max(ORDERS, total.bit_length()), None
    while True:
        joined = linked_components(nodes, k, orders, threshold)
        counts = cut(linked_counts(joined, nodes, threshold))
        recall = audit(nodes, counts, threshold)
        found = counts.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
        # not measured: once more, until twice the effort finds nothing new
        if k >= total or (found == known if recall is None else recall >= RECALL):
            break
        k, orders, known = 2 * k, 2 * orders, found
    named = (
        nodes.select("node", "n", "v").join(joined, "node", "left").join(counts, "node", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    # equal vectors carry their hash, so the join back ships no vector twice
    key = F.xxhash64("v")
    pairs = good.select("vec_id", key.alias("h"), "v").alias("g").join(cut(named.withColumn("h", key)).alias("c"), F.expr("g.h = c.h and g.v = c.v"))
    pairs = pairs.select("g.vec_id", "c.n_links", "c.component_id")
    rest = vectors.select("vec_id").where("vec_id is not null").distinct().join(good.select("vec_id"), "vec_id", "left_anti")
    result = pairs.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id")), recall
