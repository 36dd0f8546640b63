"""Vector operators: centroids, distances and exact nearest-neighbour joins.

The join (``neighbours``) meets blocks of queries and blocks of base rows on a grid:

* a ``Grid`` deals the base rows to pivots (about sqrt(n) / 16 by chance, so their number
  grows with the base; beyond ``BLOCK`` rows as many again and ``FAR`` that are far from all
  others, since the rows of a cluster without a pivot would lie in the cells of all others
  and keep every block open), cuts a
  large cell into rings of the distance to its pivot, and a large ring into parts by a hash
  of the id. No block has much more than ``block`` rows, whatever the distribution. The
  driver holds the pivots, the rows they were chosen from and a few numbers for each block.
* a query visits the blocks that the triangle inequality leaves open: those whose smallest
  and largest distance to the pivot can be met within the query's bound (Lu, Shen, Chen,
  Ooi 2012; Das Sarma, He, Chaudhuri 2014). Queries are blocked likewise, and each pair of
  blocks is one cogroup, multiplied in chunks, with at most ``k`` rows per query coming out.
* where few blocks can be left out, the pairs of blocks would shuffle a multiple of the rows.
  Beyond ``SPREAD`` times the rows every block is written once as a matrix, and a cartesian
  product reads the pairs, so what is shuffled grows with the rows, not with the pairs.

Answers are exact at every size. Rows whose vector is null or holds a null or non-finite
number have no neighbours and are nobody's. Cosine is taken of vectors brought to length
one; a zero vector has cosine 0 with every vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.schemas import NOISE
from tracesieve.session import cut

BLOCK = 8192
#: Query rows compared with a block at a time; their products should fit a core's cache.
CHUNK = 64
#: The same in single precision, columns of which only the smallest is looked at first, and
#: possible answers per query from which on double precision is the cheaper way to tell them apart.
COARSE_CHUNK, FOLD, CLOSE = 256, 128, 64
RINGS = 64
#: Pivots far apart besides those for sqrt(n), and rows looked at for each of them.
FAR, LOOKED = 16, 16
#: Rows shuffled for the pairs of blocks, as a multiple of the rows of both sides.
SPREAD = 4
SLACK = 1e-6
TIE = 1e-12


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cluster_centroids(assigned: DataFrame) -> DataFrame:
    """Mean vector (not re-normalised) of each cluster; noise has none.

    ``assigned``: cluster_id, embedding. Means are combined map-side, so a
    large cluster does not gather in one task.
    """
    mean = Summarizer.mean(array_to_vector(as_double(F.col("embedding"))))
    return (
        assigned.filter(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id").agg(mean.alias("m"), F.count("*").alias("size"))
        .select("cluster_id", "size", vector_to_array("m").alias("centroid"))
    )


@dataclass(frozen=True)
class Want:
    """What counts as a neighbour and how many to keep."""

    k: int = 1
    metric: str = "euclidean"  # "euclidean", "cosine" (unit vectors) or "reach"
    within: float | None = None  # largest distance, or smallest cosine
    earlier: bool = False  # base rows before the query by (ord, id)
    other_group: bool = False  # base rows of another ``grp``
    not_self: bool = False

    @property
    def optional(self) -> list[str]:
        used = [("ord", self.earlier), ("grp", self.other_group), ("core", self.metric == "reach")]
        return [name for name, on in used if on]

    @property
    def radius(self) -> float:
        """The bound as a Euclidean distance."""
        if self.within is None:
            return np.inf
        return float(np.sqrt(max(0.0, 2 - 2 * self.within))) if self.metric == "cosine" else self.within


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in the order of the values, shared by both arrays."""
    codes = np.unique(np.concatenate([left, right]), return_inverse=True)[1]
    return codes[: len(left)].astype(np.int32), codes[len(left):].astype(np.int32)


def _exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Sort key of row pairs, independent of the block they are in."""
    if metric == "cosine":
        return -np.einsum("ij,ij->i", q, b)
    diff = q - b
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def no_rows(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _kth(key: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that its ``k``-th smallest does not exceed; for ``k`` = 1 the smallest itself."""
    n = key.shape[1]
    if n <= k:
        return np.full(len(key), np.inf)
    if k == 1:
        return key.min(axis=1)
    # the smallest of each column of a fold are of different columns of ``key``
    width = max(64, 16 * k)
    if n >= 4 * width:
        whole = n - n % width
        least = key[:, :whole].reshape(len(key), -1, width).min(axis=1)
        key = np.concatenate([least, key[:, whole:]], axis=1)
    return np.partition(key, k - 1, axis=1)[:, k - 1]


def _coarse(queries: np.ndarray, base: np.ndarray, hide: Callable[[slice, np.ndarray], None], k: int, least: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Places of all pairs that may be among the ``k`` largest products of a query, or a slice alone if they are many.

    Products of rows no longer than one are formed in single precision, at a third of the cost.
    The margin is twice what rounding can move them (Higham, Accuracy and Stability of
    Numerical Algorithms, 3.1), so no answer is lost; the caller compares the exact products.
    Products below ``least`` are left out; ``hide`` sets what does not count to infinity.
    """
    margin = 4 * (queries.shape[1] + 4) * 2.0 ** -24
    n, width = len(base), -(-len(base) // FOLD) * FOLD
    factors = np.ascontiguousarray(-base.astype(np.float32)).T
    room = np.full((min(COARSE_CHUNK, len(queries)), width), np.inf, dtype=np.float32)
    for start in range(0, len(queries), COARSE_CHUNK):
        span = slice(start, min(start + COARSE_CHUNK, len(queries)))
        key = room[: span.stop - start]
        np.matmul(queries[span].astype(np.float32), factors, out=key[:, :n])
        hide(span, key[:, :n])
        folds = key.reshape(len(key), -1, FOLD)
        smallest = folds.min(axis=2)
        # the smallest of k folds are k products; few folds do not tell enough
        bound = _kth(smallest if smallest.shape[1] >= 4 * k else key[:, :n], k).astype(np.float64)
        limit = np.minimum(np.minimum(bound, -least) + margin, np.finfo(np.float32).max)
        rows, at = np.nonzero(smallest <= limit[:, None])
        if len(rows) * FOLD > key.size / 2:
            rows, cols = np.nonzero(key <= limit[:, None])
        else:
            hit, place = np.nonzero(folds[rows, at] <= limit[rows, None])
            rows, cols = rows[hit], at[hit] * FOLD + place
        if len(rows) > CLOSE * len(key):
            yield span, None, None
        else:
            yield span, rows, cols


def _best(q: pd.DataFrame, b: pd.DataFrame, want: Want) -> pd.DataFrame:
    """The ``k`` best base rows of each query row of two blocks."""
    if not len(q) or not len(b):
        return no_rows("qid", "bid", "key")
    base, base_ids = _matrix(b["v"]), b["id"].to_numpy(dtype=object)
    queries, q_ids = _matrix(q["v"]), q["id"].to_numpy(dtype=object)
    if want.metric == "reach":
        core_q, core_b = q["core"].to_numpy(dtype=float), b["core"].to_numpy(dtype=float)
    # ids and groups as integers, so that comparing blocks stays in numpy
    id_q, id_b = _codes(q_ids, base_ids)
    if want.other_group:
        grp_q, grp_b = _codes(q["grp"].to_numpy(dtype=object), b["grp"].to_numpy(dtype=object))
    if want.earlier:
        order = np.lexsort((np.r_[id_q, id_b], np.r_[q["ord"].to_numpy(), b["ord"].to_numpy()]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        rank_q, rank_b = place[: len(q)], place[len(q):]

    def hide(span: slice, key: np.ndarray) -> None:
        if want.not_self:
            key[id_q[span, None] == id_b] = np.inf
        if want.other_group:
            np.copyto(key, np.inf, where=grp_q[span, None] == grp_b)
        if want.earlier:
            np.copyto(key, np.inf, where=rank_b >= rank_q[span, None])

    def fine(whole: slice) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        # products that need only the squares added are the squared distances
        factors = (-base if want.metric == "cosine" else -2 * base).T
        base_sq, q_sq = np.einsum("ij,ij->i", base, base), np.einsum("ij,ij->i", queries, queries)
        for start in range(whole.start, whole.stop, CHUNK):
            span = slice(start, min(start + CHUNK, whole.stop))
            key, tie = queries[span] @ factors, TIE
            if want.metric != "cosine":
                # the tie margin is far above the rounding error of the squares
                key += q_sq[span, None]
                key += base_sq
                np.maximum(key, 0.0, out=key)
                tie = TIE * (1 + q_sq[span].max(initial=0.0) + base_sq.max(initial=0.0))
            if want.metric == "reach":
                np.maximum(key, core_q[span, None] ** 2, out=key)
                np.maximum(key, core_b ** 2, out=key)
            hide(span, key)
            limit = np.minimum(_kth(key, want.k) + tie, np.finfo(np.float64).max)
            if want.within is not None:
                limit = np.minimum(limit, (-want.within if want.metric == "cosine" else want.within ** 2) + tie)
            yield span, *np.nonzero(key <= limit[:, None])

    def near() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        if want.metric != "cosine":
            yield from fine(slice(0, len(q)))
            return
        for span, rows, cols in _coarse(queries, base, hide, want.k, -np.inf if want.within is None else want.within):
            if rows is None:
                yield from fine(span)
            else:
                yield span, rows, cols

    found = []
    for span, rows, cols in near():
        if not len(rows):
            continue
        vectors, ids = queries[span], q_ids[span]
        value = np.concatenate([
            _exact(vectors[rows[i:i + 4096]], base[cols[i:i + 4096]], want.metric)
            for i in range(0, len(rows), 4096)
        ])
        if want.metric == "reach":
            value = np.maximum(value, np.maximum(core_q[span][rows], core_b[cols]))
        if want.within is not None:
            ok = value <= (-want.within if want.metric == "cosine" else want.within)
            rows, cols, value = rows[ok], cols[ok], value[ok]
        order = np.lexsort((id_b[cols], value, rows))
        rows, cols, value = rows[order], cols[order], value[order]
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        keep = nth < want.k
        found.append((ids[rows[keep]], base_ids[cols[keep]], value[keep]))
    qid, bid, value = (np.concatenate(c) for c in zip(*found)) if found else ([], [], np.zeros(0))
    return pd.DataFrame({"qid": pd.Series(qid, dtype=object), "bid": pd.Series(bid, dtype=object), "key": value})


_FOUND = "qid string, bid string, key double"


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(sq, 0.0))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def usable(df: DataFrame, metric: str, base: bool) -> DataFrame:
    """Rows with a finite vector ``v``, for cosine in two more dimensions and of length one.

    The two dimensions keep zero vectors of both sides at cosine 0 to everything.
    """
    df = df.withColumn("v", as_double(F.col("v"))).filter(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    )
    if metric != "cosine":
        return df
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    exact = F.abs(F.col("_length") - 1) < 1e-9
    zero = [F.lit(float(base)), F.lit(float(not base))]
    unit = F.when(F.col("_length") == 0, F.concat("v", F.array(*zero))).otherwise(
        F.concat(F.when(exact, F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("_length"))), F.array(F.lit(0.0), F.lit(0.0)))
    )
    return df.withColumn("_length", length).withColumn("v", unit).drop("_length")


@dataclass(frozen=True)
class Grid:
    """Base rows in blocks, and per block what bounds the distance to its rows."""

    rows: DataFrame  # id, v, further columns, block
    metric: str
    block: int  # rows that a block should hold
    pivots: np.ndarray
    cell: np.ndarray  # by block: its pivot
    name: np.ndarray  # by block: its value in ``rows``
    low: np.ndarray  # by block: smallest and largest distance of a row to the pivot
    high: np.ndarray
    near: np.ndarray  # by pivot: smallest distances of rows to it, in order
    first: np.ndarray  # by block: smallest ``ord``
    group: np.ndarray  # by block: its only group, or None
    size: np.ndarray  # by block: rows, or more than there are

    def relabelled(self, labels: DataFrame) -> Grid:
        """The same blocks with the groups (id, grp) of ``labels``."""
        rows = cut(self.rows.drop("grp").join(labels.select("id", "grp"), "id"))
        group = np.full(len(self.name), None, dtype=object)
        place = {int(name): i for i, name in enumerate(self.name)}
        for r in rows.groupBy("block").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).collect():
            group[place[r.block]] = r.g0 if r.g0 == r.g1 else None
        return replace(self, rows=rows, group=group)

    def only(self, ids: DataFrame) -> Grid:
        """The rows whose ``id`` is among ``ids``; the bounds still hold, except those on how many rows are near."""
        return replace(self, rows=self.rows.join(ids.select("id"), "id", "left_semi"), near=np.full(self.near.shape, np.inf))


def _far_apart(rows: np.ndarray, first: int, wanted: int) -> np.ndarray:
    """The ``first`` rows, and others until there are ``wanted``: each the farthest from all before."""
    chosen = list(range(min(first, len(rows))))
    away = _to_pivots(rows, rows[chosen]).min(axis=1)
    away[chosen] = 0.0
    while len(chosen) < wanted and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _to_pivots(rows, rows[chosen[-1:]])[:, 0])
        away[chosen[-1]] = 0.0
    return rows[chosen]


def build_grid(base: DataFrame, metric: str = "euclidean", block: int | None = None, k: int = 1) -> Grid:
    """Deal ``base`` (id, v and further columns) to blocks; ``k``: how many neighbours may be asked for."""
    block = block or BLOCK
    base = cut(usable(base, metric, True))
    n = base.count()
    wanted = max(1, int(np.ceil(np.sqrt(n) / 16)))
    far = wanted + FAR if n > BLOCK else 0  # of few rows all pairs are cheap
    # at most a few times sqrt(n) vectors
    chosen = base.orderBy(F.xxhash64("id"), "id").limit(LOOKED * (wanted + far) if far else wanted).select("v").collect()
    pivots = _far_apart(np.array([r.v for r in chosen], dtype=np.float64), wanted, wanted + far) if chosen else np.zeros((0, 1))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _to_pivots(_matrix(pdf["v"]), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), to_pivot=d[np.arange(len(pdf)), cell])

    placed = cut(base.mapInPandas(nearest, f"{_fields(base)}, cell int, to_pivot double"))
    rows = placed.withColumn("block", F.col("cell").cast("bigint") * (RINGS << 24)) if n <= block else _in_rings(placed, block)
    extra = [F.min("ord").alias("first")] if "ord" in base.columns else []
    extra += [F.min("grp").alias("g0"), F.max("grp").alias("g1")] if "grp" in base.columns else []
    # one row for each block
    facts = rows.groupBy("block").agg(
        F.first("cell").alias("cell"), F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high"), F.count("*").alias("size"), *extra
    )
    facts = facts.orderBy("block").collect()
    order = Window.partitionBy("cell").orderBy("to_pivot")
    low = placed.select("cell", "to_pivot").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    near = np.full((len(pivots), k + 1), np.inf)
    for r in low.collect():  # k + 1 rows for each pivot
        near[r.cell, r.n - 1] = r.to_pivot
    column = lambda name, kind=np.float64: np.array([r[name] for r in facts], dtype=kind)
    return Grid(
        rows.drop("cell", "to_pivot"), metric, block, pivots, column("cell", np.int64), column("block", np.int64), column("low"), column("high"), near,
        column("first") if "ord" in base.columns else np.full(len(facts), -np.inf),
        np.array([r.g0 if r.g0 == r.g1 else None for r in facts] if "grp" in base.columns else [None] * len(facts), dtype=object),
        column("size", np.int64),
    )


def _in_rings(placed: DataFrame, block: int) -> DataFrame:
    """Add ``block``: the cell, its ring by distance to the pivot, and a part of the ring by hash."""
    share = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("to_pivot", share, F.lit(1000)).alias("bounds"))
    cells = F.broadcast(cells.withColumn("rings", F.least(F.ceil(F.col("n") / F.lit(float(block))), F.lit(RINGS))).drop("n"))
    fine = F.size(F.filter("bounds", lambda b: b < F.col("to_pivot")))
    ringed = placed.join(cells, "cell").withColumn("ring", F.floor(fine * F.col("rings") / RINGS).cast("bigint")).drop("bounds", "rings")
    # at most RINGS rows for each pivot; rows of equal distance share a ring, so a ring may still be large
    parts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    block_name = (F.col("cell").cast("bigint") * RINGS + F.col("ring")) * (1 << 24) + part
    return ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("block", block_name).drop("ring", "parts")


def plan_visits(queries: DataFrame, grid: Grid, want: Want, all_within: bool = False, ignore_order: bool = False) -> DataFrame:
    """Queries (id, v, columns of ``want``, optional upper bound ``ub``) with their block and the base blocks left open.

    ``all_within`` keeps every block that may hold a row within ``want.within``, not only those of the ``k``
    nearest; ``ignore_order`` also keeps those whose rows all come later.
    """
    columns = ["id", "v", *want.optional]
    queries = usable(queries.select(*columns, *[c for c in queries.columns if c == "ub"]), want.metric, False)
    bounded_by_base = not (all_within or want.earlier or want.other_group or want.metric == "reach")
    k = want.k + int(want.not_self)
    has_bound = "ub" in queries.columns
    pivots, cell, low, high, near = grid.pivots, grid.cell, grid.low, grid.high, grid.near[:, :k]
    name, first, group = grid.name, grid.first, grid.group
    size = float(np.sqrt((pivots ** 2).sum(1).max(initial=0.0)) + high.max(initial=0.0))
    step = max(1, 4_000_000 // max(1, len(name), near.size))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole) if len(name) else 0, step):
                pdf = whole.iloc[at : at + step]
                vectors = _matrix(pdf["v"])
                d = _to_pivots(vectors, pivots)
                bound = np.full(len(pdf), want.radius)
                if has_bound:
                    bound = np.minimum(bound, pdf["ub"].to_numpy())
                if bounded_by_base:
                    reach = (d[:, :, None] + near[None]).reshape(len(pdf), -1)
                    bound = np.minimum(bound, np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] > k - 1 else np.inf)
                bound = (bound + SLACK * (1 + size + np.sqrt((vectors ** 2).sum(1))))[:, None]
                own = d[:, cell]
                open_ = (own - high <= bound) & (low - own <= bound)
                if want.earlier and not ignore_order:
                    open_ &= first <= pdf["ord"].to_numpy()[:, None]
                if want.other_group:
                    open_ &= pdf["grp"].to_numpy(dtype=object)[:, None] != group
                rows, blocks = np.nonzero(open_)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), visit=np.split(name[blocks], np.searchsorted(rows, np.arange(1, len(pdf)))))

    planned = cut(queries.mapInPandas(visit, f"{_fields(queries)}, cell int, visit array<bigint>"))
    # one number for each pivot
    counts = {r.cell: r["count"] for r in planned.groupBy("cell").count().collect()}
    start, parts, held = [0] * max(1, len(pivots)), [1] * max(1, len(pivots)), 0
    free = -1  # the block that takes small cells until it is full
    for c, count in sorted(counts.items()):
        start[c], parts[c] = c << 24, -(-count // grid.block)
        if parts[c] == 1:
            free, held = (c, count) if free < 0 or held + count > grid.block else (free, held + count)
            start[c] = free << 24
    at = F.col("cell") + 1
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(n) for n in parts]), at).cast("bigint"))
    return planned.withColumn("qblock", F.element_at(F.array(*[F.lit(n).cast("bigint") for n in start]), at) + part).drop("cell")


def meet(
    planned: DataFrame, grid: Grid, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    merge: Callable[[DataFrame], DataFrame] = lambda found: found, together: bool = False,
) -> DataFrame:
    """``kernel`` on every block of queries and every base block that one of them visits; ``merge`` combines the answers.

    ``together``: the kernel may also be given several blocks that the same queries visit as one.
    """
    pairs = planned.select(F.col("qblock").alias("qb"), F.explode("visit").alias("block"))
    visited = cut(pairs.groupBy("qb", "block").count())
    # one row for each base block
    asked = visited.groupBy("block").agg(F.sum("count").alias("rows"), F.count("*").alias("blocks")).collect()
    sizes = dict(zip(grid.name.tolist(), grid.size.tolist()))
    moved = sum(r.rows + r.blocks * sizes[r.block] for r in asked)
    if moved > SPREAD * (planned.count() + sum(sizes.values())):
        return _meet_in_place(planned, grid, kernel, schema, merge, visited, together)
    spread = planned.withColumn("bblock", F.explode("visit")).drop("visit")
    copies = grid.rows.join(visited.drop("count"), "block").withColumnRenamed("block", "bb")
    return merge(spread.groupBy("qblock", "bblock").cogroup(copies.groupBy("qb", "bb")).applyInPandas(kernel, schema))


def _packed(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block ``key``: its vectors as one matrix, the other columns as arrays."""
    others = [f for f in rows.schema.fields if f.name not in (key, "v")]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {key: [pdf[key].iloc[0]], "v": [_matrix(pdf["v"]).tobytes()]}
        return pd.DataFrame(row | {f.name: [pdf[f.name].tolist()] for f in others})

    fields = "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in others)
    # a number of its own, so that small tables are not put into one task
    return cut(rows.repartition(max(1, blocks), key).groupBy(key).applyInPandas(pack, f"{key} bigint, v binary{fields}"))


def _unpacked(row: pd.Series, columns: list[str], kinds: dict[str, str]) -> pd.DataFrame:
    """The rows of a packed block."""
    values = {c: np.array(row[c], dtype=np.float64 if kinds[c] == "double" else None if kinds[c] == "bigint" else object) for c in columns}
    matrix = np.frombuffer(row["v"], dtype=np.float64).reshape(len(next(iter(values.values()))), -1)
    return pd.DataFrame({"v": pd.Series(list(matrix), dtype=object)} | values)


def _bundles(grid: Grid) -> dict[int, int]:
    """By block: the bundle it travels in. Neighbouring blocks share one while it holds no more than ``grid.block`` rows."""
    bundles, number, held = {}, 0, 0
    for i in np.argsort(grid.name):
        rows = int(grid.size[i])
        if held and held + rows > grid.block:
            number, held = number + 1, 0
        bundles[int(grid.name[i])], held = number, held + rows
    return bundles


def _meet_in_place(planned: DataFrame, grid: Grid, kernel: Callable, schema: str, merge: Callable, visited: DataFrame, together: bool) -> DataFrame:
    """The same by a cartesian product of packed blocks: each row is shuffled once, whatever it visits.

    Small base blocks are packed in bundles, as each of them would bring a copy of the block of queries along.
    """
    names = np.sort(grid.name)
    spark, travel = planned.sparkSession, _bundles(grid)
    kinds = {f.name: f.dataType.simpleString() for f in [*planned.schema.fields, *grid.rows.schema.fields]}
    q_columns = [c for c in planned.columns if c not in ("v", "visit", "qblock")]
    b_columns = [c for c in grid.rows.columns if c != "v"]

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.zeros((len(pdf), len(names)), dtype=bool)
            for i, blocks in enumerate(pdf["visit"]):
                bits[i, np.searchsorted(names, np.asarray(blocks, dtype=np.int64))] = True
            yield pdf.assign(visit=[row.tobytes() for row in np.packbits(bits, axis=1)])

    fields = ", ".join("`visit` binary" if f.name == "visit" else f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema.fields)
    n_queries = visited.select("qb").distinct().count()
    queries = _packed(planned.filter(F.size("visit") > 0).mapInPandas(marked, fields), "qblock", n_queries)
    # one row for each base block
    bundles = F.broadcast(spark.createDataFrame(list(travel.items()), "block bigint, bundle bigint"))
    visits = cut(visited.join(bundles, "block").groupBy(F.col("qb").alias("qblock")).agg(F.collect_set("bundle").alias("visits")))
    # bundle names only, at most one for each pair of blocks
    queries = queries.join(F.broadcast(visits), "qblock")
    queries = queries.select("qblock", "visits", F.col("v").alias("qv"), F.col("visit").alias("bits"), *[F.col(c).alias(f"q_{c}") for c in q_columns])
    base = grid.rows.join(visited.select("block").distinct(), "block", "left_semi").join(bundles, "block")
    base = _packed(base, "bundle", len(set(travel.values()))).select("bundle", "v", *[F.col(c).alias(f"b_{c}") for c in b_columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                octets = np.frombuffer(b"".join(row["bits"]), dtype=np.uint8).reshape(len(row["bits"]), -1)
                q = _unpacked(pd.Series({"v": row["qv"]} | {c: row[f"q_{c}"] for c in q_columns}), q_columns, kinds)
                b = _unpacked(pd.Series({"v": row["v"]} | {c: row[f"b_{c}"] for c in b_columns}), b_columns, kinds)
                asked: dict[bytes | int, tuple[np.ndarray, list[int]]] = {}
                for block in np.unique(b["block"].to_numpy()).tolist():
                    place = int(np.searchsorted(names, block))
                    rows = (octets[:, place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
                    if rows.any():
                        asked.setdefault(rows.tobytes() if together else block, (rows, []))[1].append(block)
                for rows, blocks in asked.values():
                    part = b[b["block"].isin(blocks)].drop(columns="block").reset_index(drop=True)
                    asking = q if rows.all() else q[rows].reset_index(drop=True)
                    yield kernel(asking.assign(qblock=row["qblock"], bblock=blocks[0]), part.assign(qb=row["qblock"], bb=blocks[0]))

    met = queries.join(base.hint("shuffle_replicate_nl"), F.array_contains("visits", F.col("bundle"))).drop("visits")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")  # a row is two whole blocks
    try:
        return cut(merge(met.mapInPandas(run, schema)))
    finally:
        spark.conf.set(setting, before)


def _merge(found: DataFrame, want: Want) -> DataFrame:
    """The k best of the partial answers of each query."""
    if want.k == 1:
        best = found.groupBy("qid").agg(F.min(F.struct("key", "bid")).alias("b"))
        return best.select("qid", "b.bid", "b.key", F.lit(1).alias("n"))
    order = Window.partitionBy("qid").orderBy("key", "bid")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= want.k)


def neighbours(queries: DataFrame, base: DataFrame | Grid, want: Want, block: int | None = None) -> DataFrame:
    """The ``want.k`` nearest base rows of every query, exactly.

    Both sides have ``id`` (string) and ``v`` (vector), and as ``want`` asks
    ``ord``, ``grp`` or ``core``; queries may carry ``ub``, a known upper bound
    of the answer's value. Result: qid, bid, value (cosine or distance), n
    (1 is the best). Queries without an answer are absent. A ``Grid`` of the base
    can be used for many calls.
    """
    if not isinstance(base, Grid):
        base = build_grid(base.select("id", "v", *want.optional), want.metric, block, want.k)
    found = meet(plan_visits(queries, base, want), base, lambda q, b: _best(q, b, want), _FOUND, lambda found: _merge(found, want), together=True)
    value = -F.col("key") if want.metric == "cosine" else F.col("key")
    return found.select("qid", "bid", value.alias("value"), F.col("n").cast("int").alias("n"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Closest centroid of each row (id, v); ties go to the smaller cluster id."""
    base = centroids.select(F.format_string("%012d", "cluster_id").alias("id"), F.col("centroid").alias("v"))
    return neighbours(vectors, base, Want()).select(
        F.col("qid").alias("id"), F.col("bid").cast("int").alias("cluster_id"), F.col("value").alias("distance")
    )


def fold_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (id, v, ...) with ``point``, shared by equal vectors; a zero vector is only like itself by id."""
    clean = F.transform(as_double(F.col("v")), lambda x: x + F.lit(0.0))  # no negative zeros
    zero = F.forall(clean, lambda x: x == 0)
    name = F.coalesce(F.concat(F.to_json(clean), F.when(zero, F.col("id")).otherwise(F.lit(""))), F.concat(F.lit("-"), F.col("id")))
    return rows.withColumn("v", clean).withColumn("point", F.md5(name.cast("binary")))


def _links(q: pd.DataFrame, b: pd.DataFrame, within: float) -> pd.DataFrame:
    """Per query of two blocks of points: rows it links with, and the best of them."""
    if not len(q) or not len(b):
        return no_rows("qid", "links", "key", "bid")
    base, copies, names, ids = _matrix(b["v"]), b["copies"].to_numpy(), b["class_id"].to_numpy(dtype=object), b["id"].to_numpy(dtype=object)
    order = np.argsort(names)
    base, copies, names, ids = base[order], copies[order], names[order], ids[order]
    id_q, id_b = _codes(q["id"].to_numpy(dtype=object), ids)
    out = []
    for start in range(0, len(q), CHUNK):
        vectors = _matrix(q["v"].iloc[start : start + CHUNK])
        cosine = vectors @ base.T
        cosine[id_q[start : start + CHUNK, None] == id_b[None, :]] = -np.inf
        rows, cols = np.nonzero(np.abs(cosine - within) <= TIE)
        cosine[rows, cols] = -_exact(vectors[rows], base[cols], "cosine")
        near = cosine >= within
        # equal values by a hair: the exact one decides, then the smaller id
        best = cosine.max(axis=1)
        rows, cols = np.nonzero(near & (cosine >= best[:, None] - TIE))
        value = -_exact(vectors[rows], base[cols], "cosine")
        place = np.lexsort((cols, -value, rows))
        first = place[np.unique(rows[place], return_index=True)[1]]
        out.append((q["id"].to_numpy(dtype=object)[start + rows[first]], (near @ copies)[rows[first]], -value[first], names[cols[first]]))
    qid, links, key, bid = map(np.concatenate, zip(*out))
    return pd.DataFrame({"qid": pd.Series(qid, dtype=object), "links": links, "key": key, "bid": pd.Series(bid, dtype=object)})


def similarity_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Every vector (id, v) with its class, its number of links, and its most similar other vector.

    A link joins two rows with cosine of at least ``threshold``. Result, one row per row:
    id, class_id (smallest id with an equal vector), n_links, other_id and similarity (null
    without a link; of equal ones the smallest id). Equal vectors meet once as a class, so no
    row stands for more than one block's worth of work; no pair is left out of ``n_links``.
    """
    keyed = cut(fold_copies(vectors.select("id", "v")))
    classes = keyed.groupBy("point").agg(
        F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("class_id"),
    )
    points = cut(classes.select(F.col("point").alias("id"), "v", "copies", "class_id"))
    want = Want(metric="cosine", within=threshold, not_self=True)
    grid = build_grid(points, "cosine")
    linked = meet(
        plan_visits(points, grid, want, all_within=True), grid, lambda q, b: _links(q, b, threshold), "qid string, links long, key double, bid string",
        lambda found: found.groupBy(F.col("qid").alias("point")).agg(F.sum("links").alias("links"), F.min(F.struct("key", "bid")).alias("best")),
    )
    # the partner of a copy is the first of its class, that of the first is the second
    second = keyed.join(points.select(F.col("id").alias("point"), "class_id"), "point").filter(F.col("id") != F.col("class_id"))
    second = second.groupBy("point").agg(F.min("id").alias("second"))
    rows = (
        keyed.select("id", "point").join(points.select(F.col("id").alias("point"), "copies", "class_id"), "point")
        .join(linked, "point", "left").join(second, "point", "left")
    )
    twin = F.when(F.col("id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))
    has_twin = F.col("copies") > 1
    return rows.select(
        "id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(has_twin, twin).otherwise(F.col("best.bid")).alias("other_id"), F.when(has_twin, F.lit(1.0)).otherwise(-F.col("best.key")).alias("similarity"),
    )


def most_similar(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k base rows of highest cosine similarity for each query."""
    found = neighbours(queries, base, replace(Want(metric="cosine"), k=k))
    return found.select(
        F.col("qid").alias("id"), F.col("bid").alias("other_id"), F.col("value").alias("similarity"), F.col("n").alias("rank")
    )
