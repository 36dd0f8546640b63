"""Density clustering (HDBSCAN; Campello, Moulavi, Sander 2013) as Spark jobs.

1. Exact copies fold into one weighted point; core distances come from the
   neighbour join.
2. The minimum spanning tree of mutual reachability is built in Boruvka rounds:
   each round finds the lightest outgoing edge of every component with the
   neighbour join and contracts by pointer jumping.
3. The hierarchy is merged bottom-up. Edges are taken in bands of rising weight;
   the components of a band are independent, so each is one small group. A band
   is narrowed until no component has more than ``BAND`` edges.
4. Excess-of-mass selection happens at the merge, since a cluster that closes
   knows its own stability and that of its children. What is left is finding
   the topmost kept ancestor, by pointer jumping.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.operators.ordering import number_rows
from tracesieve.operators.vectors import Grid, Want, as_double, build_grid, neighbours
from tracesieve.schemas import NOISE
from tracesieve.session import cut

# A core distance reaches the min_samples-th other point; the point itself is not counted.
COUNT_SELF = 0
BAND = 200_000
FLOOR = 1e-9


def _fold_copies(rows: DataFrame) -> DataFrame:
    """Original id with the key of its vector; equal vectors share the key."""
    clean = F.transform(as_double(F.col("v")), lambda x: x + F.lit(0.0))
    return rows.select("id", clean.alias("v")).withColumn("point", F.md5(F.to_json("v").cast("binary")))


def core_distances(points: DataFrame, grid: Grid, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Weighted points (id, v, copies) with ``core``, and the mutual reachability of near points (id, bid, value)."""
    wanted = min_samples + 1 - COUNT_SELF
    found = cut(neighbours(points, grid, Want(k=wanted)))
    weights = points.select(F.col("id").alias("bid"), "copies")
    so_far = Window.partitionBy("qid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    reached = cut(
        found.join(weights, "bid").withColumn("seen", F.sum("copies").over(so_far))
        .filter(F.col("seen") >= wanted).groupBy(F.col("qid").alias("id")).agg(F.min("value").alias("core"))
    )
    near = (
        found.filter("qid <> bid").join(reached.select(F.col("id").alias("qid"), "core"), "qid")
        .join(reached.select(F.col("id").alias("bid"), F.col("core").alias("bcore")), "bid")
        .select(F.col("qid").alias("id"), "bid", F.greatest("value", "core", "bcore").alias("value"))
    )
    return points.join(reached, "id"), cut(near)


def contract(pointers: DataFrame) -> DataFrame:
    """Roots of ``grp -> to`` pointers whose only cycles are mutual pairs, by pointer jumping."""
    back = pointers.select(F.col("grp").alias("to"), F.col("to").alias("back"))
    mutual = (F.col("back") == F.col("grp")) & (F.col("grp") < F.col("to"))
    current = pointers.join(back, "to", "left").select("grp", F.when(mutual, F.col("grp")).otherwise(F.col("to")).alias("to"))
    while True:
        current = cut(current)
        # two jumps a round: paths shorten to a third
        second = current.select(F.col("grp").alias("to"), F.col("to").alias("next"))
        third = current.select(F.col("grp").alias("next"), F.col("to").alias("last"))
        jumped = cut(
            current.join(second, "to", "left").withColumn("next", F.coalesce("next", "to"))
            .join(third, "next", "left").select("grp", F.coalesce("last", "next").alias("root"), F.col("to").alias("was"))
        )
        if jumped.filter(F.col("root") != F.col("was")).isEmpty():
            return jumped.select("grp", "root")
        current = jumped.select("grp", F.col("root").alias("to"))


def spanning_tree(points: DataFrame, near: DataFrame, grid: Grid) -> DataFrame:
    """Edges (a, b, w) of a minimum spanning tree of mutual reachability.

    ``points``: id, v, core. ``near``: some pairs (id, bid, value), of which those that leave a
    component bound its best edge. Equal weights are ordered by the ids of their ends,
    so the tree is unique. The nearest foreign point of a point stays so until its
    component takes it in, and the next one is no nearer: a round only searches for points
    that lost theirs and could still beat the best edge known to their component, and no
    farther than that edge.
    """
    tree = points.sparkSession.createDataFrame([], "a string, b string, w double")
    want = Want(metric="reach", other_group=True)
    grid = replace(grid, rows=cut(grid.rows.join(points.select("id", "core"), "id")))
    component = points.select("id", F.col("id").alias("grp"))
    # the nearest foreign point known (bid, its component ``to``), or a bound from below without one
    known = points.select("id", F.lit(None).cast("string").alias("bid"), F.lit(0.0).alias("value"))
    first = near.groupBy("id").agg(F.min("value").alias("ub"))
    asks = points.select("id", "v", "core", F.col("id").alias("grp")).join(first, "id", "left").fillna(float("inf"), "ub")
    while True:
        labelled = grid.relabelled(component)
        found = neighbours(asks, labelled, want)
        bounds = asks.select("id", "ub")
        # beyond the bound not every block was visited, so what was found there need not be the nearest
        answers = bounds.join(found.select(F.col("qid").alias("id"), "bid", "value"), "id", "left").select(
            "id", F.when(F.col("value") <= F.col("ub"), F.col("bid")).alias("bid"), F.least("value", "ub").alias("value")
        )
        known = cut(known.join(asks.select("id"), "id", "left_anti").unionByName(answers))
        ends = (
            known.filter("bid is not null").join(component, "id")
            .join(component.select(F.col("id").alias("bid"), F.col("grp").alias("to")), "bid").filter("grp <> to")
        )
        edge = F.struct("value", F.least("id", "bid").alias("a"), F.greatest("id", "bid").alias("b"), "to")
        best = cut(ends.groupBy("grp").agg(F.min(edge).alias("e")))
        tree = cut(tree.unionByName(best.select("e.a", "e.b", F.col("e.value").alias("w")).distinct()))
        roots = contract(best.select("grp", "e.to"))
        component = cut(component.join(roots, "grp").select("id", F.col("root").alias("grp")))
        if component.select("grp").distinct().limit(2).count() < 2:
            return tree
        to = component.select(F.col("id").alias("bid"), F.col("grp").alias("to"))
        state = known.join(component, "id").join(to, "bid", "left").withColumn("valid", F.coalesce(F.col("grp") != F.col("to"), F.lit(False)))
        near = cut(near.join(component, "id").join(to, "bid").filter("grp <> to").select("id", "bid", "value", "grp"))
        ub = state.filter("valid").select("grp", "value").unionByName(near.select("grp", "value")).groupBy("grp").agg(F.min("value").alias("ub"))
        near = near.drop("grp")
        stale = state.filter("not valid").join(ub, "grp", "left").withColumn("ub", F.coalesce("ub", F.lit(float("inf"))))
        asks = cut(stale.filter("value <= ub").select("id", "grp", "ub").join(points.select("id", "v", "core"), "id"))
        # a lost point leaves its distance as a bound from below
        known = state.select("id", F.when(F.col("valid"), F.col("bid")).alias("bid"), "value")


def connected(edges: DataFrame) -> DataFrame:
    """Component (``grp``) of every node (``node``) of a forest of edges (a, b, w)."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = cut(nodes.select("node", F.col("node").alias("grp")))
    links = edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"))
    while True:
        both = links.select("x", F.col("y").alias("to"), "w", "a", "b").unionByName(
            links.select(F.col("y").alias("x"), F.col("x").alias("to"), "w", "a", "b")
        )
        best = both.groupBy("x").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
        roots = contract(cut(best.select(F.col("x").alias("grp"), "e.to")))
        groups = cut(
            groups.join(roots, "grp", "left").select("node", F.coalesce("root", "grp").alias("grp"))
        )
        links = cut(
            links.join(roots.select(F.col("grp").alias("x"), F.col("root").alias("rx")), "x")
            .join(roots.select(F.col("grp").alias("y"), F.col("root").alias("ry")), "y")
            .filter(F.col("rx") != F.col("ry"))
            .select("a", "b", "w", F.col("rx").alias("x"), F.col("ry").alias("y"))
        )
        if not links.limit(1).count():
            return groups


_NODE = "comp string, size bigint, cluster string, mass double, held bigint, kids double, opened double"
_EVENT = (
    "kind string, name string, target string, lambda double, size bigint, cluster string, "
    "mass double, held bigint, kids double, opened double, keep boolean"
)


def _event(kind: str, name: str, target=None, lam=np.nan, node: dict | None = None, keep=None) -> dict:
    node = node or {}
    return {
        "kind": kind, "name": name, "target": target, "lambda": lam, "size": node.get("size"),
        "cluster": node.get("cluster"), "mass": node.get("mass"), "held": node.get("held"),
        "kids": node.get("kids"), "opened": node.get("opened"), "keep": keep,
    }


def _close(node: dict, parent: str | None, birth: float) -> tuple[dict, float]:
    """The event of a closing cluster and the best total of its subtree."""
    own = node["mass"] - birth * node["held"]
    keep = own >= node["kids"]
    return _event("close", node["cluster"], parent, birth, node, keep), own if keep else node["kids"]


def _merge(children: list[dict], weight: float, min_size: int, events: list[dict]) -> dict:
    """Join components at a distance; the rules of the condensed tree."""
    lam = 1.0 / max(weight, FLOOR)
    name = min(c["comp"] for c in children)
    big = [c for c in children if c["cluster"] is not None]
    small = [c for c in children if c["cluster"] is None]
    total = sum(c["size"] for c in children)
    joined = {"comp": name, "size": total, "cluster": None, "mass": 0.0, "held": 0, "kids": 0.0, "opened": np.nan, "parts": []}
    if len(big) == 1:
        joined.update({k: big[0][k] for k in ("cluster", "mass", "held", "kids", "opened")})
    elif len(big) > 1 or total >= min_size:
        joined.update(cluster=f"{name}@{float(weight)!r}", opened=lam)
    if joined["cluster"] is None:
        joined["parts"] = [part for c in small for part in c["parts"]]
        return joined
    if len(big) > 1:
        for child in big:
            event, best = _close(child, joined["cluster"], lam)
            events.append(event)
            joined["kids"] += best
            joined["mass"] += lam * child["size"]
            joined["held"] += child["size"]
    for child in small:
        events += [_event("join", part, joined["cluster"], lam) for part in child["parts"]]
        joined["mass"] += lam * child["size"]
        joined["held"] += child["size"]
    return joined


def _merge_group(nodes: pd.DataFrame, edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """Merge one component of a band along its edges, equal weights at once."""
    state = {}
    for node in nodes.drop(columns="gn").to_dict("records"):
        node["cluster"] = node["cluster"] if isinstance(node["cluster"], str) else None
        state[node["comp"]] = {**node, "parts": [node["comp"]] if node["cluster"] is None else []}
    parent = {name: name for name in state}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    events: list[dict] = []
    rows = edges.sort_values("w", kind="stable")
    for weight, tied in rows.groupby("w", sort=True):
        touched = {find(x) for x in [*tied["x"], *tied["y"]]}
        for x, y in zip(tied["x"], tied["y"]):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        sets: dict[str, list[dict]] = {}
        for old in sorted(touched):
            sets.setdefault(find(old), []).append(state.pop(old))
        for root, children in sets.items():
            state[root] = (
                _merge(children, weight, min_size, events) if len(children) > 1 else children[0]
            )
    for root, node in state.items():
        events.append(_event("node", root, None, np.nan, node))
    for name in parent:
        events.append(_event("map", name, find(name)))
    return pd.DataFrame(events).astype({"size": "Int64", "held": "Int64"})


def _hierarchy(points: DataFrame, tree: DataFrame, min_size: int, band: int) -> tuple[DataFrame, DataFrame]:
    """Cluster table (cluster, parent, keep, opened) and points (point, cluster, lambda)."""
    lam = F.lit(1.0) / F.greatest("core", F.lit(FLOOR))
    alone = F.col("copies") >= min_size  # enough copies are a cluster by themselves
    nodes = points.select(
        F.col("id").alias("comp"), F.col("copies").alias("size"),
        F.when(alone, F.concat("id", F.lit("@copies"))).alias("cluster"),
        F.when(alone, lam * F.col("copies")).otherwise(0.0).alias("mass"),
        F.when(alone, F.col("copies")).otherwise(F.lit(0)).cast("bigint").alias("held"),
        F.lit(0.0).alias("kids"), F.when(alone, lam).otherwise(F.lit(float("nan"))).alias("opened"),
    )
    placed = points.filter(alone).select(
        F.col("id").alias("point"), F.concat("id", F.lit("@copies")).alias("cluster"), lam.alias("lambda")
    )
    waiting = points.filter(~alone).select(F.col("id").alias("point"), F.col("id").alias("comp"))
    closed = None
    links = tree.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"))

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _merge_group(left, right, min_size)

    left_over = links.count()
    while left_over:
        current, groups, high = _next_band(links, left_over, band)
        tagged_nodes = nodes.join(groups.select(F.col("node").alias("comp"), F.col("g").alias("gn")), "comp")
        tagged_edges = current.join(groups.select(F.col("node").alias("x"), F.col("g").alias("ge")), "x")
        pairs = tagged_nodes.groupBy("gn").cogroup(tagged_edges.select("ge", "x", "y", "w").groupBy("ge"))
        events = cut(pairs.applyInPandas(step, _EVENT))

        def of(kind: str) -> DataFrame:
            return events.filter(F.col("kind") == kind)

        renamed = of("map").select(F.col("name").alias("comp"), F.col("target").alias("to"))
        merged = of("node").select(
            F.col("name").alias("comp"), "size", "cluster", "mass", "held", "kids", "opened"
        )
        closing = of("close").select(
            F.col("name").alias("cluster"), F.col("target").alias("parent"), "keep", "opened"
        )
        joins = of("join").select(F.col("name").alias("comp"), F.col("target").alias("cluster"), "lambda")
        closed = closing if closed is None else closed.unionByName(closing)
        placed = placed.unionByName(waiting.join(joins, "comp").select("point", "cluster", "lambda"))
        still = waiting.join(joins.select("comp"), "comp", "left_anti")
        links = links.filter(F.col("w") > high)
        left_over = links.count() if np.isfinite(high) else 0
        if left_over:
            placed, closed = cut(placed), cut(closed)
            waiting = cut(
                still.join(renamed, "comp", "left").select("point", F.coalesce("to", "comp").alias("comp"))
            )
            nodes = cut(nodes.join(renamed.select("comp"), "comp", "left_anti").unionByName(merged))
            for side in ("x", "y"):
                moved = renamed.select(F.col("comp").alias(side), "to")
                links = links.join(moved, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
            links = cut(links.select("a", "b", "w", "x", "y"))
        else:
            nodes = merged
    root = nodes.select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("keep"), "opened")
    closed = root if closed is None else closed.unionByName(root)
    return cut(closed.filter(F.col("cluster").isNotNull())), cut(placed)


def _next_band(links: DataFrame, n: int, band: int) -> tuple[DataFrame, DataFrame, float]:
    """The lightest edges whose components are small, their groups, and the top weight."""
    if n <= band:
        nodes = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        return links, nodes.withColumn("g", F.lit("all")), float("inf")
    low, high = links.agg(F.min("w"), F.max("w")).first()
    current = links
    while True:
        middle = current.approxQuantile("w", [0.5], 0.01)[0]
        high = middle if middle < high else low
        current = links.filter(F.col("w") <= high)
        groups = connected(current.select(F.col("x").alias("a"), F.col("y").alias("b"), "w")).withColumnRenamed("grp", "g")
        largest = (
            current.join(groups, F.col("x") == F.col("node")).groupBy("g").count().agg(F.max("count")).first()[0]
        )
        if largest <= band or high == low:
            return current, groups, high


def _topmost_kept(clusters: DataFrame) -> DataFrame:
    """Each cluster with its highest kept ancestor (or itself): cluster, chosen, opened."""
    # the root is never kept, so paths end below it
    root = clusters.filter(F.col("parent").isNull()).select(F.col("cluster").alias("parent"), F.lit(True).alias("at_root"))
    current = cut(
        clusters.filter(F.col("parent").isNotNull()).join(root, "parent", "left").select(
            "cluster", F.when(F.col("at_root").isNull(), F.col("parent")).alias("up"),
            F.when(F.col("keep"), F.col("cluster")).alias("chosen"),
        )
    )
    while current.filter(F.col("up").isNotNull()).limit(1).count():
        above = current.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        current = cut(
            current.join(above, "up", "left")
            .select("cluster", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen"))
        )
    return current.select("cluster", "chosen")


def density_cluster(
    rows: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, band: int = BAND
) -> DataFrame:
    """Cluster id (-1 is noise) and membership strength of each row (id, v).

    Clusters are numbered from 0 by their smallest member id.
    """
    keyed = cut(_fold_copies(rows))
    n = keyed.count()
    if n < min_cluster_size:
        raise ValueError(f"{n} rows are fewer than min_cluster_size={min_cluster_size}")
    neighbours_wanted = max(1, min(n - 1, min_samples or min_cluster_size))
    folded = cut(
        keyed.groupBy("point").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumnRenamed("point", "id")
    )
    grid = build_grid(folded.select("id", "v"), k=neighbours_wanted + 1 - COUNT_SELF)
    points, near = core_distances(folded, grid, neighbours_wanted)
    points = cut(points)
    tree = spanning_tree(points, near, grid)
    clusters, placed = _hierarchy(points, tree, min_cluster_size, band)
    chosen = _topmost_kept(clusters).filter(F.col("chosen").isNotNull())
    strength = clusters.select(F.col("cluster").alias("chosen"), F.col("opened").alias("top"))
    member = cut(
        placed.join(chosen, "cluster").join(strength, "chosen")
        .join(points.select(F.col("id").alias("point"), "first_id"), "point")
        .select("point", "first_id", "chosen", (F.least("lambda", "top") / F.col("top")).alias("probability"))
    )
    firsts = member.groupBy("chosen").agg(F.min("first_id").alias("first_id"))
    numbers = number_rows(firsts, ["first_id"], "number").select("chosen", (F.col("number") - 1).cast("int").alias("cluster_id"))
    labelled = member.join(numbers, "chosen").select("point", "cluster_id", "probability")
    return keyed.select("id", "point").join(labelled, "point", "left").select(
        "id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
