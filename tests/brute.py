"""Small one-machine versions used as references in tests."""

from __future__ import annotations

import numpy as np


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int) -> list[frozenset[int]]:
    """Selected clusters as sets of row numbers, top-down on the full matrix."""
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    core = np.sort(dist, axis=1)[:, min(min_samples, len(x) - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), dist)

    # Prim on the full matrix
    links, inside = [], np.zeros(len(x), dtype=bool)
    inside[0], best, start = True, reach[0].copy(), np.zeros(len(x), dtype=int)
    for _ in range(len(x) - 1):
        p = int(np.argmin(np.where(inside, np.inf, best)))
        links.append((best[p], p, int(start[p])))
        inside[p] = True
        closer = reach[p] < best
        best[closer], start[closer] = reach[p][closer], p

    def split(points: list[int]) -> tuple[float, list[list[int]]]:
        """The weight at which the set falls apart and its parts below it."""
        known = set(points)
        own = [link for link in links if link[1] in known and link[2] in known]
        top = max(w for w, _, _ in own)
        root = {p: p for p in points}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for w, a, b in own:
            if w < top:
                root[find(a)] = find(b)
        parts: dict[int, list[int]] = {}
        for p in points:
            parts.setdefault(find(p), []).append(p)
        return top, list(parts.values())

    def grow(points: list[int], birth: float) -> tuple[float, list[frozenset[int]]]:
        """Best stability and selected clusters at or below a cluster."""
        everyone, own, current = frozenset(points), 0.0, points
        while True:
            if len(current) < 2:
                return own, [everyone]
            weight, parts = split(current)
            lam = 1 / max(weight, 1e-9)
            big = [p for p in parts if len(p) >= min_cluster_size]
            if len(big) == 1:
                own += (lam - birth) * (len(current) - len(big[0]))
                current = big[0]
                continue
            own += (lam - birth) * len(current)
            if not big:
                return own, [everyone]
            below = [grow(p, lam) for p in big]
            kids = sum(s for s, _ in below)
            if own >= kids:
                return own, [everyone]
            return kids, [c for _, found in below for c in found]

    current = list(range(len(x)))
    while True:
        weight, parts = split(current)
        big = [p for p in parts if len(p) >= min_cluster_size]
        if len(big) == 1:
            current = big[0]
            continue
        if not big:
            return []
        lam = 1 / max(weight, 1e-9)
        return [c for p in big for c in grow(p, lam)[1]]


def farthest(x: np.ndarray, ids: list[str], first: int, n: int) -> list[str]:
    picked = [first]
    near = np.sqrt(((x - x[first]) ** 2).sum(1))
    while len(picked) < n:
        order = sorted((i for i in range(len(ids)) if i not in picked), key=lambda i: (-near[i], ids[i]))
        picked.append(order[0])
        near = np.minimum(near, np.sqrt(((x - x[order[0]]) ** 2).sum(1)))
    return [ids[i] for i in picked]


def greedy_dedup(x: np.ndarray, order: list[int], threshold: float) -> set[int]:
    accepted: list[int] = []
    for i in order:
        if not any(x[i] @ x[j] >= threshold for j in accepted):
            accepted.append(i)
    return set(accepted)
