"""Sparse integer matrices in compressed rows, with Gustavson's row product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    start: np.ndarray  # entries of row i: start[i] to start[i + 1]
    column: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def row_of(self) -> np.ndarray:
        """Row of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.start))

    def row_sums(self, value: np.ndarray | None = None) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.value if value is None else value)])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def block(self, low: int, high: int) -> Csr:
        a, b = self.start[low], self.start[high]
        return Csr(self.start[low : high + 1] - a, self.column[a:b], self.value[a:b], self.width)


def from_entries(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, width: int) -> Csr:
    """Entries in any order; equal places are added up."""
    key = row.astype(np.int64) * width + column
    if len(key) and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, value = key[new], np.add.reduceat(value, new) if len(new) else value[:0].astype(np.int64)
    return Csr(np.searchsorted(key, np.arange(rows + 1) * width), key % width if width else key, value, width)


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[i]``, ``first[i] + 1``, ... (``sizes[i]`` numbers) for each i, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def product(a: Csr, b: Csr) -> Csr:
    """Row i of a·b: the rows of b named by the entries of row i of a, weighted and added up."""
    sizes = np.diff(b.start)[a.column]
    at = spans(b.start[a.column], sizes)
    return from_entries(np.repeat(a.row_of(), sizes), b.column[at], np.repeat(a.value, sizes) * b.value[at], a.rows, b.width)


def products(a: Csr, b: Csr, most: int) -> Iterator[tuple[int, Csr]]:
    """(first row, product) for runs of rows of ``a`` that name about ``most`` entries of ``b`` together."""
    load = np.cumsum(a.row_sums(np.diff(b.start)[a.column]))
    low = 0
    while low < a.rows:
        done = load[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(load, done + most, side="right")))
        yield low, product(a.block(low, high), b)
        low = high
