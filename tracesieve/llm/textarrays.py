"""Whole texts of an Arrow batch as flat numpy arrays of code points, words and lines.

Executors work on slices of about ``SLICE`` code points, so memory follows the
longest single text, not the batch. Words and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    low = (chr(i).lower() for i in range(0x110000))
    return np.fromiter((ord(c) if len(c) == 1 else i for i, c in enumerate(low)), np.uint32, 0x110000)


@lru_cache(maxsize=1)
def upper_table() -> np.ndarray:
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Texts:
    """Texts laid end to end: ``codes`` (code points) and ``bounds`` (n + 1 offsets)."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds, self.n = codes, bounds, len(bounds) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many code points of each text satisfy ``mask``."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of ``inside`` within a text."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.bounds] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the code points of each span (0 for an empty span)."""
        n = max(SLICE, 1 << int(len(self.codes)).bit_length())
        terms = mix(self.codes.astype(np.uint64) + np.uint64(1)) * _powers(n, int(_BASE))[: len(self.codes)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * _powers(n, int(_INVERSE))[np.minimum(starts, n - 1)])


def texts(column: pa.Array) -> Texts:
    """One slice; a null text counts as an empty one."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return Texts(np.zeros(0, np.uint32), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return Texts(codes, heads[ends - ends[0]])


def slices(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive slices ``(from, to, texts)`` of about ``SLICE`` bytes, at least one text each."""
    column = column.cast(pa.large_string()).fill_null("")
    sizes = np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), np.int64)
    done = 0
    while done < len(column):
        total = np.cumsum(sizes[done : done + 4096])
        count = max(1, int(np.searchsorted(total, SLICE, side="right")))
        yield done, done + count, texts(column.slice(done, count))
        done += count


def spaces(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the words ``[^\\x20\\x09-\\x0D]+``."""
    return t.runs(~spaces(t.codes))


def lower_words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of the lower-cased runs of letters."""
    low = Texts(lower_table()[t.codes], t.bounds)
    starts, ends, owner = low.runs(letter_table()[t.codes])
    return low.hashes(starts, ends), owner


def count_repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often its text has it, and whether it is that key's first place."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    own = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(77)))
    _, first, inverse, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """Exact counts for each text; the names are those of the quality rules."""
    starts, ends, owner = words(t)
    n_words = np.bincount(owner, minlength=t.n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": np.bincount(owner, ends - starts, t.n).astype(np.int64)}
    out["n_symbols"] = t.per_text(np.isin(t.codes, np.array([ord(c) for c in "[#*$%&|<>]"[1:-1]], np.uint32)))
    hashed = t.hashes(starts, ends)
    window = hashed.copy()
    repeated = np.zeros(len(hashed) + 1, np.int64)
    if len(hashed) >= 5:
        window = np.zeros(len(hashed) - 4, np.uint64)
        for k in range(5):
            window = mix(window + hashed[k : len(hashed) - 4 + k] * np.uint64(2 * k + 3))
        whole = np.flatnonzero(owner[:-4] == owner[4:])
        counts, _ = count_repeats(window[whole], owner[whole])
        twice = whole[counts >= 2]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 5, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    out["n_repeat_words"] = np.bincount(owner, covered, t.n).astype(np.int64)
    _, first = count_repeats(hashed, owner)
    out["n_distinct_words"] = np.bincount(owner, first, t.n).astype(np.int64)
    line_starts, line_ends, line_owner = t.runs(t.codes != 10)
    ink = np.concatenate([[0], np.cumsum(~spaces(t.codes), dtype=np.int64)])
    filled = ink[line_ends] > ink[line_starts]
    line_starts, line_ends, line_owner = line_starts[filled], line_ends[filled], line_owner[filled]
    _, first = count_repeats(t.hashes(line_starts, line_ends), line_owner)
    out["n_lines"] = np.bincount(line_owner, minlength=t.n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_owner, ~first, t.n).astype(np.int64)
    out["n_chars"] = np.diff(t.bounds)
    out["n_letters"] = t.per_text(letter_table()[t.codes])
    out["n_upper"] = t.per_text(upper_table()[t.codes])
    out["n_digits"] = t.per_text((t.codes >= 48) & (t.codes <= 57))
    out["n_exclaim"] = t.per_text(t.codes == 33)
    out["n_bars"] = t.per_text(t.codes == 124)
    out["n_stops"] = t.per_text((t.codes == 46) | (t.codes == 44))
    return out
