"""Weighted acyclic automata over words: count transducers of n-grams of one length.

The arcs of an automaton lie in layers, one for each place of the n-gram; the arcs of a
state are adjacent and in the order of their words, and the arcs of the last layer carry
the counts. Built from sorted n-grams, where an arc begins wherever a prefix differs from
that of the n-gram before; states with equal arcs are then shared from the last layer up.
All steps are numpy over whole layers. A word may hold any character but the space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from tracesieve.llm.textarrays import mix

_TEXT = pa.large_string()


@dataclass
class Automaton:
    words: pa.Array  # the alphabet in byte order
    symbol: list[np.ndarray]  # word of each arc, by layer
    first: list[np.ndarray]  # arcs of state s of a layer: first[s] to first[s + 1]
    target: list[np.ndarray]  # state of the next layer, for all layers but the last
    weight: np.ndarray  # of the arcs of the last layer

    @property
    def depth(self) -> int:
        return len(self.symbol)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, as a matrix of word numbers, and their counts."""
        arcs = np.arange(len(self.symbol[0]))
        columns = [self.symbol[0]]
        for layer in range(1, self.depth):
            parent, arcs = arcs_of(self.first[layer], self.target[layer - 1][arcs])
            columns = [c[parent] for c in columns] + [self.symbol[layer][arcs]]
        return np.stack(columns, 1), self.weight[arcs]

    def to_bytes(self) -> bytes:
        layers = [np.diff(np.concatenate([[0], a])).astype(np.int64) for a in (*self.symbol, *self.first, *self.target)]
        arrays = [*layers, self.weight.astype(np.int64)]
        # Small differences in byte planes: the upper planes are nearly all zero.
        planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
        text = pc.binary_join(pa.LargeListArray.from_arrays([0, len(self.words)], self.words), pa.scalar(" ", _TEXT))[0].as_buffer().to_pybytes()
        head = np.array([self.depth, len(text), *map(len, arrays)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + text + b"".join(planes))


def from_bytes(data: bytes) -> Automaton:
    raw = zstandard.ZstdDecompressor().decompress(data)
    depth, size = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    lengths = np.frombuffer(raw, np.int64, 3 * depth, 16)
    at = 16 + 24 * depth
    words = pc.list_flatten(pc.split_pattern(pa.array([raw[at : at + size]], pa.large_binary()).cast(_TEXT), " "))
    at, arrays = at + size, []
    for n in lengths:
        arrays.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, -1).T).view(np.int64).ravel())
        at += 8 * int(n)
    layers = [np.cumsum(a) for a in arrays[:-1]]
    return Automaton(words, layers[:depth], layers[depth : 2 * depth], layers[2 * depth :], arrays[-1])


def arcs_of(first: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the arcs of each of ``states``: its place in ``states``, and the arc."""
    sizes = first[states + 1] - first[states]
    parent = np.repeat(np.arange(len(states)), sizes)
    ends = np.cumsum(sizes)
    return parent, np.arange(len(parent)) - np.repeat(ends - sizes, sizes) + first[states][parent]


def summed(ids: np.ndarray, weight: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order with the sums of their weights."""
    bits = max(1, int(n_words).bit_length())
    if bits * ids.shape[1] <= 63:
        key = np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            key = (key << bits) | ids[:, k]
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort(ids.T[::-1])
        new = np.ones(len(ids), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]).any(1)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(weight[order], starts) if len(starts) else weight[:0]
    return ids[order[starts]], sums


def _shared(first: np.ndarray, symbol: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every state the first state with the same arcs (symbols and values)."""
    place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    arc = mix(symbol.view(np.uint64) ^ mix(value.view(np.uint64) ^ mix(place.view(np.uint64) + np.uint64(1))))
    _, found, inverse = np.unique(np.add.reduceat(arc, first[:-1]), return_index=True, return_inverse=True)
    leader = found[inverse]
    alike = np.diff(first) == np.diff(first)[leader]
    parent, arcs = arcs_of(first, np.flatnonzero(alike))
    mates = first[leader[np.flatnonzero(alike)]][parent] + place[arcs]
    wrong = (symbol[arcs] != symbol[mates]) | (value[arcs] != value[mates])
    alike[np.flatnonzero(alike)[parent[wrong]]] = False  # equal hashes of different states
    return np.where(alike, leader, np.arange(len(leader)))


def build(words: pa.Array, ids: np.ndarray, weight: np.ndarray) -> Automaton:
    """The automaton of distinct sorted n-grams; the alphabet is cut to the words in use."""
    used = np.zeros(len(words), bool)
    used[ids.ravel()] = True
    words, ids = words.take(pa.array(np.flatnonzero(used))), (np.cumsum(used) - 1)[ids]
    depth = ids.shape[1]
    differs = np.ones(ids.shape, bool)
    differs[1:] = ids[1:] != ids[:-1]
    begins = np.logical_or.accumulate(differs, axis=1)
    rows = [np.flatnonzero(begins[:, k]) for k in range(depth)]  # first n-gram of each arc
    symbol = [ids[rows[k], k] for k in range(depth)]
    first = [np.array([0, len(rows[0])])] + [np.append(np.searchsorted(rows[k], rows[k - 1]), len(rows[k])) for k in range(1, depth)]
    target, value = [], weight.astype(np.int64)
    for k in range(depth - 1, 0, -1):
        leader = _shared(first[k], symbol[k], value)
        kept, target_state = np.unique(leader, return_inverse=True)
        _, arcs = arcs_of(first[k], kept)
        first[k] = np.concatenate([[0], np.cumsum(np.diff(first[k])[kept])])
        symbol[k] = symbol[k][arcs]
        if k == depth - 1:
            weight = value[arcs]
        else:
            target[0] = target[0][arcs]
        target.insert(0, target_state.astype(np.int64))
        value = target[0]
    return Automaton(words, symbol, first, target, weight.astype(np.int64))


def union(automata: list[Automaton]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Alphabet, sorted n-grams and summed counts of all automata together."""
    words = pc.unique(pa.chunked_array([a.words for a in automata], _TEXT))
    words = words.take(pc.sort_indices(words))
    ids, weights = [], []
    for a in automata:
        own, weight = a.paths()
        ids.append(number(words, a.words)[own])
        weights.append(weight)
    return words, *summed(np.concatenate(ids), np.concatenate(weights), len(words))


def joined(words: pa.Array, ids: np.ndarray) -> pa.Array:
    """The n-grams as text, words joined by spaces."""
    parts = [words.take(pa.array(ids[:, k])) for k in range(ids.shape[1])]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", _TEXT))


def number(words: pa.Array, of: pa.Array) -> np.ndarray:
    """The place in ``words`` of each of ``of``, -1 if it is none of them."""
    return pc.fill_null(pc.index_in(of, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def compose(wanted: Automaton, counts: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that both accept (numbers in ``wanted.words``) with the weights of ``counts``.

    Pairs of states are walked layer by layer: an arc of ``wanted`` goes on where the state
    of ``counts`` beside it has an arc of the same word.
    """
    names = number(counts.words, wanted.words)
    mine, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    columns: list[np.ndarray] = []
    for layer in range(wanted.depth):
        parent, arcs = arcs_of(wanted.first[layer], mine)
        states = np.repeat(np.arange(len(counts.first[layer]) - 1), np.diff(counts.first[layer]))
        keys = states * len(counts.words) + counts.symbol[layer]
        named = names[wanted.symbol[layer][arcs]]
        sought = other[parent] * len(counts.words) + named
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        met = (named >= 0) & (keys[at] == sought)
        columns = [c[parent[met]] for c in columns] + [wanted.symbol[layer][arcs[met]]]
        if layer + 1 < wanted.depth:
            mine, other = wanted.target[layer][arcs[met]], counts.target[layer][at[met]]
    return np.stack(columns, 1), counts.weight[at[met]]


def range_bounds(words: pa.Array, ids: np.ndarray, keys: list[list[str]]) -> np.ndarray:
    """For sorted n-grams and sorted ``keys`` (word lists): how many n-grams lie below each key."""
    names = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    out = []
    for key in keys:
        low, high = 0, len(ids)
        for k, word in enumerate(key):
            at = int(np.searchsorted(names, word.encode()))
            column = ids[low:high, k]
            begin = low + int(np.searchsorted(column, at))
            if at == len(names) or names[at] != word.encode():
                low = high = begin
                break
            low, high = begin, low + int(np.searchsorted(column, at, side="right"))
        out.append(low)
    return np.array(out, np.int64)
