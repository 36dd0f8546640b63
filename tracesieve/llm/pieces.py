"""SentencePiece encoding with seeded merge-dropout, and decoding.

The agenda of a text holds its candidate merges; the best (by piece score, then by
place) is taken until none is left. Each candidate draws one coin, a keyed hash of the
seed, the document and the candidate's start, middle and end; if it falls under the
dropout the merge is skipped for good. A coin depends on nothing but its candidate, so
the agendas of all words of a slice advance together in numpy. No piece of a BPE model
reaches over a space mark that is not at its start, so a text divides at those marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm import textarrays as A
from tracesieve.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20
SPACE = 0x2581
_FAR = np.int32(2**30)


class Pieces:
    """The vocabulary of one model as arrays, built by rule from its file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, model.unk_id())
        self.byte_of = np.full(n, -1)
        normal = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)], self.byte_of[i] = i, int(piece[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[piece] = i
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        order = sorted(normal.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        merges = sorted(
            (normal[p[:k]] * n + normal[p[k:]], rank[i], i)
            for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal
        )
        self.size = n
        self.pair = np.array([m[0] for m in merges], np.int64)
        self.rank = np.array([m[1] for m in merges], np.int32)
        self.result = np.array([m[2] for m in merges], np.int32)
        self.table_bits = 19
        self.slots = self._slots()

    def _slots(self) -> np.ndarray:
        """Open-addressed table: slot of a pair's hash -> its number, -1 if free."""
        mask = (1 << self.table_bits) - 1
        slots = np.full(mask + 1, -1, np.int32)
        todo, step = np.arange(len(self.pair)), 0
        while len(todo):
            at = self._slot(self.pair[todo], step)
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            todo = todo[slots[at] != todo]
            step += 1
        self.steps = step
        return slots

    def _slot(self, pair: np.ndarray, step: int) -> np.ndarray:
        mixed = (pair.astype(np.uint64) + np.uint64(step) * np.uint64(1 << 33)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of each pair of symbols, -1 if there is none (a symbol below 0 has none)."""
        pair = left.astype(np.int64) * self.size + right
        out = self.slots[self._slot(pair, 0)]
        missed = np.flatnonzero((self.pair[out] != pair) & (out >= 0))
        for step in range(1, self.steps):
            if not len(missed):
                break
            found = self.slots[self._slot(pair[missed], step)]
            out[missed] = found
            missed = missed[(self.pair[found] != pair[missed]) & (found >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out


@lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def coins(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) for candidates at places counted from the start of their text."""
    x = start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x += (middle - start).astype(np.uint64) * np.uint64(0xA5CB9243F0AEF5B5)
    x += (end - middle).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47)
    return (A.mix(x ^ key) >> np.uint64(11)) * 2.0**-53


def text_keys(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    return A.mix(ids.astype(np.int64).view(np.uint64) ^ A.mix(np.array([seed], np.uint64))[0])


def marked(t: A.Texts) -> A.Texts:
    """Spaces become marks and each text that is not empty gets one in front; real marks are set aside."""
    codes = np.where(t.codes == SPACE, 0x10FFFF + 1, np.where(t.codes == 32, SPACE, t.codes)).astype(np.uint32)
    filled = np.diff(t.bounds) > 0
    return A.Texts(np.insert(codes, t.bounds[:-1][filled], SPACE), t.bounds + np.concatenate([[0], np.cumsum(filled)]))


def encode(t: A.Texts, keys: np.ndarray, dropout: float = DROPOUT, model: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets of the texts in them.

    Characters that the model lacks, and literal space marks, become byte pieces.
    """
    v, m = pieces(model), marked(t)
    real_mark = m.codes > 0x10FFFF
    symbol = np.where(real_mark, -1, v.char[np.where(real_mark, 0, m.codes)]).astype(np.int32)
    n = len(symbol)
    owner = np.repeat(np.arange(m.n), np.diff(m.bounds))
    place = np.arange(n) - m.bounds[owner]
    first = np.zeros(n, bool)
    first[m.bounds[:-1][np.diff(m.bounds) > 0]] = True
    space = m.codes == SPACE
    first |= space & ~np.concatenate([[False], space[:-1]])
    key = keys[owner]
    size = np.ones(n, np.int32)

    def candidates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merges of the symbols at ``left`` with those at ``right``."""
        number = v.find(symbol[left], symbol[right])
        ok = np.flatnonzero(number >= 0)
        if dropout > 0 and len(ok):
            a, b = left[ok], right[ok]
            number[ok[coins(key[a], place[a], place[b], place[b] + size[b]) < dropout]] = -1
        return np.where(number >= 0, v.rank[number], _FAR), v.result[number]

    # The agenda: symbols that are still there (as places of their first code point), each
    # with the rank and result of its merge with the next one of its word.
    at = np.arange(n)
    rank, result = np.full(n, _FAR, np.int32), np.zeros(n, np.int32)
    pairs = np.flatnonzero(~first[1:]) if n else at
    rank[pairs], result[pairs] = candidates(pairs, pairs + 1)
    lengths = np.diff(np.append(np.flatnonzero(first), n))
    done: list[np.ndarray] = []
    while len(lengths):
        heads = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat(rank, heads)
        busy = best < _FAR
        if not busy.all():
            going = np.repeat(busy, lengths)
            done.append(at[~going])
            at, rank, result = at[going], rank[going], result[going]
            lengths, best = lengths[busy], best[busy]
            if not len(lengths):
                break
            heads = np.cumsum(lengths) - lengths
        hits = np.flatnonzero(rank == np.repeat(best, lengths))
        if len(hits) > len(heads):  # ties: the leftmost
            word = np.searchsorted(heads, hits, side="right")
            hits = hits[np.concatenate([[True], word[1:] != word[:-1]])]
        left, right = at[hits], at[hits + 1]
        symbol[left] = result[hits]
        size[left] += size[right]
        keep = np.ones(len(at), bool)
        keep[hits + 1] = False
        at, rank, result = at[keep], rank[keep], result[keep]
        lengths = lengths - 1
        heads = np.cumsum(lengths) - lengths
        now = hits - np.arange(len(hits))  # each word before has lost a symbol
        last = now == heads + lengths - 1
        rank[now[last]] = _FAR
        again = np.concatenate([now[~last], now[now > heads] - 1])
        rank[again], result[again] = candidates(at[again], at[again + 1])
    kept = np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)
    ids, unknown = symbol[kept], symbol[kept] < 0
    if unknown.any():
        lists = [chr(SPACE if real_mark[p] else m.codes[p]).encode() for p in kept[unknown]]
        spans = np.ones(len(kept), np.int64)
        spans[unknown] = [len(b) for b in lists]
        ids = np.repeat(ids, spans)
        ids[np.repeat(unknown, spans)] = v.byte[np.frombuffer(b"".join(lists), np.uint8)]
        counts = np.bincount(owner[kept], spans, m.n).astype(np.int64)
    else:
        counts = np.bincount(owner[kept], minlength=m.n)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def decode(ids: np.ndarray, bounds: np.ndarray, model: str = MODEL) -> list[str]:
    """The texts of lists of ids laid end to end."""
    v = pieces(model)
    data = _piece_bytes(model)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        whole = b"".join([data[i] for i in ids[lo:hi].tolist()])
        out.append((whole[1:] if hi > lo and v.byte_of[ids[lo]] < 0 and whole[:1] == b" " else whole).decode("utf-8", "replace"))
    return out


@lru_cache(maxsize=2)
def _piece_bytes(model: str) -> list[bytes]:
    v = pieces(model)
    return [bytes([b]) if b >= 0 else p.replace(chr(SPACE), " ").encode() for p, b in zip(v.text, v.byte_of.tolist(), strict=True)]


def encoded(doc_id: Column, text: Column, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> Column:
    """Struct of ``ids`` and ``lossless`` (decoding gives the text back); a null text gives no ids."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for own, column in batches:
            keys = text_keys(own.fill_null(-1).to_numpy(zero_copy_only=False), seed)
            parts, sizes, same = [], [np.zeros(1, np.int64)], []
            for lo, hi, t in A.slices(column):
                ids, bounds = encode(t, keys[lo:hi], dropout, model)
                back = decode(ids, bounds, model)
                same += [b == (x.as_py() or "") for b, x in zip(back, column[lo:hi], strict=True)]
                parts.append(ids)
                sizes.append(np.diff(bounds))
            offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            values = pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, values), pa.array(same, pa.bool_())], names=["ids", "lossless"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(doc_id, text)


@F.arrow_udf(T.StringType())
def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts of lists of ids (of the default model); null stays null."""
    for column in batches:
        lists = [np.array(x.as_py() or [], np.int64) for x in column]
        flat, bounds = np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        yield pa.array([t if x.is_valid else None for t, x in zip(decode(flat, bounds), column, strict=True)], pa.string())


def encode_documents(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) for every row of ``docs``.

    Empty and null texts have no pieces. Rows with the same id and text are segmented
    alike; other rows vary. A null id draws like id -1. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", encoded(F.col("doc_id"), F.col("text"), dropout, seed, model).alias("e"))
    return rows.select("doc_id", F.size("e.ids").cast("long").alias("n_pieces"), "e.lossless", "e.ids")
