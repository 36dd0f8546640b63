"""Alignment of two tokenizers by products of sparse incidence matrices.

A token holds its bytes: with the token-byte incidence matrices A and B of one text, the
row product A·Bᵀ lists for every token of A the tokens of B that it overlaps and by how
many bytes. Neighbouring tokens share a group when one token of the other side overlaps
both, so groups end at the byte offsets where both tokenizers end a token. With the
token-group matrices, G_A·G_Bᵀ lists the pairs that share a group and how often.

Both tokenizers start anew at a single space between two characters that are no white
space, so a text is cut there into units, every distinct unit of a chunk of texts is aligned
once, and the links of a document are the row products of its units. Counts over the corpus
join each chunk's distinct pairs, not its links.

Odd rows: a text that is null, empty or changed by a tokenizer (its token bytes are not
space + text) has no tokens: zeros and an empty digest. Repeated rows count as documents of
their own, ids may be null or repeated, texts are read whole. A text larger than a chunk
is a chunk of its own; rows of a product are made in bounded blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracesieve.llm.common import small_batches
from tracesieve.llm.csr import Csr, from_entries, product, products, spans
from tracesieve.session import cut

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a chunk, entries of a product made at once, units given to a tokenizer at once.
CHUNK_BYTES, PRODUCT_ENTRIES, UNITS = 5_000_000, 1_000_000, 1000
UNIT_BREAK = re.compile(r"(?<=\S) (?=\S)")

CHUNK = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, a array<int>, b array<int>, held array<int>"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies use for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tokenizer A: byte-level; special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        chars = byte_characters()
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.bytes = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.bytes[i] = token.encode() if token in special else bytes(chars[c] for c in token)

    def encode(self, units: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(units), UNITS):
            out += [e.ids for e in self.model.encode_batch_fast([" " + u for u in units[at : at + UNITS]], add_special_tokens=False)]
        return out


class PieceBpe:
    """Tokenizer B: it adds the space itself, writes it as U+2581 and falls back to bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes = [
            bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
            for i in range(m.vocab_size())
        ]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(a_path), PieceBpe(b_path)


class Side:
    """Tokens of the units under one tokenizer: ``ids`` end to end, ``start`` of each unit, bytes of each token."""

    def __init__(self, tokenizer, units: list[str]):
        lists = tokenizer.encode(units)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64, self.start[-1])
        self.unit = np.repeat(np.arange(len(units)), sizes)
        self.lengths = np.fromiter(map(len, tokenizer.bytes), np.int64, len(tokenizer.bytes))[self.ids]
        joined = b"".join([tokenizer.bytes[i] for i in chain.from_iterable(lists)])
        ends = np.concatenate([[0], np.cumsum(self.lengths)])[self.start]
        wanted = [b" " + u.encode() for u in units]
        #: Units whose tokens hold exactly the bytes of space + unit.
        self.whole = np.diff(ends) == np.fromiter(map(len, wanted), np.int64, len(units))
        if not (self.whole.all() and joined == b"".join(wanted)):
            self.whole = np.fromiter((joined[ends[i] : ends[i + 1]] == u for i, u in enumerate(wanted)), bool, len(units))

    def only(self, units: np.ndarray) -> None:
        """Drop the tokens of the units that are not marked."""
        kept = units[self.unit]
        sizes = np.diff(self.start) * units
        self.ids, self.unit, self.lengths = self.ids[kept], self.unit[kept], self.lengths[kept]
        self.start = np.concatenate([[0], np.cumsum(sizes)])

    def incidence(self) -> Csr:
        """Tokens x bytes."""
        start = np.concatenate([[0], np.cumsum(self.lengths)])
        return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


class Aligned:
    """Both tokenizations of distinct units, their overlaps, groups and linked id pairs."""

    def __init__(self, units: list[str], a_path: str, b_path: str):
        first, second = tokenizers(a_path, b_path)
        self.a, self.b = Side(first, units), Side(second, units)
        self.whole = self.a.whole & self.b.whole
        self.a.only(self.whole)
        self.b.only(self.whole)
        a, b, n = self.a, self.b, len(units)
        held = b.incidence()
        by_byte = Csr(np.arange(held.width + 1), held.row_of(), held.value, held.rows)  # the transpose: one token a byte
        self.overlap = product(a.incidence(), by_byte)
        o = self.overlap
        # A group ends between two tokens of A when no token of B reaches into both.
        parts = np.ones(len(a.ids), bool)
        if len(a.ids):
            parts[1:] = o.column[o.start[1:-1]] != o.column[o.start[1:-1] - 1]
        self.a_group = np.cumsum(parts) - 1
        self.n_groups = int(parts.sum())
        self.b_group = np.empty(len(b.ids), np.int64)
        self.b_group[o.column] = self.a_group[o.row_of()]
        self.groups = np.bincount(a.unit[parts], minlength=n)
        # Linked pairs of ids: rows (unit, A id) x groups times groups x B ids.
        row_key = a.unit * len(first.bytes) + a.ids
        rows, place = np.unique(row_key, return_inverse=True)
        by_group = from_entries(place, self.a_group, np.ones(len(place), np.int64), len(rows), self.n_groups)
        of_group = from_entries(self.b_group, b.ids, np.ones(len(b.ids), np.int64), self.n_groups, len(second.bytes))
        unit, pair, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, linked in products(by_group, of_group, PRODUCT_ENTRIES):
            key = rows[low + linked.row_of()]
            unit.append(key // len(first.bytes))
            pair.append(key % len(first.bytes) * len(second.bytes) + linked.column)
            times.append(linked.value)
        #: Distinct (A id, B id) as one number, and units x pairs with the number of links.
        self.pairs, number = np.unique(np.concatenate(pair), return_inverse=True)
        self.links = from_entries(np.concatenate(unit), number, np.concatenate(times), n, len(self.pairs))

    def spelled(self) -> pa.Array:
        """The groups of each unit as text: ``a1,a2|b1;a3|b2,b3``."""
        group = np.concatenate([self.a_group, self.b_group])
        ids = np.concatenate([self.a.ids, self.b.ids])
        side = np.repeat([0, 1], [len(self.a.ids), len(self.b.ids)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        group, ids, side = group[order], ids[order], side[order]
        unit = np.concatenate([self.a.unit, self.b.unit])[order]
        opens = np.diff(group, prepend=-1) != 0
        mark = np.where(opens, np.where(np.diff(unit, prepend=-1) != 0, 0, 1), np.where(np.diff(side, prepend=0) != 0, 2, 3))
        width = int(ids.max()) + 1 if len(ids) else 1
        used, place = np.unique(mark * width + ids, return_inverse=True)
        words = pa.array([("", ";", "|", ",")[k // width] + str(k % width) for k in used.tolist()], pa.large_string())
        start = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(self.whole)))])
        return pc.binary_join(pa.LargeListArray.from_arrays(start, words.take(pa.array(place))), pa.scalar("", pa.large_string()))


def packed(columns: np.ndarray, times: np.ndarray) -> bytes:
    """One document's pairs (ascending numbers) and how often each is linked."""
    both = np.concatenate([np.diff(columns, prepend=0), times]).astype(np.int32)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _units(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the unit numbers of all texts end to end, and where each text starts."""
    parts = [UNIT_BREAK.split(text) if text else [] for text in texts]
    coded = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
    start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), start


def align_chunk(ids: list, texts: list[str | None], chunk: int, a_path: str, b_path: str) -> pa.RecordBatch:
    """One row for each text and a last one with the chunk's distinct pairs and the number of texts that hold each."""
    units, number, start = _units(texts)
    al = Aligned(units, a_path, b_path)
    n = len(texts)
    bad = np.concatenate([[0], np.cumsum(~al.whole[number])])
    good = (np.diff(start) > 0) & (bad[start[1:]] == bad[start[:-1]])

    def per_text(of_unit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_unit[number])])
        return (sums[start[1:]] - sums[start[:-1]]) * good

    spelled = pa.LargeListArray.from_arrays(start, al.spelled().take(pa.array(number)))
    digests = [
        hashlib.sha256(text.as_buffer()).hexdigest() if fine else ""
        for text, fine in zip(pc.binary_join(spelled, pa.scalar(";", pa.large_string())), good.tolist(), strict=True)
    ]
    sizes = np.diff(start) * good
    kept = spans(start[:-1], sizes)
    occurrences = Csr(np.concatenate([[0], np.cumsum(sizes)]), number[kept], np.ones(len(kept), np.int64), len(units))
    held, links = np.zeros(len(al.pairs), np.int64), []
    for _, linked in products(occurrences, al.links, PRODUCT_ENTRIES):
        held += np.bincount(linked.column, minlength=len(held))
        bounds = linked.start.tolist()
        links += [packed(linked.column[x:y], linked.value[x:y]) if y > x else None for x, y in zip(bounds, bounds[1:])]
    used = np.flatnonzero(held)  # pairs of texts that count; the others are asked for by nobody
    place = np.cumsum(held > 0) - 1
    if len(used) < len(held):
        links = [None if x is None else packed(place[unpacked(x)[0]], unpacked(x)[1]) for x in links]
    width = len(tokenizers(a_path, b_path)[1].bytes)
    numbers = [per_text(np.diff(al.a.start)), per_text(np.diff(al.b.start)), per_text(al.groups), per_text(al.links.row_sums())]
    lists = [[None] * n + [x.astype(np.int32)] for x in (al.pairs[used] // width, al.pairs[used] % width, held[used])]
    columns = [[chunk] * (n + 1), [*ids, None], *[pa.array([*x.tolist(), None], pa.int64()) for x in numbers], [*digests, None], [*links, None], *lists]
    kinds = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 3]
    names = [f.split()[0] for f in CHUNK.split(", ")]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _chunks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size + len(text or "") > CHUNK_BYTES and texts:
                    yield align_chunk(ids, texts, chunk, a_path, b_path)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield align_chunk(ids, texts, chunk, a_path, b_path)

    return run


def _weigh(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk, from the counts of the chunk's pairs."""
    place = counts.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = counts.column("count").to_numpy()
    best[place] = counts.column("best").to_numpy()
    n_best, count_sum = [], []
    for data in documents.column("links"):
        if not data.is_valid:
            n_best.append(0)
            count_sum.append(0)
            continue
        columns, times = unpacked(data.as_py())
        n_best.append(int(times @ best[columns]))
        count_sum.append(int(times @ count[columns]))
    out = documents.drop_columns(["chunk", "links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.select([f.split()[0] for f in DOCUMENT.split(", ")])


def aligned_documents(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """One row for each document: tokens, groups, links, and their weights by corpus-wide counts of id pairs.

    ``count`` of a pair: documents that hold it linked. ``n_best``: links whose count is the
    highest of their A id. The text is tokenized once; links wait packed in the shared folder.
    """
    small_batches(docs.sparkSession)
    chunks = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(a_path, b_path), CHUNK))
    asked = chunks.where("a is not null").select("chunk", F.posexplode(F.arrays_zip("a", "b", "held"))).select("chunk", F.col("pos").alias("place"), "col.*")
    counts = cut(asked.groupBy("a", "b").agg(F.sum("held").alias("count")))
    # One row for each id of A: bounded by the vocabulary.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    marked = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    answers = asked.select("chunk", "place", "a", "b").join(marked, ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best")
    documents = chunks.where("a is null").drop("a", "b", "held")
    return documents.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_weigh, DOCUMENT)


TOKENS = "array<struct<id:int,start:int,end:int,grp:int>>"
OVERLAPS = "array<struct<a:int,b:int,bytes:int>>"


def overlap_links(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """(doc_id, a, b, overlaps): tokens with their byte spans and groups, and all overlapping pairs of places."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _one(i, text, a_path, b_path)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, a {TOKENS}, b {TOKENS}, overlaps {OVERLAPS}")


def _one(doc_id: int | None, text: str | None, a_path: str, b_path: str) -> pa.RecordBatch:
    al = Aligned([text] if text else [], a_path, b_path)  # the text as one unit
    sides = []
    for side, group in ((al.a, al.a_group), (al.b, al.b_group)):
        ends = np.cumsum(side.lengths)
        fields = [x.astype(np.int32) for x in (side.ids, ends - side.lengths, ends, group)]
        sides.append(pa.StructArray.from_arrays([pa.array(x) for x in fields], ["id", "start", "end", "grp"]))
    o = al.overlap
    found = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (o.row_of(), o.column, o.value)], ["a", "b", "bytes"])
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*sides, found)]
    return pa.record_batch([pa.array([doc_id], pa.int64()), *lists], ["doc_id", "a", "b", "overlaps"])
