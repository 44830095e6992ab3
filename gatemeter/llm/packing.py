"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2``, as attention stays inside
its document. Documents are read in windows of a bounded number of tokens. In a window,
whole multiples of the sequence length leave a document as full sequences of their own;
what is left (a tail shorter than a sequence) goes, longest first, to the sequence of the
lowest cost among those with enough tokens free. A window opens just as many sequences as
its tails need, so when no sequence can hold a tail whole, the tail is cut to fill the
roomiest ones; a window wastes less than one sequence in all.

Windows lie inside the input's partitions: nothing is shuffled, a task holds one window
(and the ids of one document) at a time, and a lost task makes the same rows again.
Sequence ids hold the partition in their upper half.

Defined results: a null text counts as empty and gives one piece with the end id; repeated
rows are packed each on its own; ties in length go by document order; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gatemeter.llm.textbatch import filled
from gatemeter.llm.wordbpe import tokenizer, vocabulary


@dataclass(frozen=True)
class PackRules:
    seq_len: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    window_tokens: int = 1 << 21

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


DEFAULT = PackRules()
_FULL = (float("inf"), -1)


class CheapestWithRoom:
    """Sequences by tokens free; finds the cheapest one with at least so many free.

    A heap of (cost, sequence) for each number of free tokens stands at a leaf of a
    segment tree that keeps the least of each range.
    """

    def __init__(self, capacity: int, count: int):
        self.size = 1 << capacity.bit_length()
        self.capacity = capacity
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree = [_FULL] * (2 * self.size)
        self.heaps[capacity] = [(0.0, k) for k in range(count)]
        self._settle(capacity)

    def _settle(self, free: int) -> None:
        heap, tree, i = self.heaps[free], self.tree, self.size + free
        tree[i] = heap[0] if heap else _FULL
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
            i >>= 1

    def cheapest(self, room: int) -> int:
        """Free tokens of the cheapest sequence with `room` or more free; -1 if none has."""
        tree, best, where = self.tree, _FULL, 0
        lo, hi = self.size + room, self.size + self.capacity + 1
        while lo < hi:
            if lo & 1:
                if tree[lo] < best:
                    best, where = tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < best:
                    best, where = tree[hi], hi
            lo >>= 1
            hi >>= 1
        if best is _FULL:
            return -1
        while where < self.size:
            where = 2 * where if tree[2 * where] == best else 2 * where + 1
        return where - self.size

    def roomiest(self) -> int:
        """Most tokens free in any sequence."""
        tree, i = self.tree, 1
        while i < self.size:
            i = 2 * i + 1 if tree[2 * i + 1] is not _FULL else 2 * i
        return i - self.size

    def put(self, free: int, n: int, cost: float) -> int:
        """Put n tokens into the cheapest sequence with exactly `free` free; gives its number."""
        spent, k = heapq.heappop(self.heaps[free])
        self._settle(free)
        heapq.heappush(self.heaps[free - n], (spent + cost, k))
        self._settle(free - n)
        return k


def pack(lengths: list[int], rules: PackRules = DEFAULT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    size, out, tails, used = rules.seq_len, [], [], 0
    for d, n in enumerate(lengths):
        whole = n // size
        out += [(d, k * size, size, used + k, 0) for k in range(whole)]
        used += whole
        if n % size:
            tails.append((n % size, d, whole * size))
    tails.sort(key=lambda t: (-t[0], t[1]))
    bins = CheapestWithRoom(size, -(-sum(t[0] for t in tails) // size))
    for left, d, start in tails:
        while left:
            free = bins.cheapest(left)
            if free < 0:
                free = bins.roomiest()
            n = min(left, free)
            k = bins.put(free, n, rules.cost(n))
            out.append((d, start, n, used + k, size - free))
            left, start = left - n, start + n
    return out


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids with the end id) of each row of (id, text) batches."""
    coder = tokenizer(path)
    end = np.array([end_id], "<u4")
    for batch in batches:
        ids, texts = batch.column(0), filled(batch.column(1))
        for i in range(batch.num_rows):
            yield ids[i].as_py(), np.concatenate([coder.encode(texts[i].as_py()), end])


def windows(rows: Iterator[tuple[object, np.ndarray]], most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    keys: list = []
    held: list[np.ndarray] = []
    total = 0
    for key, ids in rows:
        keys.append(key)
        held.append(ids)
        total += len(ids)
        if total >= most:
            yield keys, held
            keys, held, total = [], [], 0
    if keys:
        yield keys, held


def first_sequence() -> int:
    """The first sequence id of this task: its partition in the upper half."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def pack_documents(docs: DataFrame, rules: PackRules = DEFAULT, vocabulary_name: str = "word_bpe_49k.json", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    `path` is the vocabulary file on every executor; without it the installed public file
    of that name is used.
    """
    id_field = docs.schema[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
    schema = f"`{id_col}` {id_field.dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cost double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_field.dataType)
        sequence = first_sequence()
        for keys, held in windows(encoded(batches, path or vocabulary(vocabulary_name), rules.end_id), rules.window_tokens):
            pieces = pack([len(x) for x in held], rules)
            d, start, n, k, offset = (list(x) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(held[a][b : b + c].tobytes()) for a, b, c in zip(d, start, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[a] for a in d], kind), *(pa.array(x, pa.int64()) for x in (start, n, crc, [len(held[a]) for a in d], [sequence + x for x in k], offset)),
                    pa.array([rules.cost(x) for x in n], pa.float64()),
                ],
                names=names,
            )
            sequence += max(k) + 1

    return docs.select(id_col, text_col).mapInArrow(run, schema)
