"""Best-fit-decreasing packing into id matrices.

Documents are tokenised and read in windows of a bounded number of tokens. Overlong ones
are cut losslessly into full sequences and a tail; the tails go, longest first, into the
sequence with the least free space that still holds them, found by a descent in a segment
tree over the numbers of free tokens; a new sequence is opened when none does.

Each sequence becomes a row: the padded row of the id matrix and the position ids (which
restart at 0 with every segment) as little-endian unsigned 32-bit binary, the cumulative
segment lengths, and for every segment its document and start. ``matrices`` turns rows
back into numpy arrays, ``write_matrices`` stores them as Parquet.

Nothing is shuffled; a task holds one window. Defined results: a null text counts as
empty and packs as the end id alone; repeated rows are packed each on its own; ties go by
document order; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatemeter.llm.packing import encoded, first_sequence, windows
from gatemeter.llm.wordbpe import vocabulary


@dataclass(frozen=True)
class MatrixRules:
    seq_len: int = 2048
    end_id: int = 1
    pad_id: int = 0
    window_tokens: int = 1 << 21


DEFAULT = MatrixRules()


class LeastRoom:
    """Open sequences by free tokens; a segment tree tells which ranges hold any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = [0] * (2 * self.size)

    def _add(self, free: int, by: int) -> None:
        i = self.size + free
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, sequence: int) -> None:
        self.held[free].append(sequence)
        self._add(free, 1)

    def take(self, room: int) -> tuple[int, int] | None:
        """(free, sequence) with the least free space that is `room` or more, removed."""
        i = self.size + room
        count = self.count
        while not count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        self._add(free, -1)
        return free, self.held[free].pop()


def best_fit(lengths: list[int], seq_len: int) -> list[list[tuple[int, int, int]]]:
    """For each sequence its segments (document, start, length), in place order."""
    out: list[list[tuple[int, int, int]]] = []
    tails = []
    for d, n in enumerate(lengths):
        whole = n // seq_len
        out += [[(d, k * seq_len, seq_len)] for k in range(whole)]
        if n % seq_len:
            tails.append((n % seq_len, d, whole * seq_len))
    tails.sort(key=lambda t: (-t[0], t[1]))
    room = LeastRoom(seq_len)
    for n, d, start in tails:
        free, k = room.take(n) or (seq_len, len(out))
        if k == len(out):
            out.append([])
        out[k].append((d, start, n))
        if free > n:
            room.put(free - n, k)
    return out


def pack_matrices(docs: DataFrame, rules: MatrixRules = DEFAULT, vocabulary_name: str = "word_bpe_49k.json", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, doc_ids, starts, cu_seqlens, ids, position_ids."""
    id_field = docs.schema[id_col]
    schema = f"sequence_id bigint, n_tokens int, doc_ids array<{id_field.dataType.simpleString()}>, starts array<bigint>, cu_seqlens array<int>, ids binary, position_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_field.dataType)
        sequence, size, ramp = first_sequence(), rules.seq_len, np.arange(rules.seq_len, dtype="<u4")
        for keys, held in windows(encoded(batches, path or vocabulary(vocabulary_name), rules.end_id), rules.window_tokens):
            rows: dict[str, list] = defaultdict(list)
            for k, segments in enumerate(best_fit([len(x) for x in held], size)):
                ids, places, at = np.full(size, rules.pad_id, "<u4"), np.zeros(size, "<u4"), [0]
                for d, start, n in segments:
                    ids[at[-1] : at[-1] + n] = held[d][start : start + n]
                    places[at[-1] : at[-1] + n] = ramp[:n]
                    at.append(at[-1] + n)
                for name, x in zip(("id", "n", "docs", "starts", "cu", "ids", "places"), (sequence + k, at[-1], [keys[s[0]] for s in segments], [s[1] for s in segments], at, ids.tobytes(), places.tobytes()), strict=True):
                    rows[name].append(x)
                if len(rows["id"]) == 512:
                    yield _batch(rows, kind)
                    rows.clear()
            sequence += k + 1
            if rows["id"]:
                yield _batch(rows, kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _batch(rows: dict[str, list], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows["id"], pa.int64()), pa.array(rows["n"], pa.int32()), pa.array(rows["docs"], pa.list_(kind)), pa.array(rows["starts"], pa.list_(pa.int64())),
            pa.array(rows["cu"], pa.list_(pa.int32())), pa.array(rows["ids"], pa.binary()), pa.array(rows["places"], pa.binary()),
        ],
        names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids"],
    )


def write_matrices(packed: DataFrame, path: str) -> None:
    """Store the sequences as Parquet in a folder that the cluster shares."""
    packed.write.mode("overwrite").parquet(path)


def matrices(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id matrix, position matrix, cumulative lengths of all segments, rows' first segments)."""
    ids = np.stack([np.frombuffer(r["ids"], "<u4") for r in rows])
    places = np.stack([np.frombuffer(r["position_ids"], "<u4") for r in rows])
    return ids, places, np.concatenate([np.asarray(r["cu_seqlens"], np.int32) for r in rows]), np.cumsum([0, *(len(r["cu_seqlens"]) for r in rows)])
