"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read by a small reader of the protobuf wire format; from it a
``tokenizers.Tokenizer`` is built: the normaliser (its compiled character map, extra
blanks, the marker U+2581 for blanks and before the first word), the unigram scores or the
merges that the piece scores imply, byte fallback and the decoder.

Where no piece holds a marker after another character, a marker always begins new tokens,
so a text's ids are those of its marker-led chunks one after another. Each distinct chunk
is encoded once per worker, new ones in multithreaded batches, and is then compared with
the ids that the sentencepiece library gives; each text so has the number of its chunks
that differ. Other models encode and compare whole texts.

Nothing is shuffled. Defined results: a null text counts as empty and has no ids; repeated
rows are encoded each on its own; an empty table gives an empty result; other columns are
ignored. A worker keeps two generations of chunks of a fixed size, so memory is bounded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatemeter.llm.textbatch import filled, slices
from gatemeter.llm.wordbpe import vocabulary

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
NEWLINE = "\n"
#: Chunks that a worker keeps in each of two generations; those in use move to the younger one.
CACHE_CHUNKS = 200_000
#: Chunks that go through a library as one text.
LEARN_CHUNKS = 2_048


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, 4- and 8-byte values, byte strings."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not used by models")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        m = cls()
        for number, value in wire(data):
            if number == 1:
                own = dict(wire(value))
                m.pieces.append(own.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                m.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(wire(value))
                m.model_type, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(wire(value))
                m.charsmap, m.dummy_prefix = own.get(2, b""), bool(own.get(3, 1))
                m.squeeze, m.escape = bool(own.get(4, 1)), bool(own.get(5, 1))
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that join into a piece, best piece first."""
        rank = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        found = []
        for p, i in rank.items():
            own = [(rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            found += [(-self.scores[i], i, a, b, x, y) for a, b, x, y in sorted(own)]
        found.sort()
        return [(x, y) for *_, x, y in found]

    def tokenizer(self):
        """(tokenizer with the normaliser, the same without)."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if not self.escape:
            raise ValueError("models that keep blanks as they are aren't supported")
        unknown = self.kinds.index(UNKNOWN)

        def bare() -> Tokenizer:
            if self.model_type == UNIGRAM:
                model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=unknown, byte_fallback=self.byte_fallback)
            elif self.model_type == BPE:
                model = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
            else:
                raise ValueError(f"model type {self.model_type} isn't supported")
            made = Tokenizer(model)
            own = [AddedToken(p, normalized=False) for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER]
            if own:
                made.add_tokens(own)
            return made

        full, plain = bare(), bare()
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        full.normalizer = normalizers.Sequence(steps)
        full.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return full, plain


class Coder:
    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = m = Model.read(path)
        self.full, self.plain = m.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [p for p, k in zip(m.pieces, m.kinds, strict=True) if k in (NORMAL, USER, UNUSED)]
        self.chunked = not m.charsmap and not m.squeeze and m.dummy_prefix and USER not in m.kinds and not any(MARK in p.lstrip(MARK) or "\n" in p for p in ordinary)
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        if self.chunked:
            self.head = self.other.encode("\n")[:-1]  # what the word marker before the first newline gives
            self.newline = self.other.encode("\n")[-1]
            self.chunked = m.kinds[self.newline] == BYTE and self.plain.encode("\n", add_special_tokens=False).ids == [self.newline]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, and which of them the libraries encode differently.

        A newline is a token of its own that joins with nothing, so a block of chunks goes
        through each library as one text with newlines between, and is cut there again.
        """
        parts = [chunks[i : i + LEARN_CHUNKS] for i in range(0, len(chunks), LEARN_CHUNKS)]
        made = self.plain.encode_batch_fast(["\n" + "\n".join(part) for part in parts], add_special_tokens=False)
        for part, own in zip(parts, made, strict=True):
            ids = np.array(own.ids, "<u4")
            theirs = np.array(self.other.encode("\n" + "\n".join(part).replace(MARK, " "))[len(self.head) :], "<u4")
            cuts = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            said = ids.tobytes()
            self.known.update(zip(part, [said[4 * a + 4 : 4 * b] for a, b in pairwise(cuts)], strict=True))
            if not np.array_equal(ids, theirs):
                ends = [*np.flatnonzero(theirs == self.newline).tolist(), len(theirs)]
                said = theirs.tobytes()
                self.wrong.update(c for c, (a, b) in zip(part, pairwise(ends), strict=True) if self.known[c] != said[4 * a + 4 : 4 * b])

    def encode(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """(ids as little-endian unsigned 32-bit integers, chunks where the libraries differ) of each text."""
        if not self.chunked:
            out = []
            for text, made in zip(texts, self.full.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = made.ids if text else []
                out.append((np.array(ids, "<u4").tobytes(), int(ids != self.other.encode(text))))
            return out
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {NEWLINE: self.known[NEWLINE]}
            self.wrong &= self.older.keys()
        if not self.known:
            self.known[NEWLINE] = np.array([self.newline], "<u4").tobytes()
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys()
        met = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in met)
        self._learn(list(new - met))
        get, wrong = self.known.__getitem__, self.wrong
        return [(b"".join(map(get, chunks)), sum(map(wrong.__contains__, chunks)) if wrong else 0) for chunks in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        said = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return said[1:] if self.model.dummy_prefix and said[:1] == " " else said


_loaded: dict[str, Coder] = {}


def coder(path: str, threads: int = 2) -> Coder:
    if path not in _loaded:
        _loaded[path] = Coder(path, threads)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary_name: str = "piece_bpe_32k.model", path: str | None = None, threads: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary), ids_crc32, n_differ (from sentencepiece), round_trip."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_crc32", "n_differ", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or vocabulary(vocabulary_name), threads)
        for batch in batches:
            column = filled(batch.column(1))
            for i, j in slices(column, 1 << 20):
                texts = column[i:j].to_pylist()
                made = own.encode(texts)
                ids = [m[0] for m in made]
                back = [own.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(back, pa.bool_()),
                    ],
                    names=names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {'ids binary, ' if with_ids else ''}ids_crc32 bigint, n_differ bigint, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary_name: str = "piece_bpe_32k.model", path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id and the text of its ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or vocabulary(vocabulary_name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def query(docs: DataFrame) -> DataFrame:
    return encode_documents(docs)
