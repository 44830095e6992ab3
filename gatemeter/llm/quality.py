"""Quality rules: how much of a text stands inside repeated n-grams and repeated lines.

For every text, rolling 64-bit hashes of its words give all windows of several lengths;
windows found twice or more in the text cover words, and the covered words' code points
over all words' code points is the coverage of that length. Likewise for lines that equal
an earlier line. One pass of numpy arrays handles a few thousand texts at once; nothing
is shuffled, and memory is bounded by the slice of texts in hand.

Defined results: a null or blank text has no words and fails; ties and repeated rows are
judged each on its own; an empty table gives an empty result; further columns of the
input pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatemeter.llm.textbatch import Slice, covered, filled, grams, mix, repeated, running, slices


@dataclass(frozen=True)
class QualityRules:
    """Limits. A text with fewer words, or above any share, is rejected."""

    min_words: int = 10
    #: percent of words inside 5-word windows found twice or more
    max_repeat_percent: int = 20
    #: n-gram length -> largest share of word code points inside repeated windows
    max_coverage: tuple[tuple[int, float], ...] = ((5, 0.25), (7, 0.22), (10, 0.20))
    #: largest share of code points in lines that equal an earlier line
    max_line_coverage: float = 0.20
    symbols: str = "#*$%&|<>"


DEFAULT = QualityRules()


@dataclass
class Measured:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    dup_line_chars: np.ndarray
    gram_chars: dict[int, np.ndarray] = field(default_factory=dict)


def measure(column: pa.Array, rules: QualityRules = DEFAULT) -> Measured:
    """The counts of each text of a column without nulls."""
    s = Slice(column)
    lead = s.code_points()
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in rules.symbols]] = True
    chars = running(lead & s.solid)
    size = len(s.start)
    word_chars = chars[s.end] - chars[s.start]
    word = s.words()
    salt = mix(np.arange(1, s.n + 1, dtype=np.uint64))
    gram_chars, repeat = {}, np.zeros(s.n, np.int64)
    for n in sorted({5, *(k for k, _ in rules.max_coverage)}):
        at, h = grams(word, s.row, n)
        inside = covered(at[repeated(h ^ salt[s.row[at]])], n, size)
        if n == 5:
            repeat = np.bincount(s.row[inside], minlength=s.n)
        gram_chars[n] = np.bincount(s.row[inside], weights=word_chars[inside], minlength=s.n).astype(np.int64)
    start, end, row = s.lines()
    points = running(lead)
    real = chars[end] > chars[start]
    start, end, row = start[real], end[real], row[real]
    later = np.zeros(len(start), bool)
    if len(start) > 1:
        key = s.hashes(start, end) ^ salt[row]
        order = np.lexsort((start, key))
        later[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return Measured(
        s.n_words, s.counted(lead & s.solid), s.counted(marks[s.data]), np.bincount(row[later], minlength=s.n), repeat,
        np.bincount(row[later], weights=(points[end] - points[start])[later], minlength=s.n).astype(np.int64), gram_chars,
    )


def verdicts(m: Measured, rules: QualityRules = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept): the word rules, and these together with the coverage rules."""
    failed = (m.n_words < rules.min_words) | (100 * m.n_repeat_words > rules.max_repeat_percent * m.n_words)
    bad = m.dup_line_chars > rules.max_line_coverage * m.word_chars
    for n, share in rules.max_coverage:
        bad |= m.gram_chars[n] > share * m.word_chars
    return failed, ~failed & ~bad


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, rules: QualityRules = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, coverages in code points, base_failed, kept."""
    lengths = [n for n, _ in rules.max_coverage]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in (*BASE, "dup_line_chars", *(f"gram{n}_chars" for n in lengths))) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for i, j in slices(texts):
                m = measure(texts[i:j], rules)
                failed, kept = verdicts(m, rules)
                values = [*(getattr(m, c) for c in BASE), m.dup_line_chars, *(m.gram_chars[n] for n in lengths)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *(pa.array(v.astype(np.int64)) for v in values), pa.array(failed), pa.array(kept)],
                    names=[id_col, *BASE, "dup_line_chars", *(f"gram{n}_chars" for n in lengths), "base_failed", "kept"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: QualityRules = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns and nothing else."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(at))
            for i, j in slices(texts):
                kept = verdicts(measure(texts[i:j], rules), rules)[1]
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document, then the coverages."""
    out = score(docs)
    first = ["doc_id", *BASE, "base_failed", "kept"]
    return out.select(*first, *[F.col(c) for c in out.columns if c not in first])
