"""Secret scans: three base patterns and a conditional random field.

Base spans (leftmost, non-overlapping for each kind): *assign*, a password-like name that
is given a value of six characters or more; *access*, a key id of twenty or more; *hex*, a
run of 24 or more lower-case hex digits. Spans are code-point ranges of the whole match.

The field tags tokens as outside, begin or inside of a secret, from their shape, their
neighbours and features of the whole text, and adds its spans (*crf*), without what base
spans cover of them. Only tokens of *odd* words may be tagged begin or inside (words with a digit, a
change from lower to upper case, or 24 bytes and more), and *hinted* tokens: at most four
tokens after a hint word, with an assignment mark or a quote between. All other tokens are
outside by rule, and features look at most four tokens back and one ahead, so decoding the
stretches around these words gives just what decoding the whole text gives. Words are classified for
whole slices by numpy; weights are trained by ``train_secrets`` on made-up lines.

Nothing is shuffled. Defined results: null texts count as empty and have no spans; repeated
rows are scanned each on its own; an empty table gives an empty result; ``redact`` keeps
all columns and their order, with other columns untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatemeter.llm.crf import B, I, Crf
from gatemeter.llm.textbatch import Slice, filled, running, slices

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "api")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|=+|[^\s]")
_HINTS = frozenset("password passwd pwd pass secret token key apikey api_key auth bearer credential credentials authorization access_key secret_key private_key client_secret".split())
#: a hint word as a part of a token, up to the token's end
_HINT = re.compile(r"(?<![A-Za-z0-9+/])(?:password|passwd|pwd|pass|secret|token|key|apikey|auth|bearer|credentials?|authorization)(?![A-Za-z0-9+/])[A-Za-z0-9+/_-]*", re.ASCII | re.IGNORECASE)
_HINT_PARTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
_BACK, _AHEAD = 4, 1
MIN_CHARS = 8

_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_HEXES = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start of the secret, end of the secret) of the base matches."""
    out = []
    low = text.lower()  # only tells whether a name may be there
    if any(n in low for n in _NAMES):
        out += [(m.start(), "assign", m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [(m.start(), "hex", m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return out



def shape(token: str) -> str:
    """Character classes with runs as one: aA0 and the symbols themselves."""
    out = []
    for c in token[:40]:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6]) + ("~" if len(out) > 6 else "")


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def features(tokens: list[str], whole: list[str]) -> list[list[str]]:
    """Features of each token; `whole` are those of the text it stands in."""
    low = [t.lower() for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        n = len(t)
        digits = sum(c.isdigit() for c in t)
        vowels = sum(c in "aeiouAEIOU" for c in t)
        own = [
            "one", f"shape={shape(t)}", f"len={min(n.bit_length(), 7)}", f"digits={round(4 * digits / n)}", f"entropy={min(int(_entropy(t)), 5)}", f"vowels={min(round(5 * vowels / n), 3)}",
            f"long={n >= 16}|digits={0 < digits < n}|entropy={_entropy(t) > 3.2}",
        ]
        if digits == n:
            own.append("digits_only")
        if n >= 12 and re.fullmatch("[0-9a-fA-F]+", t):
            own.append("hex")
        if re.match(r"(?:sk|pk|rk)_|gh[pousr]_|xox[abp]-|AIza|ya29|eyJ|glpat-|AKIA|ASIA", t):
            own.append("prefix")
        if "_" in t or "-" in t:
            own.append(f"parts={min(1 + t.count('_') + t.count('-'), 4)}")
        back = low[max(0, i - _BACK) : i]
        hint = any(b in _HINTS or any(p in _HINTS for p in re.split("[_-]", b)) for b in back)
        own.append(f"hint={hint}|long={n >= 16}")
        own.append(f"before={back[-1] if back and not back[-1][0].isalnum() else 'word' if back else 'none'}")
        own.append(f"after={low[i + 1] if i + 1 < len(low) and not low[i + 1][0].isalnum() else 'word' if i + 1 < len(low) else 'none'}")
        out.append(own + whole)
    return out


def hinted(text: str) -> set[int]:
    """Where the tokens begin that follow a hint word and an assignment mark or quote, a few tokens on."""
    out: set[int] = set()
    low = text.lower()  # only tells whether a hint may be there
    if any(p in low for p in _HINT_PARTS):
        for hint in _HINT.finditer(text):
            marked, at = False, hint.end()
            for _ in range(_BACK):
                m = _TOKEN.search(text, at)
                if not m:
                    break
                at = m.end()
                if m[0][0] in "=:\"'`":
                    marked = True
                elif marked and m[0][0].isalnum():
                    out.add(m.start())
    return out


def about(n_chars: int, n_equals: int, n_odd: int) -> list[str]:
    """Features of a whole text."""
    return [f"file_equals={min(3, round(1000 * n_equals / max(n_chars, 1)))}", f"file_odd={min(3, round(200 * n_odd / max(n_chars, 1)))}"]


@cache
def model() -> Crf:
    return Crf.load(files("gatemeter.llm").joinpath("secret_crf.json").read_text())


def crf_spans(text: str, words: list[tuple[int, int]], odd: list[int], crf: Crf, whole: list[str], after: set[int] | frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """Secrets of one text, given its words, which of them are odd and where hinted tokens begin."""
    out, k, strange = [], 0, set(odd)
    if after:
        starts = [a for a, _ in words]
        odd = sorted(strange | {bisect_right(starts, x) - 1 for x in after})
    while k < len(odd):
        first = last = odd[k]
        k += 1
        while k < len(odd) and odd[k] - last <= _BACK + _AHEAD:
            last = odd[k]
            k += 1
        lo, hi = max(0, first - _BACK), min(len(words), last + _AHEAD + 1)
        tokens, spans, free = [], [], []
        for i in range(lo, hi):
            a, b = words[i]
            for m in _TOKEN.finditer(text, a, b):
                tokens.append(m[0])
                spans.append((m.start(), m.end()))
                free.append(i in strange or m.start() in after)
        tags = crf.decode(features(tokens, whole), free)
        at = 0
        while at < len(tags):
            if tags[at] != B:
                at += 1
                continue
            end = at + 1
            while end < len(tags) and tags[end] == I:
                end += 1
            if spans[end - 1][1] - spans[at][0] >= MIN_CHARS:
                out.append((spans[at][0], spans[end - 1][1]))
            at = end
    return out


def beyond(start: int, end: int, base: list[tuple[int, str, int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that no base span covers."""
    out = []
    for a, b in sorted((f[0], f[2]) for f in base if f[0] < end and f[2] > start):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def odd_words(s: Slice) -> np.ndarray:
    """Flags of the words whose tokens may be tagged as secrets."""
    d = s.data
    rise = np.zeros(len(d), bool)
    rise[1:] = _UPPER[d[1:]] & _LOWER[d[:-1]]
    digits, rises = running(_DIGIT[d]), running(rise)
    return (digits[s.end] > digits[s.start]) | (rises[s.end] > rises[np.minimum(s.start + 1, s.end)]) | (s.end - s.start >= 24)


def spans_of(texts: pa.Array, crf: Crf | None = None) -> list[list[tuple[int, str, int, int, int]]]:
    """All spans of each text, by start and then kind."""
    crf = crf or model()
    s = Slice(texts)
    odd = np.flatnonzero(odd_words(s))
    row_first = np.searchsorted(s.row[odd], np.arange(s.n + 1))
    word_first = np.concatenate([[0], np.cumsum(s.n_words)])
    points = running(s.code_points())
    hexes = running(_HEXES[s.data])
    long_runs = np.zeros(s.n, bool)
    if len(s.data) >= 24:
        full = np.flatnonzero(hexes[24:] - hexes[:-24] == 24)
        long_runs[np.unique(np.searchsorted(s.off, full, "right") - 1)] = True
    equals = s.counted(s.data == 61)
    out = []
    for r in range(s.n):
        if s.off[r] == s.off[r + 1]:
            out.append([])
            continue
        text = texts[r].as_py()
        base = base_spans(text, bool(long_runs[r]))
        found = list(base)
        mine = odd[row_first[r] : row_first[r + 1]]
        after = hinted(text)
        if len(mine) or after:
            a, b, zero = word_first[r], word_first[r + 1], points[s.off[r]]
            words = list(zip((points[s.start[a:b]] - zero).tolist(), (points[s.end[a:b]] - zero).tolist(), strict=True))
            for x, y in crf_spans(text, words, (mine - a).tolist(), crf, about(len(text), int(equals[r]), len(mine)), after):
                found += [(p, "crf", q, p, q) for p, q in beyond(x, y, base)]
        found.sort(key=lambda f: (f[0], KINDS.index(f[1])))
        out.append(found)
    return out


def _joined(found: list, kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _, _ in found if kind in kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for i, j in slices(texts):
                found = spans_of(texts[i:j])
                counts = [pa.array([sum(f[1] == k for f in x) for x in found], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(_joined(x, KINDS[:3]).encode()).hexdigest() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *counts[:3], digest, pa.array([_joined(x) for x in found], pa.string()), counts[3]], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")


def redacted(text: str, found: list, mark: str) -> str:
    """The text with each secret (for an assignment its value) replaced."""
    parts, at = [], 0
    for a, b in sorted((f[3], f[4]) for f in found):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with their secrets replaced; chars_col, if there, counts the new text."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(at))
            for i, j in slices(texts):
                part = batch.slice(i, j - i)
                found = spans_of(texts[i:j])
                hit = [k for k, x in enumerate(found) if x]
                if hit:
                    columns = list(part.columns)
                    made = columns[at].to_pylist()
                    for k in hit:
                        made[k] = redacted(made[k], found[k], mark)
                    columns[at] = pa.array(made, columns[at].type)
                    if count is not None:
                        sizes = columns[count].to_pylist()
                        for k in hit:
                            sizes[k] = len(made[k])
                        columns[count] = pa.array(sizes, columns[count].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
