"""Scalar functions on texts: lengths, cuts, code ranges, encoded blocks, JSON leaves."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

CODE_UNITS = 100_000
MOST_BLOCKS = 5
#: Bytes of the texts that a worker has as Python objects at a time.
PART_BYTES = 1 << 20
_BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
_INLINE = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r'"[^"\n]*"')

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEAVES = T.ArrayType(T.StructType([T.StructField("leaf_no", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]))


def utf16_length(c: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def pointer_escape(c: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def byte_prefix(text: str, most: int) -> str:
    """The longest prefix of at most so many UTF-8 bytes; no character is split."""
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= most else raw[: max(most, 0)].decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def cut_bytes(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else byte_prefix(t, int(m)) for t, m in zip(text, most, strict=True)], dtype=object)


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about so many bytes of text; a longer single text stands alone.

    An Arrow batch has up to 10,000 rows of any length; done run by run, its Python objects and results
    take the memory of a run and not that of the batch.
    """
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
        yield at, end - at
        at, done = end, int(upto[end - 1])


def code_ranges(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of code: fences, inline spans outside of them, quoted cells of tables."""
    out: list[tuple[int, int]] = []
    at, opened = 0, None
    lines = text.split("\n")
    for line in lines:
        if line.lstrip().startswith("```"):
            if opened is None:
                opened = at
            else:
                out.append((opened, min(at + len(line) + 1, len(text))))
                opened = None
        at += len(line) + 1
    if opened is not None:
        out.append((opened, len(text)))
    fences = list(out)
    out += [m.span() for m in _INLINE.finditer(text) if not any(a <= m.start() < b for a, b in fences)]
    at = 0
    for line in lines:
        if line.startswith("|"):
            out += [(at + m.start(), at + m.end()) for m in _QUOTED.finditer(line)]
        at += len(line) + 1
    return out


def decoded_blocks(text: str, units: int = CODE_UNITS, most: int = MOST_BLOCKS) -> list[str]:
    """Texts hidden in base64 runs: mostly printable, ten characters at least, the first few."""
    out: list[str] = []
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        body = body[:-1] if len(body) % 4 == 1 else body
        said = base64.b64decode(body + "=" * (-len(body) % 4)).decode("utf-8", "replace")
        size = len(said.encode("utf-16-le")) // 2
        if len(said) < 10 or sum(32 <= ord(c) < 127 for c in said) <= 0.7 * size:
            continue
        if size > units:
            said = said.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")
        out.append(said)
        if len(out) == most:
            break
    return out


def leaves(value: Any, root: str = "", most_nodes: int = 4096, most_depth: int = 64) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """((pointer, text) of each string in document order, counts of nodes, empties and stops)."""
    out: list[tuple[str, str]] = []
    counts = {"nodes": 0, "empty": 0, "too_deep": 0, "too_many": 0}
    stack: list[tuple[Any, str, int]] = [(value, root, 0)]
    while stack:
        node, path, depth = stack.pop()
        counts["nodes"] += 1
        if depth > most_depth:
            counts["too_deep"] += 1
        elif counts["nodes"] > most_nodes:
            counts["too_many"] += 1
        elif isinstance(node, str):
            if node:
                out.append((path, node))
            else:
                counts["empty"] += 1
        elif isinstance(node, dict):
            stack += [(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", depth + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, f"{path}/{i}", depth + 1) for i, v in reversed(list(enumerate(node)))]
    return out, counts


def replaced(value: Any, texts: dict[str, str], path: str = "") -> Any:
    """The value with the leaves at these pointers replaced, all else as it was."""
    if isinstance(value, str):
        return texts.get(path, value)
    if isinstance(value, dict):
        return {k: replaced(v, texts, f"{path}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in value.items()}
    if isinstance(value, list):
        return [replaced(v, texts, f"{path}/{i}") for i, v in enumerate(value)]
    return value


def strict_json(text: str) -> Any:
    """The value of a JSON text; repeated keys are refused."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks: the form whose digest names a record."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(RANGES)
def code_ranges_of(text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in code_ranges(t or "")] for t in text])


@F.arrow_udf(T.ArrayType(T.StringType()))
def decoded_blocks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for at, n in parts(texts):
            yield pa.array([decoded_blocks(t or "") for t in texts.slice(at, n).to_pylist()], pa.list_(pa.string()))
        if not len(texts):
            yield pa.array([], pa.list_(pa.string()))


@F.pandas_udf(LEAVES)
def leaves_of(payload: pd.Series) -> pd.Series:
    """Leaves of JSON texts; a text that isn't JSON has none."""

    def walk(t: str | None) -> list[dict]:
        try:
            found = leaves(strict_json(t)) if t else ([], {})
        except ValueError:
            return []
        return [{"leaf_no": i, "path": p, "text": s} for i, (p, s) in enumerate(found[0])]

    return pd.Series([walk(t) for t in payload])


#: What a JavaScript trim removes.
BLANKS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def dedup_key(c: Column, n: int = 200) -> Column:
    """Lower case of the first n characters."""
    return F.lower(F.substring(c, 1, n))
