"""What may be shipped or read: excluded paths, declared origins, allow and deny lists."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Archive folders that are never read.
NEVER = ("data/skill-benchmark/malicious", "data/test-corpora", "conformance", "spec/conformance", "tests/fixtures")


@F.pandas_udf(T.StringType())
def plain_path(path: pd.Series) -> pd.Series:
    """The path with forward slashes, without dots and doubled slashes."""
    return pd.Series([None if p is None else posixpath.normpath(p.replace("\\", "/")) for p in path], dtype=object)


def under(path: Column, folders: tuple[str, ...]) -> Column:
    """The first of the folders that holds the path (or is it), or an empty string."""
    out = F.lit("")
    for f in reversed(folders):
        bare = f.rstrip("/")
        out = F.when((path == bare) | path.startswith(bare + "/"), f).otherwise(out)
    return out


def denied(path: Column) -> Column:
    return under(path, NEVER) != ""


def declared(path: Column, allowed: tuple[str, ...], licence_path: str | None = None) -> Column:
    """Allow-list: names that end in a slash admit what is below, others themselves."""
    exact = [a for a in (*allowed, licence_path) if a and not a.endswith("/")]
    deep = [a for a in allowed if a.endswith("/")]
    out = path.isin(*exact) if exact else F.lit(False)
    for a in deep:
        out = out | path.startswith(a)
    return out


def admitted(path: Column, target: Column, allowed: tuple[str, ...], licence_path: str | None = None) -> Column:
    """A file counts only if both its name and, for a link, what it points to are admitted."""
    return declared(path, allowed, licence_path) & declared(F.coalesce(target, path), allowed, licence_path)


def restricted_origin(leaves: Column, word: str) -> Column:
    """Whether any string of the declared origin fields names a restricted origin."""
    return F.exists(leaves, lambda x: F.lower(x).contains(word.lower()))


def shippable(restricted: Column, excluded: Column) -> Column:
    return ~F.coalesce(restricted, F.lit(False)) & (F.coalesce(excluded, F.lit("")) == "")


def drop_reason(surface: Column, runnable: Column, ships: Column, loud: Column, refusal: Column, blank: Column, surfaces: tuple[str, ...] = ("IN", "OUT")) -> Column:
    """The first reason to leave a rule out of a bundle, or keep."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(~surface.isin(*surfaces), "surface").when(no(runnable), "not_runnable").when(no(ships), "not_shippable").when(F.coalesce(loud, F.lit(False)), "measured_loud")
        .when(refusal.isNotNull(), "screen_refused").when(F.coalesce(blank, F.lit(False)), "fires_on_content_free_leaf").otherwise("keep")
    )
