"""Exact binomial bounds and the lanes that they allow.

The 95 % upper bound of a firing rate is the Clopper-Pearson bound: the rate p at which
P(X <= hits) = 0.05. Decisions are made on counts: ``bound_within`` compares the CDF at the
threshold and answers yes, no, or null where float arithmetic can't tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ALPHA = 0.05
ADVISE, DENY = 0.005, 0.001
MOST_TRIALS = 10_000_000
SLACK = 1e-6


def log_cdf(n: int, k: int, p: float) -> float:
    """log P(X <= k) of a binomial, summed downward from the term of k."""
    if k >= n:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0
    odds = (1 - p) / p
    for j in range(k, 0, -1):
        term *= j / (n - j + 1) * odds
        total += term
        if term < 1e-16 * total:
            break
    return first + math.log(total)


def upper_bound(n: int, k: int) -> float:
    """The bound for k hits in n trials; 1 without trials or misses."""
    if n <= 0 or k >= n:
        return 1.0
    if k == 0:
        return -math.expm1(math.log(ALPHA) / n)
    lo, hi, aim = k / n, 1.0, math.log(ALPHA)
    for _ in range(64):
        mid = (lo + hi) / 2
        if log_cdf(n, k, mid) > aim:
            lo = mid
        else:
            hi = mid
    return hi


def within(n: int | None, k: int | None, t: float) -> bool | None:
    """Whether the bound for k of n is at most t; None if it can't be told."""
    if n is None or k is None or not 0 <= k <= n or not 0 < t < 1 or n > MOST_TRIALS:
        return None
    if k == n:
        return False
    if k == 0:
        need = math.log(ALPHA) / math.log1p(-t)
        return None if abs(n - need) < SLACK else n >= need
    if k / n >= t:
        return False
    gap = log_cdf(n, k, t) - math.log(ALPHA)
    return None if abs(gap) < SLACK else gap < 0


def u95_zero(n: Column) -> Column:
    """The bound for no hits, in closed form."""
    return F.when(n > 0, 1 - F.pow(F.lit(ALPHA), 1.0 / n)).otherwise(F.lit(1.0))


def trials_needed(t: Column) -> Column:
    """Trials without a hit that put the bound at t or below."""
    return F.ceil(F.log(F.lit(ALPHA)) / F.log(1 - t)).cast("long")


@F.pandas_udf(T.DoubleType())
def u95(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bound of (trials, hits). Few distinct counts occur, so each is worked out once a task."""
    known: dict[tuple[int, int], float] = {}
    for n, k in batches:
        keys = list(zip(n.tolist(), k.tolist(), strict=True))
        for key in set(keys) - known.keys():
            known[key] = upper_bound(int(key[0]), int(key[1]))
        yield pd.Series([known[x] for x in keys], dtype=float)


def bound_within(threshold: float):
    """A column function of (trials, hits): true, false or null."""

    @F.pandas_udf(T.BooleanType())
    def decide(n: pd.Series, k: pd.Series) -> pd.Series:
        told = {key: within(*key, threshold) for key in set(zip(n.tolist(), k.tolist(), strict=True))}
        return pd.Series([told[x] for x in zip(n.tolist(), k.tolist(), strict=True)], dtype="boolean")

    return decide


def log_gamma_free_u95(n: Column, k: Column, steps: int = 50) -> Column:
    """The same bound by higher-order functions alone: bisection on the CDF's logarithm.

    The binomial coefficient's logarithm is a sum over 1 to k; the CDF is summed downward
    from the term of k, relative to it, so nothing underflows.
    """
    up = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))
    choose = F.aggregate(up, F.lit(0.0), lambda s, j: s + F.when(j <= k, F.log((n - j + 1) / j)).otherwise(0.0))

    def log_cdf_at(p: Column) -> Column:
        odds = (1 - p) / p
        one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        step = lambda s, j: s["term"] * F.when(j <= k, j / (n - j + 1) * odds).otherwise(1.0)
        total = F.aggregate(F.reverse(up), one, lambda s, j: F.struct(step(s, j).alias("term"), (s["sum"] + F.when(j <= k, step(s, j)).otherwise(0.0)).alias("sum")), lambda s: s["sum"])
        return choose + k * F.log(p) + (n - k) * F.log(1 - p) + F.log(total)

    start = F.struct((k / n).cast("double").alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = log_cdf_at(mid) > math.log(ALPHA)
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["hi"])
    return F.when((n <= 0) | (k >= n), 1.0).otherwise(found)


def lane(runnable: Column, trials: Column, bundle_ok: Column, advise: Column, deny: Column) -> tuple[Column, Column]:
    """(lane, reason). advise and deny say whether the bound is within the ceilings; null means no."""
    cases = [
        (~runnable, "DO_NOT_SHIP", "no executable predicate"), (trials.isNull(), "RECORD", "no measurement"), (~F.coalesce(bundle_ok, F.lit(False)), "RECORD", "bundle gate failed"),
        (advise.isNull(), "RECORD", "bound not resolvable"), (~F.coalesce(advise, F.lit(False)), "RECORD", "bound above the ceiling"), (F.coalesce(deny, F.lit(False)), "DENY", "bound within the deny ceiling"),
    ]
    name = reason = None
    for when, value, why in cases:
        name = F.when(when, value) if name is None else name.when(when, value)
        reason = F.when(when, why) if reason is None else reason.when(when, why)
    return name.otherwise("ADVISE"), reason.otherwise("bound within the advise ceiling")
