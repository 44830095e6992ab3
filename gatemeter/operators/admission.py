"""Lanes: what a rule may do, from evidence, configuration and bundle verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatemeter.functions import stats
from gatemeter.model import LANES, lane_of, lane_rank
from gatemeter.operators.measure import with_bounds, worst

#: Marks of bundle failures that no one may accept, and of the one that can be.
FATAL = ("duplicate material units", "missing strata", "is not resolvable against")
POOLED_ONLY = "worst bundle stratum u95="


def active_rules(rules: DataFrame, surfaces: list[str], sources: dict[str, str]) -> DataFrame:
    """Runnable rules of enabled surfaces whose source asks for a lane above DO_NOT_SHIP."""
    wanted = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair]) if sources else F.create_map().cast("map<string,string>")
    asked = wanted[F.col("source")]
    return rules.where((F.col("kind") != "NONE") & F.col("surface").isin(*surfaces) & (F.coalesce(asked, F.lit("DO_NOT_SHIP")) != "DO_NOT_SHIP")).withColumn("requested", asked)


def reachability(examples: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, status, trials, hits): rules by whether their own examples match.

    `examples` (rule_id, example_no), `hits` (rule_id, example_no) found, `rules` (rule_id, runnable).
    """
    n = examples.groupBy("rule_id").agg(F.count("*").alias("trials"))
    k = hits.select("rule_id", "example_no").distinct().groupBy("rule_id").agg(F.count("*").alias("hits"))
    both = rules.join(n, "rule_id", "left").join(k, "rule_id", "left").fillna(0, ["trials", "hits"])
    status = F.when(~F.col("runnable"), "not_runnable").when(F.col("hits") > 0, "reachable").when(F.col("trials") > 0, "unreachable").otherwise("no_examples")
    zero = F.when(F.col("runnable"), F.col("trials")).otherwise(0)
    return both.select("rule_id", status.alias("status"), zero.cast("long").alias("trials"), F.when(F.col("runnable"), F.col("hits")).otherwise(0).cast("long").alias("hits"))


def admitted(rows: DataFrame, reached: DataFrame, total_hits: DataFrame, rules: DataFrame, bundle: dict) -> DataFrame:
    """(rule_id, lane, reason) of every rule from its report.

    `rows` (rule_id, surface, stratum, trials, hits), `reached` as of ``reachability``,
    `total_hits` (rule_id, all_hits), `rules` (rule_id, surface, excluded_reason); `bundle`
    has ok, failures, worst_trials, worst_hits.
    """
    native = rows.join(rules.select("rule_id", "surface"), ["rule_id", "surface"])
    top = worst(with_bounds(native), ["rule_id"]).select("rule_id", "stratum", "trials", "hits", "u95")
    told = top.withColumn("advise", stats.bound_within(stats.ADVISE)("trials", "hits")).withColumn("deny", stats.bound_within(stats.DENY)("trials", "hits"))
    all_rows = rules.join(reached.select("rule_id", "status"), "rule_id", "left").join(total_hits, "rule_id", "left").join(told, "rule_id", "left")
    ok, deny_all = bool(bundle["ok"]), stats.within(bundle.get("worst_trials") or 0, bundle.get("worst_hits") or 0, stats.DENY) is True
    lane, why = stats.lane(F.lit(True), F.col("trials"), F.lit(ok), F.col("advise"), F.col("deny"))
    cases = [
        (F.col("excluded_reason").isNotNull(), "DO_NOT_SHIP", F.concat(F.lit("not runnable: "), F.col("excluded_reason"))),
        ((F.coalesce(F.col("all_hits"), F.lit(0)) == 0) & (F.col("status") == "unreachable"), "DO_NOT_SHIP", F.lit("no hits and no own example matched")),
        (F.coalesce(F.col("status") != "reachable", F.lit(True)), "RECORD", F.lit("no positive witness")),
        (F.col("trials").isNull(), "RECORD", F.lit("no measurement")),
        (F.lit(not ok), "RECORD", F.lit("bundle gate: " + "; ".join(bundle.get("failures", ())))),
        ((lane == "DENY") & F.lit(not deny_all), "ADVISE", F.lit("bundle bound only qualifies for ADVISE")),
    ]
    out, reason = F, F
    for when, name, text in cases:
        out, reason = out.when(when, name), reason.when(when, text)
    return all_rows.select("rule_id", out.otherwise(lane).alias("lane"), reason.otherwise(F.concat(F.lit("worst native stratum "), F.col("stratum"), F.lit(": "), why)).alias("reason"))


def effective(requested: Column, ceiling: Column, bundle_denies: Column) -> Column:
    """The lesser of what is asked for and what is supported; a bundle may cap DENY at ADVISE."""
    rank = F.least(lane_rank(requested), lane_rank(ceiling))
    return lane_of(F.when((rank == LANES.index("DENY")) & ~F.coalesce(bundle_denies, F.lit(False)), LANES.index("ADVISE")).otherwise(rank))


def reachable_lane(trials: Column, hits: Column) -> Column:
    """The best lane that so many hits in so many trials could support."""
    return F.when(F.coalesce(stats.bound_within(stats.DENY)(trials, hits), F.lit(False)), "DENY").when(F.coalesce(stats.bound_within(stats.ADVISE)(trials, hits), F.lit(False)), "ADVISE").otherwise("RECORD")


def accepted_failures(failures: list[str], bundle_ok: bool, accept_pooled: bool) -> list[str]:
    """The failures that an import may live with; raises for all others."""
    if bundle_ok:
        return []
    failures = failures or ["bundle admission was not verified"]
    fatal = [f for f in failures if any(m in f for m in FATAL) or POOLED_ONLY not in f]
    if fatal:
        raise ValueError("refusals that can't be accepted: " + "; ".join(fatal))
    if not accept_pooled:
        raise ValueError("the worst stratum's bound is above the ceiling; accept the pooled bound to go on")
    return failures


def evidence_ok(trials: Column, hits: Column, stored: Column, measured_at: Column) -> Column:
    """Whether stored evidence is sound: counts in range, the bound as recomputed, an ISO date."""
    return F.coalesce((trials > 0) & (hits >= 0) & (hits <= trials) & (F.abs(stats.u95(trials, hits) - stored) <= 1e-12) & F.try_to_timestamp(measured_at).isNotNull(), F.lit(False))


def pooled(rows: DataFrame) -> DataFrame:
    """Of each surface the row of stratum `all` with the largest bound."""
    return worst(with_bounds(rows.where("stratum = 'all'")), ["surface"])


def promotion(lanes: DataFrame, source: str, requested: str) -> DataFrame:
    """One row: source, rules, short, allowed. All rules of the source must reach the lane."""
    own = lanes.where(F.col("source") == source)
    short = F.count_if(F.col("lane") != requested)
    return own.agg(F.lit(source).alias("source"), F.count("*").alias("rules"), short.alias("short")).withColumn("allowed", (F.col("rules") > 0) & (F.col("short") == 0))


def report_join(rules: DataFrame, report: DataFrame) -> DataFrame:
    """(rule_id, status): each rule's report row is current, stale or missing; ids only in the report are unknown."""
    a, b = rules.select("rule_id", F.col("digest").alias("_own")), report.select("rule_id", F.col("digest").alias("_said"))
    status = F.when(F.col("_own").isNull(), "unknown").when(F.col("_said").isNull(), "unmeasured").when(F.col("_own") == F.col("_said"), "current").otherwise("stale")
    return a.join(b, "rule_id", "full_outer").select("rule_id", status.alias("status"))


def same_bundle(rules: DataFrame, report: DataFrame) -> bool:
    """Whether the report describes exactly these rules."""
    return report_join(rules, report).where("status <> 'current'").isEmpty()
