"""Checks on rules and reports: probes, digests, leaf boundaries, parity, pins, rights."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gatemeter.functions import rights
from gatemeter.functions.probes import COMMON, CONTENT_FREE
from gatemeter.functions.screen import strip_assertions
from gatemeter.functions.text import canonical_json, cut_bytes
from gatemeter.model import Rule
from gatemeter.operators.match import byte_allowance, check_load, compiled, coverage, match_python, schedule_key


def rule_digest(rule: Rule) -> str:
    """The SHA-256 of what a rule is, lane aside: changed predicates make a new digest."""
    said = asdict(rule)
    said.pop("lane")
    return hashlib.sha256(canonical_json(said).encode("utf-8", "surrogatepass")).hexdigest()


def set_digest(rules: list[Rule], surfaces: list[str]) -> str:
    """The digest of an enabled set: evidence holds for exactly this set and these surfaces."""
    return hashlib.sha256(canonical_json({"surfaces": sorted(surfaces), "rules": sorted(map(rule_digest, rules))}).encode()).hexdigest()


def digests(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, rule_digest(r)) for r in rules], "rule_id string, digest string")


def tree_digest(files: DataFrame) -> DataFrame:
    """(digest, files) of (path, sha256): each path, a zero byte, its digest and a newline, by path. A rule tree's files are few."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("files"))


def probe(spark: SparkSession, rules: list[Rule], texts: tuple[str, ...]) -> DataFrame:
    """(rule_id, probe_no) of the texts that each rule accepts."""
    rows = [(c.rule.id, i) for c in compiled(rules)[0] for i, t in enumerate(texts) if c.search(t)]
    return spark.createDataFrame(rows, "rule_id string, probe_no int")


def content_free(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules that fire on text without content."""
    return probe(spark, rules, CONTENT_FREE).groupBy("rule_id").agg(F.min("probe_no").alias("probe_no"))


def breadth(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, breadth, probes): BROAD if a common text is accepted, MEDIUM otherwise."""
    hits = probe(spark, rules, COMMON).groupBy("rule_id").agg(F.array_sort(F.collect_list("probe_no")).alias("probes"))
    ids = spark.createDataFrame([(r.id,) for r in rules], "rule_id string").join(hits, "rule_id", "left")
    return ids.select("rule_id", F.when(F.col("probes").isNull(), "MEDIUM").otherwise("BROAD").alias("breadth"), F.coalesce("probes", F.array().cast("array<int>")).alias("probes"))


def _without_assertions(rule: Rule) -> list[str] | None:
    made = [strip_assertions(p) for p in rule.patterns] if not rule.kind.startswith("SUBSTRING") else []
    return None if None in made else made


ASSERTIONS = {"caret": r"(?<!\\)(?<!\[)\^", "dollar": r"(?<!\\)\$", "word": r"\\[bB]", "text": r"\\[AZ]", "ahead": r"\(\?[=!]", "behind": r"\(\?<[=!]"}


def construct_census(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(construct, rules): rules that hold a construct of no width."""
    rows = [(name, r.id) for r in rules if not r.kind.startswith("SUBSTRING") for name, p in ASSERTIONS.items() if any(re.search(p, x) for x in r.patterns)]
    return spark.createDataFrame(rows, "construct string, rule_id string").groupBy("construct").agg(F.countDistinct("rule_id").alias("rules"))


def boundary_hits(units: DataFrame, rules: list[Rule], unit_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, rule_id, joined, by_line, relaxed): how a unit's hits depend on where leaves are cut.

    joined: the rule matches the whole text. by_line: it matches a single line (patterns that
    hold no assertion can't gain). relaxed: it matches without its assertions.
    """
    check_load(rules)
    kind = units.schema[unit_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(rules)[0]
        bare = {}
        for c in ready:
            made = _without_assertions(c.rule)
            bare[c.rule.id] = c if c.rule.kind.startswith("SUBSTRING") else None if made is None else type(c)(c.rule, [re.compile(p, x.flags) for p, x in zip(made, c.patterns, strict=True)], [None] * len(made))
        for batch in batches:
            ids, names, flags = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                for c in ready:
                    joined = c.search(text) is not None
                    loose = bare[c.rule.id]
                    relaxed = joined or loose is None or loose.search(text) is not None
                    by_line = joined or relaxed and any(c.search(x) for x in text.split("\n"))
                    if relaxed:
                        ids.append(i)
                        names.append(c.rule.id)
                        flags.append((joined, bool(by_line), True))
            columns = list(zip(*flags, strict=True)) if flags else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), *(pa.array(list(x), pa.bool_()) for x in columns)], names=["unit", "rule_id", "joined", "by_line", "relaxed"])

    return units.select(unit_col, text_col).mapInArrow(run, f"unit {kind}, rule_id string, joined boolean, by_line boolean, relaxed boolean")


def boundary_summary(hits: DataFrame) -> DataFrame:
    """One row: units hit as joined texts, by line, and without assertions."""
    by_unit = hits.groupBy("unit").agg(*[F.bool_or(c).alias(c) for c in ("joined", "by_line", "relaxed")])
    return by_unit.agg(*[F.count_if(c).alias(c) for c in ("joined", "by_line", "relaxed")])


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("length", "start_a", "start_b")]))
def longest_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The longest run of words that two texts share."""
    rows = []
    for x, y in zip(a, b, strict=True):
        p, q = (x or "").split(), (y or "").split()
        m = difflib.SequenceMatcher(None, p, q, autojunk=False).find_longest_match()
        rows.append((m.size, m.a, m.b))
    return pd.DataFrame(rows, columns=["length", "start_a", "start_b"])


def parity(rules: list[Rule], originals: dict[str, tuple[str, list[str]]], texts: DataFrame) -> DataFrame:
    """(rule_id, text_no, composed, original) where a composed rule differs from its conditions.

    `originals` maps a rule's id to (any or all, its conditions); `texts` is (rule_id, text_no, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {c.rule.id: c for c in compiled(rules)[0]}
        for batch in batches:
            rows = []
            for rule_id, no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = ready.get(rule_id)
                if c is None:
                    continue
                logic, conditions = originals[rule_id]
                flags = 0 if c.rule.case_sensitive else re.IGNORECASE
                want = (all if logic == "all" else any)(re.search(p, text or "", flags) for p in conditions)
                got = c.search(text or "") is not None
                if got != want:
                    rows.append((rule_id, no, got, want))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], names=["rule_id", "text_no", "composed", "original"])

    return texts.select("rule_id", F.col("text_no").cast("int"), "text").mapInArrow(run, "rule_id string, text_no int, composed boolean, original boolean")


def mixed_procedure(units: DataFrame) -> DataFrame:
    """(surface, whole, leafwise, mixed): a surface's units must all be whole or all in parts."""
    parts = F.count_if(F.col("parts").isNotNull())
    return units.groupBy("surface").agg((F.count("*") - parts).alias("whole"), parts.alias("leafwise")).withColumn("mixed", (F.col("whole") > 0) & (F.col("leafwise") > 0))


def units_of_parts(part_hits: DataFrame) -> DataFrame:
    """(unit, rule_ids): the union of the hits of a unit's parts."""
    return part_hits.groupBy("unit").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def folder_report(found: DataFrame) -> DataFrame:
    """(rule_id, hits) over complete units, and the row of null id: units hit by any rule."""
    whole = coverage(found).where("complete").select("unit")
    hits = found.where("status = 'hit'").join(whole, "unit", "left_semi")
    each = hits.groupBy("rule_id").agg(F.countDistinct("unit").alias("hits"))
    return each.unionByName(hits.agg(F.lit(None).cast("string").alias("rule_id"), F.countDistinct("unit").alias("hits")))


def scan_leaves(leaves: DataFrame, rules: list[Rule], most_bytes: int = 4 << 20, seconds: float | None = 1.0) -> DataFrame:
    """``match_python`` over leaves (unit, leaf_no, text) under a running byte allowance of each unit.

    Leaves past the allowance aren't scanned and the one that crosses it is cut; both count
    against completeness by ``leaf_coverage``.
    """
    allowed = byte_allowance(leaves, most_bytes, "unit", "leaf_no")
    w = Window.partitionBy("unit").orderBy("leaf_no").rowsBetween(Window.unboundedPreceding, -1)
    left = most_bytes - F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(w), F.lit(0))
    kept = F.when(F.col("truncated"), cut_bytes("text", left.cast("long"))).otherwise(F.col("text"))
    return match_python(allowed.withColumn("text", kept).where("scheduled"), rules, seconds)


def leaf_coverage(leaves: DataFrame, found: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """(unit, leaves, scheduled, truncated, complete) of a scan under an allowance."""
    n = byte_allowance(leaves, most_bytes, "unit", "leaf_no").groupBy("unit").agg(F.count("*").alias("leaves"), F.count_if("scheduled").alias("scheduled"), F.count_if("truncated").alias("truncated"))
    c = coverage(found).select(F.col("unit").alias("_u"), F.col("complete").alias("_c"))
    return n.join(c, F.col("unit") == F.col("_u"), "left").select("unit", "leaves", "scheduled", "truncated", ((F.col("leaves") == F.col("scheduled")) & (F.col("truncated") == 0) & F.coalesce("_c", F.lit(False))).alias("complete"))


def swept(rules: list[Rule], done: set[str]) -> int:
    """How many rules finished without a gap in schedule order."""
    order = [r.id for r in sorted(rules, key=schedule_key)]
    return next((i for i, r in enumerate(order) if r not in done), len(order))


def diagnose(units: DataFrame, rules: list[Rule], unit: str, rule_id: str, seconds: float = 60.0, unit_col: str = "unit") -> DataFrame:
    """One (unit, rule) pair with a long budget."""
    return match_python(units.where(F.col(unit_col).cast("string") == unit), [r for r in rules if r.id == rule_id], seconds, unit_col)


PIN = T.StructType([T.StructField("what", T.StringType()), T.StructField("want", T.StringType()), T.StructField("got", T.StringType())])


def pins(spark: SparkSession, wanted: dict[str, str], got: dict[str, str]) -> DataFrame:
    """(what, want, got, agrees): pinned figures against what was read. A figure with any disagreement is out of reach."""
    rows = [(k, str(v), None if got.get(k) is None else str(got[k])) for k, v in wanted.items()]
    return spark.createDataFrame(rows, PIN).withColumn("agrees", F.coalesce(F.col("want") == F.col("got"), F.lit(False)))


def rights_gate(rules: DataFrame, locked: DataFrame, excluded: tuple[str, ...] = rights.NEVER) -> DataFrame:
    """(problem, source, n): empty if every source has its locked count and no withheld path ships."""
    have = rules.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("restricted") & (rights.under(F.col("source_path"), excluded) != "")).alias("bad"))
    met = have.join(locked.select("source", "record_count"), "source", "full_outer")
    count = met.where("n IS NULL OR record_count IS NULL OR n <> record_count").select(F.lit("count").alias("problem"), "source", F.coalesce("n", F.lit(0)).alias("n"))
    return count.unionByName(met.where("bad > 0").select(F.lit("withheld_path").alias("problem"), "source", F.col("bad").alias("n")))


def provenance(rows: DataFrame, columns: list[str], marker: str | None = None) -> DataFrame:
    """(metric, key, n): values of columns, nulls of each, rows with a marker, repeated rows."""
    out = rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("metric"), F.lit("").alias("key"), "n")
    for c in columns:
        out = out.unionByName(rows.groupBy(F.lit("value:" + c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("key")).agg(F.count("*").alias("n")))
    if marker:
        flags = [F.count_if(F.col(c).cast("string").contains(marker)).alias(c) for c in columns]
        wide = rows.agg(*flags)
        out = out.unionByName(wide.select(F.explode(F.array(*[F.struct(F.lit("marker").alias("metric"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*"))
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("k")).where("k > 1").agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("n"))
    return out.unionByName(repeated.select(F.lit("repeated").alias("metric"), F.lit("").alias("key"), "n"))


def differing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def scenario_counts(rules: DataFrame) -> DataFrame:
    """One row of counts over rules (kind, examples, scenarios, hits): what could be tested and what matched."""
    n = F.size("examples")
    return rules.agg(
        F.count("*").alias("rules"), F.count_if(F.size("scenarios") > 0).alias("with_scenarios"), F.sum(F.greatest(F.size("scenarios"), F.lit(0))).alias("scenarios_not_evaluated"), F.count_if(n > 0).alias("with_examples"), F.count_if(n <= 0).alias("without_examples"),
        F.count_if((n > 0) & (F.col("kind") == "NONE")).alias("not_runnable"), F.count_if((n > 0) & (F.col("kind") != "NONE") & (F.col("hits") > 0)).alias("reachable"), F.count_if((n > 0) & (F.col("kind") != "NONE") & (F.col("hits") == 0)).alias("unreachable"),
    )
