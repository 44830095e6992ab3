"""Joins by key: pins, origins, aliases, timings, calls and results, trees of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatemeter.functions.screen import fingerprint


def pinned(units: DataFrame, pins: DataFrame, key: str = "id", digest: str = "sha256") -> DataFrame:
    """(key, status) of all pins: present, mismatched or missing."""
    a, b = pins.select(key, F.col(digest).alias("_want")), units.select(key, F.col(digest).alias("_got"))
    return a.join(b, key, "left").select(key, F.when(F.col("_got").isNull(), "missing").when(F.col("_got") == F.col("_want"), "present").otherwise("mismatched").alias("status"))


def origins(copies: DataFrame, known: DataFrame) -> DataFrame:
    """(id, status, origin_id): conversions matched to the one record that they name.

    `copies` (id, candidates: array of ids), `known` (id). No candidate: none; several
    candidates or several records: ambiguous; no record: origin_missing.
    """
    each = copies.select("id", F.size("candidates").alias("n"), F.explode_outer(F.array_distinct("candidates")).alias("want"))
    met = each.join(known.select(F.col("id").alias("origin")), F.col("want") == F.col("origin"), "left")
    one = met.groupBy("id").agg(F.max("n").alias("n"), F.count("origin").alias("found"), F.min("origin").alias("origin_id"))
    status = F.when(F.col("n") <= 0, "none").when((F.col("n") > 1) | (F.col("found") > 1), "ambiguous").when(F.col("found") == 0, "origin_missing").otherwise("matched")
    return one.select("id", status.alias("status"), F.when(status == "matched", F.col("origin_id")).alias("origin_id"))


def without_copies(rules: DataFrame) -> DataFrame:
    """Rules (id, duplicate_of, ...) without the copies whose origin is there."""
    ids = rules.select(F.col("id").alias("_present"))
    return rules.join(ids, F.col("duplicate_of") == F.col("_present"), "left_anti")


def aliases(cases: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, status, rule_id): scenarios linked by alias to exactly one rule.

    `cases` (case_id, aliases: array), `names` (rule_id, alias).
    """
    each = names.groupBy("alias").agg(F.min("rule_id").alias("least"), F.max("rule_id").alias("most"))  # a row an alias, however many rules bear it
    met = cases.select("case_id", F.explode_outer("aliases").alias("alias")).join(each, "alias", "left")
    one = met.groupBy("case_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    linked = F.col("least") == F.col("most")
    status = F.when(F.col("least").isNull(), "unmatched").when(linked, "linked").otherwise("ambiguous")
    return one.select("case_id", status.alias("status"), F.when(linked, F.col("least")).alias("rule_id"))


def timed(patterns: DataFrame, timings: DataFrame) -> DataFrame:
    """The patterns (rule_id, pattern) with fingerprint and recorded verdict (slow, fast, or null)."""
    table = timings.select(F.col("fingerprint").alias("_fp"), "verdict")
    return patterns.withColumn("fingerprint", fingerprint(F.col("pattern"))).join(table, F.col("fingerprint") == F.col("_fp"), "left").drop("_fp")


def untimed(patterns: DataFrame, timings: DataFrame) -> DataFrame:
    """(pattern, rule_ids): distinct patterns without a timing and the rules that hold them."""
    own = patterns.withColumn("fingerprint", fingerprint(F.col("pattern")))
    return own.join(timings.select("fingerprint"), "fingerprint", "left_anti").groupBy("pattern").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def timing_table(*sweeps: DataFrame) -> DataFrame:
    """One verdict per fingerprint of all sweeps: slow wins, then the earliest crossing."""
    both = sweeps[0]
    for s in sweeps[1:]:
        both = both.unionByName(s)
    order = F.struct((F.col("verdict") == "slow").alias("slow"), (-F.coalesce(F.col("crossing_bytes"), F.lit(1 << 62))).alias("soon"))
    return both.where("verdict IN ('slow', 'fast') AND (verdict = 'fast' OR (crossing_bytes IS NOT NULL AND wall_s IS NOT NULL))").groupBy("fingerprint").agg(
        F.max_by(F.struct("verdict", "crossing_bytes", "wall_s", "over_60s"), order).alias("x")
    ).select("fingerprint", "x.*")


def calls_and_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session, call_id, status) of all keys: paired, ambiguous, call_only, result_only, nontext.

    The first record of a key counts; a different one under the same key makes it ambiguous.
    `calls` (session, call_id, body), `results` (session, call_id, text; null if not text).
    """
    a = calls.groupBy("session", "call_id").agg(F.countDistinct("body").alias("bodies"))
    b = results.groupBy("session", "call_id").agg(F.countDistinct(F.coalesce(F.sha2("text", 256), F.lit(""))).alias("texts"), F.count_if(F.col("text").isNull()).alias("no_text"))
    status = (
        F.when(F.col("bodies").isNull(), "result_only").when(F.col("texts").isNull(), "call_only").when((F.col("bodies") > 1) | (F.col("texts") > 1), "ambiguous")
        .when(F.col("no_text") > 0, "nontext").otherwise("paired")
    )
    return a.join(b, ["session", "call_id"], "full_outer").select("session", "call_id", status.alias("status"))


def overlapping(a: DataFrame, b: DataFrame, key: str = "sha256") -> bool:
    """Whether two corpora share a unit: such reports may not be added up."""
    return not a.select(key).intersect(b.select(key)).isEmpty()


def inside(start: Column, ranges: Column) -> Column:
    """Whether a position lies in any half-open range."""
    return F.exists(ranges, lambda r: (r["start"] <= start) & (start < r["end"]))


def tree_references(docs: DataFrame, keys: tuple[str, ...], doc_col: str = "doc", json_col: str = "json", root: str = "$") -> DataFrame:
    """(doc, pointer, ref): strings (or strings of arrays) under these keys at any depth.

    The tree is opened level by level by a recursive query on variants; a tree of more than 64 levels
    is an error.
    """
    docs.select(F.col(doc_col).alias("doc"), F.try_parse_json(F.col(json_col)).alias("v")).createOrReplaceTempView("_trees")
    names = ", ".join(f"'{k}'" for k in keys)
    return docs.sparkSession.sql(f"""
        WITH RECURSIVE walk(doc, depth, pointer, own, holder, v) AS (
          SELECT doc, 0, '', CAST(NULL AS STRING), '', v FROM _trees WHERE v IS NOT NULL
          UNION ALL
          SELECT w.doc, w.depth + 1, concat(w.pointer, '/', coalesce(replace(replace(e.key, '~', '~0'), '/', '~1'), CAST(e.pos AS STRING))),
                 coalesce(e.key, w.own), CASE WHEN e.key IS NULL THEN w.holder ELSE w.pointer END, e.value
          FROM walk w, LATERAL variant_explode(IF(w.depth <= 64, w.v, raise_error('a tree of more than 64 levels'))) e)
        SELECT doc, holder AS pointer, try_variant_get(v, '$', 'string') AS ref FROM walk
        WHERE own IN ({names}) AND schema_of_variant(v) = 'STRING'""").distinct()


def first_by_digest(units: DataFrame, digest: str = "sha256", order: str = "id") -> DataFrame:
    """The first unit of each digest with `occurrences`."""
    rest = [c for c in units.columns if c != digest]
    best = units.groupBy(digest).agg(F.min_by(F.struct(*rest), order).alias("x"), F.count("*").alias("occurrences"))
    return best.select(digest, "x.*", "occurrences")


def ranked(hits: DataFrame, n: int) -> DataFrame:
    """The n rules of most hits, ties by id."""
    return hits.orderBy(F.desc("hits"), "rule_id").limit(n)


def running_share(hits: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("hits"), "rule_id")  # a row for each rule
    return hits.select("rule_id", "hits", F.sum("hits").over(w).alias("upto"))
