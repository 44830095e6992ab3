"""Queries: rule tables, selections, lookups and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.functions import classify, rights, text as text_functions
from gatemeter.functions.boolrules import column, mapped
from gatemeter.functions.screen import screen_pattern
from gatemeter.model import lane_rank, rules_table
from gatemeter.operators import admission, lookups, measure
from gatemeter.plans.matching import matched
from gatemeter.plans.rulebook import IDS, RULES, RUNNABLE, quote, sql_findings, sql_rules
from gatemeter.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({names})")


@query("active_rules", f"SELECT id, surface, CASE source WHEN 'own' THEN 'ADVISE' ELSE 'RECORD' END AS requested FROM {sql_rules()} WHERE kind <> 'NONE' AND surface IN ('IN', 'OUT')")
def active_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a configuration enables."""
    return admission.active_rules(rules_table(spark, list(RULES)), ["IN", "OUT"], {"own": "ADVISE", "other": "RECORD"}).select("id", "surface", "requested")


@query("status_counts", f"SELECT surface, lane, count(*) AS rules FROM {sql_rules()} GROUP BY surface, lane")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_table(spark, list(RULES)).groupBy("surface", "lane").agg(F.count("*").alias("rules"))


@query("drop_reason_cascade", f"""SELECT id, CASE WHEN surface NOT IN ('IN', 'OUT') THEN 'surface' WHEN kind = 'NONE' THEN 'not_runnable' WHEN restricted OR source_path LIKE 'data/private/%' THEN 'not_shippable'
WHEN 100 * (SELECT count(*) FROM ({sql_findings()}) f WHERE f.rule_id = id) > 3 * (SELECT count(*) FROM documents) THEN 'measured_loud' ELSE 'keep' END AS reason FROM {sql_rules()}""")
def drop_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each rule is left out of a bundle, the first reason only."""
    hits = measure.rule_hits(matched(spark, sf_dir), list(IDS), {}).select(F.col("rule_id").alias("id"), F.expr("100 * hits > 3 * trials").alias("loud"))
    rows = rules_table(spark, list(RULES)).join(hits, "id", "left")
    first = F.try_element_at(F.col("patterns"), F.lit(1))
    refused = F.when(F.col("kind").startswith("REGEX"), screen_pattern(first, F.lit(False)))
    ships = rights.shippable(F.col("restricted"), rights.under(rights.plain_path(F.col("source_path")), ("data/private/",)))
    return rows.select("id", rights.drop_reason(F.col("surface"), F.col("kind") != "NONE", ships, F.col("loud"), refused, F.lit(False)).alias("reason"))


@query("schedule_rank", f"SELECT id, row_number() OVER (ORDER BY class, CASE class WHEN 0 THEN n_patterns WHEN 1 THEN n_chars + 32 * (length(patterns) - length(translate(patterns, '*+?{{|(', ''))) ELSE n_chars END, CASE class WHEN 0 THEN n_chars ELSE 0 END, id) AS rank FROM {sql_rules()} WHERE kind <> 'NONE'")
def schedule_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which rules run: cheapest first."""
    from pyspark.sql import Window

    n, chars = F.size("patterns"), F.expr("aggregate(patterns, 0, (s, p) -> s + length(p))")
    first = F.try_element_at(F.col("patterns"), F.lit(1))
    signs = F.length(first) - F.length(F.translate(first, "*+?{|(", ""))
    kind = F.when(F.col("kind").startswith("SUBSTRING"), 0).when(F.col("kind") == "REGEX", 1).otherwise(2)
    cost = F.when(kind == 0, n).when(kind == 1, chars + 32 * signs).otherwise(chars)
    rows = rules_table(spark, list(RULES)).where("kind <> 'NONE'").select("id", kind.alias("a"), cost.alias("b"), F.when(kind == 0, chars).otherwise(0).alias("c"))
    return rows.select("id", F.row_number().over(Window.orderBy("a", "b", "c", "id")).cast("long").alias("rank"))


_examples = "(VALUES " + ", ".join(f"({quote(r.id)}, {i}, {quote(t)})" for r in RUNNABLE for i, t in enumerate(r.examples)) + ") AS x(rule_id, example_no, text)"


def _example_hits() -> str:
    from gatemeter.plans.rulebook import sql_predicate

    return " UNION ALL ".join(f"SELECT rule_id, example_no FROM {_examples} WHERE rule_id = {quote(r.id)} AND {sql_predicate(r)}" for r in RUNNABLE)


@query("reachability", f"""WITH r AS (SELECT id AS rule_id, kind <> 'NONE' AS runnable FROM {sql_rules()}), n AS (SELECT rule_id, count(*) AS trials FROM {_examples} GROUP BY 1), k AS (SELECT rule_id, count(*) AS hits FROM ({_example_hits()}) GROUP BY 1)
SELECT rule_id, CASE WHEN NOT runnable THEN 'not_runnable' WHEN coalesce(hits, 0) > 0 THEN 'reachable' WHEN coalesce(trials, 0) > 0 THEN 'unreachable' ELSE 'no_examples' END AS status, coalesce(trials, 0) AS trials, coalesce(hits, 0) AS hits
FROM r LEFT JOIN n USING (rule_id) LEFT JOIN k USING (rule_id)""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by whether their own examples match."""
    from gatemeter.operators.match import match_native

    rules = rules_table(spark, list(RULES))
    examples = rules.where("kind <> 'NONE'").select(F.col("id").alias("rule_id"), F.posexplode("examples").alias("example_no", "text"))
    hits = match_native(examples, list(RUNNABLE)).where(F.array_contains("rule_ids", F.col("rule_id")))
    return admission.reachability(examples, hits, rules.select(F.col("id").alias("rule_id"), (F.col("kind") != "NONE").alias("runnable")))


@query("effective_lane", """SELECT id, CASE least(a, b) WHEN 0 THEN 'DO_NOT_SHIP' WHEN 1 THEN 'RECORD' WHEN 2 THEN 'ADVISE' ELSE CASE WHEN denies THEN 'DENY' ELSE 'ADVISE' END END AS lane
FROM (VALUES ('a', 3, 3, true), ('b', 3, 3, false), ('c', 1, 3, true), ('d', 3, 2, true), ('e', 2, 0, true)) AS v(id, a, b, denies)""")
def effective_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "('a', 'DENY', 'DENY', true), ('b', 'DENY', 'DENY', false), ('c', 'RECORD', 'DENY', true), ('d', 'DENY', 'ADVISE', true), ('e', 'ADVISE', 'DO_NOT_SHIP', true)", "id, asked, ceiling, denies")
    return rows.select("id", admission.effective(F.col("asked"), F.col("ceiling"), F.col("denies")).alias("lane"))


@query("promotion", f"SELECT 'own' AS source, count(*) AS rules, count(*) FILTER (lane <> 'RECORD') AS short, count(*) > 0 AND count(*) FILTER (lane <> 'RECORD') = 0 AS allowed FROM {sql_rules()} WHERE source = 'own'")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all rules of a source reach a lane."""
    return admission.promotion(rules_table(spark, list(RULES)), "own", "RECORD")


@query("lane_order", "SELECT * FROM (VALUES ('DO_NOT_SHIP', 0), ('RECORD', 1), ('ADVISE', 2), ('DENY', 3)) AS v(lane, rank)")
def lane_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "('DENY'), ('RECORD'), ('ADVISE'), ('DO_NOT_SHIP')", "lane").select("lane", lane_rank(F.col("lane")).alias("rank"))


_reports = ("('r1', 'aa'), ('r2', 'bb'), ('r3', 'cc')", "('r1', 'aa'), ('r2', 'xx'), ('r4', 'dd')")


@query("report_drift", f"SELECT rule_id, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS status FROM (VALUES {_reports[0]}) a(rule_id, digest) FULL JOIN (VALUES {_reports[1]}) b(rule_id, digest) USING (rule_id)")
def report_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.drift(values(spark, _reports[0], "rule_id, digest"), values(spark, _reports[1], "rule_id, digest"), "rule_id", "digest")


@query("report_join", f"SELECT rule_id, CASE WHEN a.digest IS NULL THEN 'unknown' WHEN b.digest IS NULL THEN 'unmeasured' WHEN a.digest = b.digest THEN 'current' ELSE 'stale' END AS status FROM (VALUES {_reports[0]}) a(rule_id, digest) FULL JOIN (VALUES {_reports[1]}) b(rule_id, digest) USING (rule_id)")
def report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.report_join(values(spark, _reports[0], "rule_id, digest"), values(spark, _reports[1], "rule_id, digest"))


@query("pinned_units", "SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN length(d.text) % 2 = 0 THEN 'present' ELSE 'mismatched' END AS status FROM labels l LEFT JOIN documents d USING (doc_id)")
def pinned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned ids against the corpus; a pin holds a digest (here wrong for odd lengths)."""
    docs = table(spark, sf_dir, "documents")
    units = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    want = F.when(F.length("text") % 2 == 0, F.sha2("text", 256)).otherwise("other")
    pins = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).join(docs.select(F.col("doc_id").alias("id"), want.alias("sha256")), "id", "left")
    return lookups.pinned(units, pins)


@query("pinned_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pinned_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("pinned_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pinned_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("origin_dedup", """WITH c AS (SELECT * FROM (VALUES ('c1', ['o1']), ('c2', ['o9']), ('c3', ['o1', 'o2']), ('c4', []::VARCHAR[]), ('c5', ['o3'])) AS v(id, candidates)), k AS (SELECT * FROM (VALUES ('o1'), ('o2'), ('o3'), ('o3')) AS v(id)),
m AS (SELECT c.id, len(candidates) AS n, count(k.id) AS found, min(k.id) AS origin FROM c LEFT JOIN k ON list_contains(c.candidates, k.id) GROUP BY c.id, n)
SELECT id, CASE WHEN n = 0 THEN 'none' WHEN n > 1 OR found > 1 THEN 'ambiguous' WHEN found = 0 THEN 'origin_missing' ELSE 'matched' END AS status, CASE WHEN n = 1 AND found = 1 THEN origin END AS origin_id FROM m""")
def origin_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = spark.createDataFrame([("c1", ["o1"]), ("c2", ["o9"]), ("c3", ["o1", "o2"]), ("c4", []), ("c5", ["o3"])], "id string, candidates array<string>")
    return lookups.origins(copies, values(spark, "('o1'), ('o2'), ('o3'), ('o3')", "id"))


@query("without_copies", "SELECT p_partkey AS id, copy AS duplicate_of FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 2 WHEN 1 THEN -1 END AS copy FROM part) WHERE copy IS NULL OR copy NOT IN (SELECT p_partkey FROM part)")
def without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules, some said to be copies of others that may not be there."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN p_partkey * 2 WHEN 1 THEN -1 END").alias("duplicate_of"))
    return lookups.without_copies(rows)


@query("alias_linkage", """WITH a AS (SELECT c_custkey, unnest(['NATION_' || c_nationkey, 'NATION_' || (c_nationkey + c_custkey % 3)]) AS alias FROM customer UNION ALL SELECT -1 - n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE NULL END FROM nation),
k AS (SELECT c_custkey, count(DISTINCT s_suppkey % 7) AS n, min(s_suppkey % 7) AS r FROM a LEFT JOIN supplier ON 'NATION_' || s_nationkey = alias GROUP BY 1)
SELECT c_custkey AS case_id, CASE n WHEN 0 THEN 'unmatched' WHEN 1 THEN 'linked' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN r END AS rule_id FROM k""")
def alias_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations as scenarios, linked by alias to suppliers' rules."""
    name = lambda c: F.concat(F.lit("NATION_"), c)
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.array(name(F.col("c_nationkey")), name(F.col("c_nationkey") + F.col("c_custkey") % 3)).alias("aliases"))
    more = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey").cast("long")).alias("case_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return lookups.aliases(cases.unionByName(more), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("rule_id"), name(F.col("s_nationkey")).alias("alias")))


@query("timing_join", """SELECT rule_id, pattern, substr(sha256(pattern), 1, 16) AS fingerprint, CASE pattern WHEN 'a+' THEN 'slow' WHEN 'b' THEN 'fast' END AS verdict FROM (VALUES ('r1', 'a+'), ('r2', 'b'), ('r2', 'c')) AS v(rule_id, pattern)""")
def timing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with their recorded timings; slow wins where sweeps differ."""
    from gatemeter.functions.screen import fingerprint

    rows = "('a+', 'fast', NULL, NULL, false), ('a+', 'slow', 4096L, 1.5D, false), ('b', 'fast', NULL, NULL, false), ('c', 'slow', NULL, NULL, false)"
    sweep = values(spark, rows, "p, verdict, crossing_bytes, wall_s, over_60s").select(fingerprint(F.col("p")).alias("fingerprint"), "verdict", F.col("crossing_bytes").cast("long").alias("crossing_bytes"), F.col("wall_s").cast("double").alias("wall_s"), "over_60s")
    return lookups.timed(values(spark, "('r1', 'a+'), ('r2', 'b'), ('r2', 'c')", "rule_id, pattern"), lookups.timing_table(sweep)).select("rule_id", "pattern", "fingerprint", "verdict")


@query("untimed_patterns", "SELECT p_type || p_size AS pattern, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS rules FROM part WHERE p_type || p_size NOT IN (SELECT p_type || p_size FROM part WHERE p_brand = 'Brand#1') GROUP BY 1")
def untimed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the brands' rules that the first brand's timings don't know."""
    from gatemeter.functions.screen import fingerprint

    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule_id"), F.concat("p_type", "p_size").alias("pattern"))
    known = rows.where("rule_id = 'Brand#1'").select(fingerprint(F.col("pattern")).alias("fingerprint"))
    return lookups.untimed(rows, known).select("pattern", F.array_join("rule_ids", ",").alias("rules"))


@query("call_result_pairing", """WITH c AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' GROUP BY ALL), r AS (SELECT conv_id, turn - 1 AS turn, count(DISTINCT coalesce(sha256(text), '')) AS n, count(*) FILTER (text IS NULL) AS bad FROM conversations WHERE role = 'assistant' GROUP BY ALL),
b AS (SELECT conv_id, turn, count(DISTINCT text) AS n FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT conv_id AS session, turn AS call_id, CASE WHEN b.n IS NULL THEN 'result_only' WHEN r.n IS NULL THEN 'call_only' WHEN b.n > 1 OR r.n > 1 THEN 'ambiguous' WHEN r.bad > 0 THEN 'nontext' ELSE 'paired' END AS status FROM b FULL JOIN r USING (conv_id, turn)""")
def call_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn; what has no partner is counted, not dropped."""
    turns = table(spark, sf_dir, "conversations")
    calls = turns.where("role = 'user'").select(F.col("conv_id").alias("session"), F.col("turn").alias("call_id"), F.col("text").alias("body"))
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("session"), (F.col("turn") - 1).alias("call_id"), "text")
    return lookups.calls_and_results(calls, results)


_tree = """{"mappings": [{"ave_id": "A-1", "note": "x"}, {"group": {"ave_ids": ["A-2", "A-1"], "deep": [{"primary_ave_id": "A-3"}]}}, {"a/b~c": {"ave_id": "A-4"}}]}"""


@query("crosswalk_tree", "SELECT * FROM (VALUES ('d1', '/mappings/0', 'A-1'), ('d1', '/mappings/1/group', 'A-1'), ('d1', '/mappings/1/group', 'A-2'), ('d1', '/mappings/1/group/deep/0', 'A-3'), ('d1', '/mappings/2/a~1b~0c', 'A-4')) AS v(doc, pointer, ref)")
def crosswalk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids declared anywhere in a JSON tree with the pointers of their holders."""
    docs = spark.createDataFrame([("d1", _tree), ("d2", "no json")], "doc string, json string")
    return lookups.tree_references(docs, ("ave_id", "ave_ids", "primary_ave_id"))


@query("exclusion_ranking", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def exclusion_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent reasons to leave a unit out."""
    reason = F.when(F.col("lang") != "en", "language").when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 5000, "long").alias("reason")
    return table(spark, sf_dir, "documents").select(reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query("claim_gap", "SELECT name, round(ours - said, 6) AS gap, abs(ours - said) <= 5 AS agrees, abs(ours - said) > 10 AS severe FROM (VALUES ('a', 70.4, 89.7), ('b', 96.875, 96.9), ('c', 95.49, 0.0), ('d', 20.0, 24.0)) AS v(name, ours, said)".replace("70.4, 89.7", "70.4::DOUBLE, 89.7::DOUBLE"))
def claim_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured figures against published ones: 5 points agree, over 10 are severe."""
    rows = values(spark, "('a', 70.4D, 89.7D), ('b', 96.875D, 96.9D), ('c', 95.49D, 0.0D), ('d', 20.0D, 24.0D)", "name, ours, said")
    gap = F.col("ours") - F.col("said")
    return rows.select("name", F.round(gap, 6).alias("gap"), (F.abs(gap) <= 5).alias("agrees"), (F.abs(gap) > 10).alias("severe"))


@query("binding_gates", "SELECT n::INTEGER AS n, logic, greatest(2, ceil(n * 0.3))::INTEGER AS needed, exempt OR CASE WHEN logic = 'all' THEN n ELSE 1 END >= greatest(2, ceil(n * 0.3)) AS passes FROM (VALUES (1, 'all', false), (3, 'any', false), (3, 'any', true), (10, 'all', false), (20, 'any', false)) AS v(n, logic, exempt)")
def binding_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "(1, 'all', false), (3, 'any', false), (3, 'any', true), (10, 'all', false), (20, 'any', false)", "n, logic, exempt")
    return rows.select("n", "logic", classify.min_conditions(F.col("n")).alias("needed"), classify.skill_gate(F.col("exempt"), F.col("logic"), F.col("n")).alias("passes"))


@query("surface_cascade", "SELECT * FROM (VALUES (1, 'NONE'), (2, 'CFG'), (3, 'IN'), (4, 'PROMPT'), (5, 'IN'), (6, 'OUT'), (7, 'CFG'), (8, 'OUT')) AS v(n, surface)")
def surface_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of a rule from its method, target, fields and category."""
    rows = [
        (1, "trace", "skill", [], None, None), (2, "pattern", "skill", ["user_input"], None, None), (3, "pattern", None, ["tool_name", "tool_args"], None, None), (4, "pattern", None, ["user_input"], None, None),
        (5, "pattern", None, ["content"], "tool_call", None), (6, "pattern", None, ["content", "tool_response"], "tool_call", None), (7, "pattern", None, ["content"], None, "tool-poisoning"), (8, "pattern", None, [], None, None),
    ]
    df = spark.createDataFrame(rows, "n int, method string, target string, fields array<string>, kind string, category string")
    return df.select("n", classify.rule_surface(*map(F.col, ("method", "target", "fields", "kind", "category"))).alias("surface"))


@query("exposure_classes", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'attacker-reachable' WHEN page_id % 6 = 1 THEN 'network-command-mixed' WHEN page_id % 6 = 2 THEN 'file-origin-unknown' WHEN page_id % 6 = 3 THEN 'locally-generated' WHEN page_id % 6 = 4 THEN 'external-tool-unknown' ELSE 'mixed-or-unknown' END AS exposure FROM pages""")
def exposure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls by who may have written their results."""
    k = F.col("page_id") % 6
    tool = F.element_at(F.array(*map(F.lit, ("WebFetch", "Bash", "Bash", "Bash", "mcp__x", "Own"))), (k + 1).cast("int"))
    command = F.when(k == 1, F.concat(F.lit("fetch "), "url")).when(k == 2, "cat notes.txt").when(k == 3, "make all")
    return table(spark, sf_dir, "pages").select("page_id", classify.exposure(tool, command).alias("exposure"))


@query("prose_strata", "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\b(security|vulnerabilit\\w*|malware|prompt injection|penetration|exploit\\w*)\\b') THEN 'security-adjacent' ELSE 'ordinary' END AS prose FROM benchmark")
def prose_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", classify.prose(F.col("text")).alias("prose"))


#: Paths made of documents; the names are those that count as types.
_path = "concat(coalesce(lang, 'x'), '/', CASE doc_id % 7 WHEN 0 THEN 'docs/SKILL.md' WHEN 1 THEN 'b.agent.md' WHEN 2 THEN 'README.rst' WHEN 3 THEN 'src/Attack.PY' WHEN 4 THEN 'Makefile' WHEN 5 THEN '.hidden' ELSE concat(coalesce(source, 'x'), '.d/n', doc_id, '.Tar') END)"


@query("file_types", rf"""SELECT doc_id, CASE WHEN name = 'SKILL.md' THEN name WHEN ends_with(name, '.agent.md') THEN '.agent.md' WHEN starts_with(lower(name), 'readme') THEN 'README' WHEN regexp_matches(name, '^.+\.[^.]+$') THEN lower(regexp_extract(name, '(\.[^.]+)$', 1)) ELSE 'no_extension' END AS file_type,
CASE WHEN contains(lower(name), 'attack') THEN 'security-adjacent' ELSE 'ordinary' END AS prose FROM (SELECT doc_id, string_split({_path}, '/')[-1] AS name FROM documents)""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_path).alias("path")).select("doc_id", classify.file_type(F.col("path")).alias("file_type"), classify.path_prose(F.col("path")).alias("prose"))


_author = "CASE c_custkey % 4 WHEN 0 THEN concat(c_name, ' (corpus ', c_mktsegment, ')') WHEN 1 THEN 'Team' WHEN 2 THEN concat(c_name, ' (', c_mktsegment, ') (y)') END"


@query("lineage_fields", f"SELECT c_custkey, CASE WHEN contains(lower(author), 'corpus') THEN 'corpus_or_benchmark' WHEN author = 'Team' THEN 'project_attribution' ELSE 'other_attribution' END AS classification, coalesce(array_to_string(regexp_extract_all(author, '\\([^()]*\\)'), '|'), '') AS spans FROM (SELECT c_custkey, coalesce({_author}, '') AS author FROM customer)")
def lineage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.expr(_author), F.lit("")).alias("author"))
    found = classify.lineage(F.col("author"), ("Team",))
    return rows.select("c_custkey", found["classification"].alias("classification"), F.array_join(found["spans"], "|").alias("spans"))


@query("origin_ids", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\\.[^/]*/') THEN nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), '') END AS origin FROM pages")
def origin_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id in the path of URLs of allowed hosts."""
    pages = table(spark, sf_dir, "pages")
    host = F.try_parse_url("url", F.lit("HOST"))
    found = F.regexp_extract(F.try_parse_url("url", F.lit("PATH")), "^/([a-z]+)/", 1)
    return pages.select("page_id", F.when(host.startswith("m.") & (found != ""), found).alias("origin"))


@query("reason_groups", "SELECT regexp_replace(source, '[0-9]+(?:\\.[0-9]+)?', '#', 'g') AS reason, count(*) AS n, count(DISTINCT source) AS kinds FROM documents GROUP BY 1")
def reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons grouped with their figures masked."""
    return table(spark, sf_dir, "documents").groupBy(classify.masked(F.col("source")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("kinds"))


@query("json_pointer_escape", "SELECT k, replace(replace(k, '~', '~0'), '/', '~1') AS escaped FROM (VALUES ('a/b'), ('~'), ('~1'), ('plain')) AS v(k)")
def json_pointer_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "('a/b'), ('~'), ('~1'), ('plain')", "k").select("k", text_functions.pointer_escape(F.col("k")).alias("escaped"))


@query("trim_and_key", "SELECT doc_id, lower(left(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)), 200)) AS key FROM documents")
def trim_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key by which samples of a published corpus are told apart."""
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.dedup_key(text_functions.trim_all(F.col("text"))).alias("key"))


@query("paths_by_rights", "SELECT * FROM (VALUES ('data/test-corpora/x', true, 'data/test-corpora/x'), ('rules/a.yaml', false, 'rules/a.yaml'), ('rules\\..\\conformance/y', true, 'conformance/y'), ('tests/fixture', false, 'tests/fixture')) AS v(path, denied, plain)")
def paths_by_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("data/test-corpora/x",), ("rules/a.yaml",), ("rules\\..\\conformance/y",), ("tests/fixture",)], "path string").withColumn("plain", rights.plain_path(F.col("path")))
    return rows.select("path", rights.denied(F.col("plain")).alias("denied"), "plain")


@query("allow_list", "SELECT * FROM (VALUES ('rules/a', NULL, true), ('rules/link', 'data/x', false), ('LICENSE', NULL, true), ('src/b', NULL, false)) AS v(path, target, admitted)")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("rules/a", None), ("rules/link", "data/x"), ("LICENSE", None), ("src/b", None)], "path string, target string")
    return rows.select("path", "target", rights.admitted(F.col("path"), F.col("target"), ("rules/", "src/a"), "LICENSE").alias("admitted"))


DETECTION = {"words": {"content|contains": ["token", "licen"]}, "digits": {"content|re|i": "[0-9a-f]{8,}"}, "filter": {"content|contains|all": ["the", "of"]}, "condition": "(words or digits) and not filter"}


@query("boolean_tree", "SELECT doc_id, ((contains(lower(text), 'token') OR contains(lower(text), 'licen')) OR regexp_matches(text, '(?i)[0-9a-f]{8,}')) AND NOT (contains(lower(text), 'the') AND contains(lower(text), 'of')) AS fired FROM documents WHERE text IS NOT NULL")
def boolean_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean rule run as one column."""
    tree = mapped(DETECTION)[5]
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", column(tree, {"content": F.col("text")}).alias("fired"))


#: Selections with what they say, and conditions over two of them.
_SELECTIONS = {"any": ("content|contains", ["x", "y"], ["z", "w"]), "all": ("content|contains|all", ["x", "y"], ["z", "w"]), "re": ("content|re", "x+", "z+"), "wild": ("content|contains", "x*", "z*"), "two": ("content|contains", "x", "z")}
_CONDITIONS = ("a", "not a", "a or b", "b and a", "1 of them", "all of them", "a and", "not (a or b)", "(a)", "a or c")
_mapping = f"""WITH s AS (SELECT * FROM (VALUES ('any', 'x|y', 'z|w'), ('all', 'x|y', 'z|w'), ('re', 'x+', 'z+'), ('wild', '', ''), ('two', 'x', 'z')) AS v(shape, first, other)), c AS (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in _CONDITIONS)}) AS v(said)),
k AS (SELECT *, CASE WHEN said = 'a and' THEN 'unknown_condition_token:None' WHEN said = 'a or c' THEN 'unknown_condition_token:c' WHEN shape = 'two' AND contains(said, 'b') OR shape = 'two' AND contains(said, 'them') THEN 'multiple_payload_fields' WHEN shape = 'wild' THEN 'wildcard_value' END AS issue,
CASE WHEN said IN ('a', '(a)') THEN CASE shape WHEN 'all' THEN 'SUBSTRING_ALL' WHEN 're' THEN 'REGEX' WHEN 'wild' THEN NULL ELSE 'SUBSTRING_ANY' END
WHEN said IN ('a or b', '1 of them') AND shape IN ('any', 'two') THEN 'SUBSTRING_ANY' WHEN said IN ('b and a', 'all of them') THEN CASE shape WHEN 'all' THEN 'SUBSTRING_ALL' WHEN 'two' THEN 'SUBSTRING_ALL' WHEN 're' THEN 'REGEX_ALL' END END AS flat FROM s, c)
SELECT concat(shape, ':', said) AS name, CASE WHEN issue IS NULL THEN coalesce(flat, 'NONE') ELSE 'NONE' END AS kind, CASE WHEN issue IS NOT NULL OR flat IS NULL THEN '' WHEN said IN ('a', '(a)') THEN first WHEN said = 'b and a' THEN concat(other, '|', first) ELSE concat(first, '|', other) END AS patterns,
concat_ws(',', CASE WHEN flat IS NULL THEN 'boolean_tree_requires_structured_runtime' END, issue) AS issues FROM k"""


@query("boolean_mapping", _mapping)
def boolean_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean rules as flat rules, or the codes for which they are refused: every selection under every condition.

    The second selection of `two` reads another field.
    """
    rows = []
    for shape, (key, first, other) in _SELECTIONS.items():
        for said in _CONDITIONS:
            kind, patterns, _, issues, *_ = mapped({"a": {key: first}, "b": {"command|contains" if shape == "two" else key: other}, "condition": said})
            rows.append((f"{shape}:{said}", kind, "|".join(patterns), ",".join(issues)))
    return spark.createDataFrame(rows, "name string, kind string, patterns string, issues string")
