"""Queries: probes, digests, leaf boundaries, rights, pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.model import Rule, rules_table
from gatemeter.operators import audit, lookups
from gatemeter.plans.rulebook import RULES, RUNNABLE, quote, sql_predicate, sql_rules
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


def _sql_probes(texts: tuple[str, ...], rules: list[Rule]) -> str:
    """(rule_id, probe_no) of the probe texts that rules accept, for DuckDB."""
    shown = ", ".join(f"({i}, {quote(t)})" for i, t in enumerate(texts))
    return " UNION ALL ".join(f"SELECT {quote(r.id)} AS rule_id, probe_no FROM (VALUES {shown}) AS p(probe_no, text) WHERE {sql_predicate(r)}" for r in rules)


BLANK = [*RUNNABLE, Rule("w:blank", "REGEX", (r"^[\s]+$",)), Rule("w:any", "REGEX", ("[^a-z0-9]",))]
WIDE = [*RUNNABLE, Rule("w:letters", "REGEX", ("[a-z]{3}",)), Rule("w:sign", "REGEX", ("[.,;:]",))]


@query("content_free_rules", f"SELECT rule_id, min(probe_no) AS probe_no FROM ({_sql_probes(audit.CONTENT_FREE, BLANK)}) GROUP BY rule_id")
def content_free_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on whitespace."""
    return audit.content_free(spark, BLANK)


@query("breadth_classes", f"""SELECT r.rule_id, CASE WHEN count(p.probe_no) > 0 THEN 'BROAD' ELSE 'MEDIUM' END AS breadth, coalesce(string_agg(p.probe_no::VARCHAR, ',' ORDER BY p.probe_no), '') AS probes
FROM (VALUES {", ".join(f"({quote(r.id)})" for r in WIDE)}) AS r(rule_id) LEFT JOIN ({_sql_probes(audit.COMMON, WIDE)}) AS p ON p.rule_id = r.rule_id GROUP BY r.rule_id""")
def breadth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by whether they accept common texts."""
    return audit.breadth(spark, WIDE).withColumn("probes", F.array_join("probes", ","))


@query("rule_digests", """SELECT 'n:' || n_nationkey AS rule_id, sha256('{"bindings":[],"breadth":"NARROW","case_sensitive":' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"examples":["' || n_name || ' é"],"extra":{},"id":"n:' || n_nationkey ||
'","kind":"SUBSTRING_ANY","lineage":[],"not_runnable_reason":null,"patterns":["' || n_name || '","\\"q\\""],"restricted":false,"source":"own","source_id":"","source_path":"","surface":"OUT","title":""}') AS digest FROM nation""")
def rule_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rules made of the nations; their lane doesn't count."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a table of a fixed size
    return audit.digests(spark, [Rule(f"n:{k}", "SUBSTRING_ANY", (name, '"q"'), source="own", case_sensitive=k % 2 == 0, examples=(f"{name} é",), lane="ADVISE" if k % 3 == 0 else "RECORD") for k, name in named])


BOUNDARY = [Rule("b:start", "REGEX", ("^[A-Z][a-z]+",), case_sensitive=True), Rule("b:end", "REGEX", ("[.]$",), case_sensitive=True), Rule("b:plain", "REGEX", ("token",), case_sensitive=True)]
_lines = "list_bool_or(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{}')))"


@query("boundary_summary", f"""WITH h AS (SELECT regexp_matches(t, '^[A-Z][a-z]+') AS s, regexp_matches(t, '[.](\\n)?$') AS e, contains(t, 'token') AS p, regexp_matches(t, '[A-Z][a-z]+') AS rs, contains(t, '.') AS re,
list_bool_or(list_transform(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[A-Z][a-z]+'))) AS ls, list_bool_or(list_transform(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.]$'))) AS le FROM (SELECT coalesce(text, '') AS t FROM documents))
SELECT count(*) FILTER (s OR e OR p) AS joined, count(*) FILTER (s OR e OR p OR ls OR le) AS by_line, count(*) FILTER (rs OR re OR p) AS relaxed FROM h""")
def boundary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are hit as joined texts, line by line, and without assertions."""
    return audit.boundary_summary(audit.boundary_hits(table(spark, sf_dir, "documents"), BOUNDARY))


@query("construct_census", f"""SELECT c AS construct, count(DISTINCT id) AS rules FROM (SELECT id, CASE WHEN starts_with(p, '^') THEN 'caret' WHEN ends_with(p, '$') THEN 'dollar' END AS c
FROM (VALUES {", ".join(f"({quote(r.id)}, {quote(p)})" for r in BOUNDARY for p in r.patterns)}) AS v(id, p)) WHERE c IS NOT NULL GROUP BY c""")
def construct_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.construct_census(spark, BOUNDARY)


@query("longest_shared_run", r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark),
t AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w), m AS (SELECT a.item_id, a.i, b.i - a.i AS d FROM t a JOIN t b ON b.item_id = a.item_id + 1 AND a.w = b.w),
r AS (SELECT item_id, d, i - row_number() OVER (PARTITION BY item_id, d ORDER BY i) AS g FROM m), l AS (SELECT item_id, count(*) AS n FROM r GROUP BY item_id, d, g)
SELECT w.item_id, CAST(coalesce((SELECT max(n) FROM l WHERE l.item_id = w.item_id), 0) AS INTEGER) AS length FROM w WHERE w.item_id + 1 IN (SELECT item_id FROM w)""")
def longest_shared_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words that benchmark items share with their successors by id."""
    items = table(spark, sf_dir, "benchmark")
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(nxt, "item_id").select("item_id", audit.longest_run("text", "other")["length"].alias("length"))


@query("parity_audit", "SELECT 'p:short' AS rule_id, item_id::INTEGER AS text_no, false AS composed, true AS original FROM benchmark WHERE NOT regexp_matches(text, '(?i)tion[,.]') AND regexp_matches(text, '(?i)e[,.]')")
def parity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed rules against their conditions on every benchmark item: only the one that lacks a condition may differ."""
    from gatemeter.sources.yamlrules import predicate

    conditions = ["(?i)[A-Z]{3}", "tion[,.]", "[0-9]+"]
    rules, originals = [], {}
    for name, logic, given, own in (("p:any", "any", conditions, conditions), ("p:all", "all", conditions, conditions), ("p:short", "any", ["tion[,.]"], ["tion[,.]", "e[,.]"])):
        kind, patterns, _ = predicate({"condition": logic, "conditions": [{"field": "content", "operator": "regex", "value": c} for c in given]}, None, False)
        rules.append(Rule(name, kind, tuple(patterns)))
        originals[name] = (logic, own)
    texts = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.lit(r.id) for r in rules])).alias("rule_id"), F.col("item_id").cast("int").alias("text_no"), "text")
    return audit.parity(rules, originals, texts)


@query("rights_gate", f"""WITH have AS (SELECT source, count(*) AS n FROM {sql_rules()} GROUP BY source), want AS (SELECT 'own' AS source, (SELECT n FROM have WHERE source = 'own') AS k UNION ALL VALUES ('other', 9), ('gone', 1))
SELECT 'count' AS problem, want.source, coalesce(have.n, 0) AS n FROM want LEFT JOIN have ON have.source = want.source WHERE coalesce(have.n, 0) <> want.k""")
def rights_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose records don't agree with the lock."""
    own = len([r for r in RULES if r.source == "own"])
    locked = spark.createDataFrame([("own", own), ("other", 9), ("gone", 1)], "source string, record_count long")
    return audit.rights_gate(rules_table(spark, list(RULES)), locked)


@query("provenance", """SELECT 'rows' AS metric, '' AS key, count(*) AS n FROM documents UNION ALL SELECT 'value:lang', coalesce(lang, '(null)'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'value:source', coalesce(source, '(null)'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'marker', 'lang', count(*) FILTER (contains(lang, 'src1')) FROM documents UNION ALL SELECT 'marker', 'source', count(*) FILTER (contains(source, 'src1')) FROM documents
UNION ALL SELECT 'repeated', '', CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM documents GROUP BY lang, source HAVING count(*) > 1)""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.provenance(table(spark, sf_dir, "documents"), ["lang", "source"], "src1")


@query("mixed_procedure", "SELECT CASE role WHEN 'user' THEN 'PROMPT' ELSE 'OUT' END AS surface, count(*) FILTER (role <> 'system') AS whole, count(*) FILTER (role = 'system') AS leafwise, count(*) FILTER (role <> 'system') > 0 AND count(*) FILTER (role = 'system') > 0 AS mixed FROM conversations GROUP BY 1")
def mixed_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return audit.mixed_procedure(turns.select(F.when(F.col("role") == "user", "PROMPT").otherwise("OUT").alias("surface"), F.when(F.col("role") == "system", F.array("text")).alias("parts")))


@query("differing_keys", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def differing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two tables has."""
    return audit.differing_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("pin_checks", "SELECT * FROM (VALUES ('rules', '11', '11', true), ('revision', 'a', 'b', false), ('digest', 'x', NULL, false)) AS v(what, want, got, agrees)")
def pin_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pins(spark, {"rules": "11", "revision": "a", "digest": "x"}, {"rules": str(len(RULES)), "revision": "b"})


@query("allowance_scan", """WITH b AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size, coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id::VARCHAR AS unit, count(*) AS leaves, count(*) FILTER (before < 2000) AS scheduled, count(*) FILTER (before < 2000 AND before + size > 2000) AS truncated, bool_and(before + size <= 2000 AND before < 2000) AS complete FROM b GROUP BY 1""")
def allowance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations scanned turn by turn under an allowance, with their coverage."""
    leaves = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("unit"), F.col("turn").cast("int").alias("leaf_no"), "text")
    found = audit.scan_leaves(leaves, list(RUNNABLE), 2000, 30.0)
    return audit.leaf_coverage(leaves, found, 2000)


@query("round_calls", "SELECT o_orderpriority AS provider, count(*) AS calls, count(DISTINCT o_orderkey) AS rounds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def round_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with their calls: a plain equi-join of two Parquet tables by key."""
    rounds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_pk"), F.col("o_orderpriority").alias("provider"))
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("round_pk")).agg(F.count("*").alias("calls"))
    return rounds.join(calls, "round_pk").groupBy("provider").agg(F.sum("calls").alias("calls"), F.count("*").alias("rounds"))


@query("units_by_digest", "SELECT sha256(text) AS sha256, min(doc_id) AS id, arg_min(lang, doc_id) AS lang, count(*) AS occurrences FROM documents WHERE text IS NOT NULL GROUP BY 1")
def units_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First units by content with their occurrences."""
    units = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("id"), "lang")
    return lookups.first_by_digest(units)
