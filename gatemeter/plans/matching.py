"""Queries: rules against documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.functions import text as text_functions
from gatemeter.functions.screen import screen_pattern
from gatemeter.model import Rule
from gatemeter.operators import match, measure
from gatemeter.plans.rulebook import IDS, RULES, RUNNABLE, quote, sql_findings, sql_predicate
from gatemeter.session import spread, table

QUERIES: dict = {}
ORACLES: dict = {}
LABELS = {"lang": "lang", "source": "source"}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def matched(spark: SparkSession, sf_dir: str, name: str = "documents", text: str = "text") -> DataFrame:
    return match.match_native(spread(table(spark, sf_dir, name)), list(RUNNABLE), text)


@query("rule_doc_findings", sql_findings())
def rule_doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, rule) that matches."""
    # a plain explode would make the planner filter on the size of the array first, and match twice
    return matched(spark, sf_dir).select("doc_id", F.explode_outer("rule_ids").alias("rule_id")).where("rule_id IS NOT NULL")


def _one(rule_id: str):
    rule = next(r for r in RULES if r.id == rule_id)
    name = rule.kind.lower()

    @query(name, f"SELECT doc_id, coalesce({sql_predicate(rule)}, false) AS fired FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(match.predicate(rule, F.col("text")), F.lit(False)).alias("fired"))


for _id in ("own:any", "own:all", "own:both", "own:either"):
    _one(_id)


@query("first_match_span", "SELECT doc_id, strpos(lower(text), 'token') - 1 AS \"start\", strpos(lower(text), 'token') + 4 AS \"end\" FROM documents WHERE contains(lower(text), 'token')")
def first_match_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-point span of the first occurrence of a needle."""
    start, end = match.first_span("token", F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", start.cast("long").alias("start"), end.cast("long").alias("end")).where("start IS NOT NULL")


def _sql_span(rule: Rule) -> str:
    """Start and end of the rule's span as a struct, for DuckDB; null where it doesn't match."""
    parts = []
    for p in rule.patterns:
        if rule.kind.startswith("SUBSTRING"):
            parts.append(f"CASE WHEN contains(lower(text), {quote(p.lower())}) THEN {{'start': strpos(lower(text), {quote(p.lower())}) - 1, 'end': strpos(lower(text), {quote(p.lower())}) + {len(p) - 1}}} END")
        else:
            full = quote(p if rule.case_sensitive else "(?i)" + p)
            parts.append(f"CASE WHEN regexp_matches(text, {full}) THEN {{'start': strpos(text, regexp_extract(text, {full})) - 1, 'end': strpos(text, regexp_extract(text, {full})) - 1 + length(regexp_extract(text, {full}))}} END")
    if rule.kind.endswith("_ALL"):
        return f"CASE WHEN {' AND '.join(f'({x}) IS NOT NULL' for x in parts)} THEN {parts[0]} END"
    return f"list_min(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))" if rule.kind == "REGEX_ANY" else f"coalesce({', '.join(parts)})"


_spans = " UNION ALL ".join(f"SELECT doc_id, {quote(r.id)} AS rule_id, {quote(r.surface)} AS surface, {_sql_span(r)} AS s FROM documents" for r in RUNNABLE)


@query("python_regex_spans", f"""SELECT doc_id::VARCHAR AS unit, 0 AS leaf_no, rule_id, surface, s."start" AS "start", s."end" AS "end" FROM ({_spans}) WHERE s IS NOT NULL""")
def python_regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with spans by Python's own regular expressions, each pair under a deadline."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("leaf_no", F.lit(0))
    return match.findings(match.match_python(docs, list(RUNNABLE), 1.0, "doc_id"))


@query("deadline_scan")
def deadline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that backtracks without end is stopped and reported; other pairs go on."""
    rules = [Rule("own:slow", "REGEX", ("(a|aa)+$",)), Rule("own:word", "REGEX", ("word",))]
    leaves = spark.createDataFrame([("u1", 0, "a" * 64 + "b"), ("u2", 0, "a word")], "unit string, leaf_no int, text string")
    return match.coverage(match.match_python(leaves, rules, 0.1))


@query("coverage_by_document", f"SELECT CAST(doc_id AS VARCHAR) AS unit, 1::BIGINT AS leaves, {len(RUNNABLE)}::BIGINT AS pairs_scheduled, {len(RUNNABLE)}::BIGINT AS pairs_finished, true AS complete FROM documents")
def coverage_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document was scanned by which pairs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("leaf_no", F.lit(0))
    return match.coverage(match.match_python(docs, list(RUNNABLE), 30.0, "doc_id"))


@query("page_script_hits", "SELECT page_id, contains(lower(html), '<script') AS has_script, regexp_matches(html, '(?i)<img[ >]') AS has_image FROM pages")
def page_script_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("p:script", "SUBSTRING_ANY", ("<script",)), Rule("p:image", "REGEX", ("<img[ >]",))]
    return table(spark, sf_dir, "pages").select("page_id", match.predicate(rules[0], F.col("html")).alias("has_script"), match.predicate(rules[1], F.col("html")).alias("has_image"))


@query("utf16_length", "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS units, length(text)::BIGINT AS points, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def utf16_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.utf16_length(F.col("text")).alias("units"), F.length("text").cast("long").alias("points"), F.octet_length("text").cast("long").alias("bytes"))


@query("code_ranges", """WITH t AS (SELECT doc_id, length(regexp_replace(text, '[`|"\n]', ' ', 'g')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n + 1 AS INTEGER) AS "start", CAST(2 * n + 12 AS INTEGER) AS "end" FROM t UNION ALL SELECT doc_id, CAST(2 * n + 12 AS INTEGER), CAST(2 * n + 18 AS INTEGER) FROM t
UNION ALL SELECT doc_id, CAST(3 * n + 21 AS INTEGER), CAST(3 * n + 26 AS INTEGER) FROM t UNION ALL SELECT doc_id, CAST(3 * n + 28 AS INTEGER), CAST(4 * n + 32 AS INTEGER) FROM t""")
def code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of code in texts made of every document: a fence, a span in a line, a quoted cell, an open fence."""
    t = F.regexp_replace("text", '[`|"\n]', " ")
    made = F.concat(t, F.lit("\n```py\n"), t, F.lit("\n```\n`code` "), t, F.lit('\n|"cel"|\n```'), t, F.lit("\n"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", made.alias("made"))
    return docs.select("doc_id", F.explode(text_functions.code_ranges_of("made")).alias("r")).select("doc_id", "r.start", "r.end")


@query("base64_blocks", """WITH t AS (SELECT doc_id, regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', 'x', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, b.i::INTEGER AS block_no, substring(t, 1, 100000) AS block FROM t, (VALUES (0), (1)) AS b(i)
WHERE length(regexp_replace(base64(encode(t)), '=', '', 'g')) >= 32 AND length(t) >= 10 AND len(regexp_extract_all(t, '[ -~]')) > 0.7 * length(t)""")
def base64_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts hidden in base64 runs: every document, encoded twice within other text."""
    hidden = F.regexp_replace(F.base64(F.encode(F.regexp_replace("text", "[\\x{10000}-\\x{10FFFF}]", "x"), "UTF-8")), "[\r\n]", "")
    made = F.concat(F.lit("see "), hidden, F.lit(" and\n"), hidden, F.lit("."))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", made.alias("made"))
    return docs.select("doc_id", F.posexplode(text_functions.decoded_blocks_of("made")).alias("block_no", "block"))


#: what stands under a repeat, whether it branches; repeats with their bounds (-1: none)
ATOMS = (("ab", False), ("[a-c]", False), ("ab|cd", True), ("(?:ab)", False))
REPEATS = (("", 1, 1), ("?", 0, 1), ("*", 0, -1), ("+", 1, -1), ("{2}", 2, 2), ("{1}", 1, 1), ("{0,3}", 0, 3), ("{1,2}?", 1, 2))
TIMINGS = ("NULL", "false", "true")
_repeats = ", ".join(f"({quote(q)}, {low}, {high})" for q, low, high in REPEATS)


@query("screen_patterns", f"""SELECT '(?:' || a.p || i.q || ')' || o.q AS pattern, t.slow, CASE WHEN t.slow THEN 'measured_slow' WHEN t.slow IS NULL AND many AND (i.high > 1 OR i.high = -1 OR i.low <> i.high) THEN 'nested_quantifier'
WHEN t.slow IS NULL AND many AND a.branches THEN 'alternation_under_repetition' END AS refusal FROM (VALUES {", ".join(f"({quote(p)}, {str(b).lower()})" for p, b in ATOMS)}) AS a(p, branches),
(VALUES {_repeats}) AS i(q, low, high), (SELECT *, high > 1 OR high = -1 AS many FROM (VALUES {_repeats}) AS x(q, low, high)) AS o, (VALUES (NULL::BOOLEAN), (false), (true)) AS t(slow)
UNION ALL SELECT p, s, r FROM (VALUES ('(a)\\1', NULL::BOOLEAN, 'backreference'), ('(', NULL, 'pattern_does_not_parse'), (repeat('y', 5000), NULL, 'pattern_too_long')) AS v(p, s, r)""")
def screen_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why patterns may not run: every two repeats within one another over some atoms, with and without a timing."""
    rows = [(f"(?:{a}{i}){o}", slow) for a, _ in ATOMS for i, *_ in REPEATS for o, *_ in REPEATS for slow in (None, False, True)]
    rows += [(r"(a)\1", None), ("(", None), ("y" * 5000, None)]
    return spark.createDataFrame(rows, "pattern string, slow boolean").select("pattern", "slow", screen_pattern("pattern", "slow").alias("refusal"))


_any, _all = ("licen[sc]e", "copyright"), ("token", "[0-9a-f]{8,}")
_channel = f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[`|"\n]', ' ', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', 'x', 'g') AS t FROM documents),
m AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN concat('```', chr(10), t, chr(10), '```') ELSE concat('see ', base64(encode(t)), '.') END AS made, doc_id % 3 = 1 AS code,
doc_id % 3 = 2 AND length(regexp_replace(base64(encode(t)), '=', '', 'g')) >= 32 AND length(t) >= 10 AND len(regexp_extract_all(t, '[ -~]')) > 0.7 * length(t) AS hidden FROM t),
r AS (SELECT doc_id, length(made) <= 100000 AS complete, CASE WHEN code THEN NULL WHEN regexp_matches(made, '(?i){_any[0]}') THEN 0 WHEN regexp_matches(made, '(?i){_any[1]}') THEN 1 END AS any_doc, CASE WHEN NOT hidden THEN NULL WHEN regexp_matches(t, '(?i){_any[0]}') THEN 0 WHEN regexp_matches(t, '(?i){_any[1]}') THEN 1 END AS any_block,
CASE WHEN regexp_matches(made, '(?i){_all[0]}') AND regexp_matches(made, '(?i){_all[1]}') THEN 0 END AS all_doc, CASE WHEN hidden AND regexp_matches(t, '(?i){_all[0]}') AND regexp_matches(t, '(?i){_all[1]}') THEN 0 END AS all_block FROM m),
f AS (SELECT doc_id, 'd:any' AS rule_id, coalesce(any_doc, any_block) AS i, CASE WHEN any_doc IS NULL THEN 'base64' ELSE 'document' END AS origin FROM r WHERE complete AND coalesce(any_doc, any_block) IS NOT NULL
UNION ALL SELECT doc_id, 'd:all', coalesce(all_doc, all_block), CASE WHEN all_doc IS NULL THEN 'base64' ELSE 'document' END FROM r WHERE complete AND coalesce(all_doc, all_block) IS NOT NULL)
SELECT doc_id::VARCHAR AS unit, rule_id, i::INTEGER AS condition_index, origin, true AS complete FROM f UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, complete FROM r WHERE doc_id NOT IN (SELECT doc_id FROM f)"""


@query("document_channel", _channel)
def document_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some as code and some hidden in base64, against the rules that are bound to documents.

    Matches in code don't count for the first rule; a document of over 100,000 units is unfinished.
    """
    from gatemeter.model import Binding

    rules = [
        Rule("d:any", "REGEX", (_any[0],), surface="CFG", bindings=(Binding("CFG", True, "any", _any, True),)),
        Rule("d:all", "REGEX_ALL", _all, surface="CFG", bindings=(Binding("CFG", True, "all", _all),)),
    ]
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), '[`|"\n]', " "), "[\\x{10000}-\\x{10FFFF}]", "x")
    hidden = F.concat(F.lit("see "), F.regexp_replace(F.base64(F.encode(t, "UTF-8")), "[\r\n]", ""), F.lit("."))
    made = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(hidden)
    return match.scan_documents(spread(table(spark, sf_dir, "documents")).select("doc_id", made.alias("text")), rules, 30.0)


@query("channel_bindings", "SELECT * FROM (VALUES ('d:any', 'CFG', 'any', 2::BIGINT), ('d:all', 'CFG', 'all', 2::BIGINT)) AS v(rule_id, channel, logic, n_conditions)")
def channel_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with an executable binding, one row a binding."""
    from gatemeter.model import Binding, rules_table

    rules = [
        Rule("d:any", "REGEX", ("x",), surface="CFG", bindings=(Binding("CFG", True, "any", ("licen[sc]e", "copyright"), True),)),
        Rule("d:all", "REGEX", ("x",), surface="CFG", bindings=(Binding("CFG", True, "all", ("token", "[0-9a-f]{8,}")), Binding("CFG", False, "any", ("no",)))),
        Rule("d:none", "REGEX", ("x",), surface="CFG", bindings=(Binding("CFG", True, "any", ()),)),
    ]
    inner = rules_table(spark, rules).select(F.col("id").alias("rule_id"), F.inline("bindings"))
    return inner.where("eligible AND size(conditions) > 0").select("rule_id", "channel", "logic", F.size("conditions").cast("long").alias("n_conditions"))


_strata = "['all', 'lang=' || coalesce(lang, 'none'), 'source=' || coalesce(source, 'none'), 'lang=' || coalesce(lang, 'none') || '&source=' || coalesce(source, 'none')]"
_fired = " OR ".join(sql_predicate(r) for r in RUNNABLE)
_stratum_hits = f"""
WITH f AS ({sql_findings()}), u AS (SELECT doc_id, unnest({_strata}) AS stratum FROM documents), n AS (SELECT stratum, count(*) AS trials FROM u GROUP BY 1),
h AS (SELECT f.rule_id, u.stratum, count(*) AS hits FROM f JOIN u USING (doc_id) GROUP BY 1, 2), r AS (SELECT unnest([{", ".join(map(quote, IDS))}]) AS rule_id)
SELECT r.rule_id, n.stratum, n.trials, coalesce(h.hits, 0) AS hits FROM r CROSS JOIN n LEFT JOIN h ON h.rule_id = r.rule_id AND h.stratum = n.stratum"""
_bundle = f"SELECT stratum, count(*) AS trials, count(*) FILTER (fired) AS hits FROM (SELECT coalesce({_fired}, false) AS fired, unnest({_strata}) AS stratum FROM documents) GROUP BY stratum"


@query("rule_stratum_hits", _stratum_hits)
def rule_stratum_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and hits of each rule in each stratum, rows of no hits included, from one pass."""
    return measure.rule_hits(matched(spark, sf_dir), list(IDS), LABELS)


@query("bundle_union", _bundle)
def bundle_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and documents with any hit, by stratum."""
    return measure.bundle_hits(matched(spark, sf_dir), LABELS)


@query("strata_counts", """SELECT CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'all' WHEN grouping(source) = 1 THEN 'lang=' || lang WHEN grouping(lang) = 1 THEN 'source=' || source ELSE 'lang=' || lang || '&source=' || source END AS stratum,
count(*) AS trials FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials by stratum as grouping sets."""
    table(spark, sf_dir, "documents").select("lang", "source").createOrReplaceTempView("_strata_docs")
    return spark.sql("""
        SELECT CASE grouping_id(lang, source) WHEN 3 THEN 'all' WHEN 1 THEN concat('lang=', lang) WHEN 2 THEN concat('source=', source) ELSE concat('lang=', lang, '&source=', source) END AS stratum, count(*) AS trials
        FROM _strata_docs GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
