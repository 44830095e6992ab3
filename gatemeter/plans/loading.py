"""Queries: corpora and catalogues written as files from the tables, and read by their loaders.

Files lie in the folder that the cluster shares. One file a row is written only for tables of
a fixed size (nation); all else is JSON lines of whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatemeter.model import rules_table
from gatemeter.operators import events, lookups
from gatemeter.operators.match import match_native
from gatemeter.plans.living import LANES, RULES as EVENT_RULES, payloads
from gatemeter.plans.rulebook import RULES, quote, sql_predicate, sql_rules
from gatemeter.session import fresh_folder, spread, table
from gatemeter.sources import boolyaml, bundles, catalogs, corpora, yamlrules
from gatemeter.streaming import monitor

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _case(key: str, *values: str) -> str:
    """The value that stands at key modulo their number; the same text in Spark and DuckDB."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _one_file(rows: DataFrame, value: Column, field: str = "rules") -> str:
    """The folder of one JSON file {field: [values]} of a small table."""
    path = fresh_folder(rows.sparkSession)
    rows.agg(F.collect_list(value).alias(field)).coalesce(1).write.json(path)
    return path


# --- traffic and transcripts


@query("snapshot_units", "SELECT doc_id::VARCHAR AS id, CASE WHEN text IS NOT NULL THEN length(text) % 2 = 0 END AS sound, 1 + doc_id % 3 AS occurrences, length(text) AS n_chars FROM documents")
def snapshot_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a traffic snapshot; digests of texts of odd length are wrong."""
    path = fresh_folder(spark)
    said = F.when(F.length("text") % 2 == 0, F.sha2("text", 256)).otherwise("other")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", said.alias("sha256"), F.expr("nullif(1 + doc_id % 3, 1)").alias("occurrences"))
    rows.write.json(path)
    return corpora.snapshot(spark, path).select("id", "sound", "occurrences", F.length("text").cast("long").alias("n_chars"))


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as transcript lines: a user's turn calls a tool, the assistant's next one is its result."""
    path = fresh_folder(spark)
    user = F.col("role") == "user"
    use = F.struct(F.lit("tool_use").alias("type"), F.col("turn").cast("string").alias("id"), F.expr(_case("conv_id", "'WebFetch'", "'Own'")).alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), (F.col("turn") - 1).cast("string").alias("tool_use_id"), F.col("text").alias("content"), (F.col("turn") % 3 == 0).alias("is_error"))
    blocks = F.when(user, F.to_json(F.struct(F.array(use).alias("content")))).otherwise(F.to_json(F.struct(F.array(result).alias("content"))))
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    rows.select(F.concat(F.lit('{"sessionId": "'), F.col("conv_id").cast("string"), F.lit('", "message": '), blocks, F.lit("}"))).write.text(path)
    return corpora.transcripts(spark, path)


_pairs = """WITH b AS (SELECT conv_id, turn, count(DISTINCT coalesce('t' || text, '')) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, count(DISTINCT coalesce('t' || text, '')) AS n, count(*) FILTER (text IS NULL) AS bad, any_value(text) AS text, bool_or(turn % 3 = 0) AS err FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn - 1),
p AS (SELECT conv_id::VARCHAR AS session, turn::VARCHAR AS call_id, conv_id, r.text, err, CASE WHEN b.n IS NULL THEN 'result_only' WHEN r.n IS NULL THEN 'call_only' WHEN b.n > 1 OR r.n > 1 THEN 'ambiguous' WHEN r.bad > 0 THEN 'nontext' ELSE 'paired' END AS status FROM b FULL JOIN r USING (conv_id, turn)) """


@query("transcript_pairs", _pairs + "SELECT session, call_id, status FROM p")
def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results read back from transcripts, by how they pair."""
    return lookups.calls_and_results(*_transcripts(spark, sf_dir))


@query("transcript_units", _pairs + f"SELECT sha256(session || ':' || call_id) AS id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes, {_case('conv_id', quote('WebFetch'), quote('Own'))} AS tool, {_case('conv_id', quote('attacker-reachable'), quote('mixed-or-unknown'))} AS exposure, CASE WHEN err THEN 'error' ELSE 'ok' END AS result_status FROM p WHERE status = 'paired'")
def transcript_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurable units of paired calls and results."""
    units = corpora.traffic_units(*_transcripts(spark, sf_dir))
    return units.select("id", "sha256", "size_bytes", "strata.tool", "strata.exposure", "strata.result_status")


# --- bundles


@query("bundle_records", f"SELECT 'nation:' || n_nationkey AS id, {_case('n_regionkey', quote('IN'), quote('OUT'), quote('PROMPT'))} AS surface, {_case('n_nationkey', quote('REGEX'), quote('SUBSTRING_ANY'), quote('REGEX_ALL'), quote('NONE'))} AS kind, 'RECORD' AS lane, CASE WHEN n_nationkey % 4 < 3 THEN n_name END AS pattern FROM nation")
def bundle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a bundle, decoded; the lane that they claim is dropped."""
    predicate = F.when(F.col("n_nationkey") % 4 == 0, F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2)).when(F.col("n_nationkey") % 4 == 1, F.to_json(F.array("n_name"))).when(F.col("n_nationkey") % 4 == 2, F.to_json(F.struct(F.array("n_name").alias("regex_all"))))
    record = F.struct(
        F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.expr(_case("n_regionkey", "'IN'", "'OUT'", "'PROMPT'")).alias("surface"), F.expr(_case("n_nationkey", "'REGEX'", "'SUBSTRING_ANY'", "'STRUCTURED'", "'NONE'")).alias("predicate_kind"),
        F.parse_json(predicate).alias("predicate"), F.lit("DENY").alias("lane"), F.expr(_case("n_nationkey", "NULL", "NULL", "NULL", "'metadata'")).alias("not_runnable_reason"),
    )
    rules, _ = bundles.read(spark, _one_file(table(spark, sf_dir, "nation"), record))
    return rules_table(spark, rules).select("id", "surface", "kind", "lane", F.try_element_at("patterns", F.lit(1)).alias("pattern"))


@query("bundle_export", f"SELECT id, kind, n_patterns FROM {sql_rules()} WHERE kind <> 'NONE' AND surface IN ('OUT', 'PROMPT') AND source = 'own'")
def bundle_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a configuration enables, written as a bundle and read back."""
    path = fresh_folder(spark)
    bundles.export_enabled(spark, path, list(RULES), ["OUT", "PROMPT"], {"own": "RECORD", "other": "DO_NOT_SHIP"})
    return rules_table(spark, bundles.read(spark, path)[0]).select("id", "kind", F.size("patterns").alias("n_patterns"))


_hidden = "concat(coalesce(text, ''), ' ', " + _case("doc_id", *(quote(" ".join(r.patterns).upper()) for r in bundles.starter()), quote(bundles.starter()[0].patterns[0])) + ")"


@query("starter_findings", " UNION ALL ".join(f"SELECT doc_id, {quote(r.id)} AS rule_id FROM (SELECT doc_id, {_hidden} AS made FROM documents) WHERE {sql_predicate(r, 'made')}" for r in bundles.starter()))
def starter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starter rules over documents that hold their words, all of them or the first alone."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.expr(_hidden.replace("''", r"\'").replace("coalesce(text, \\')", "coalesce(text, '')")).alias("made"))
    return match_native(docs, bundles.starter(), "made").select("doc_id", F.explode_outer("rule_ids").alias("rule_id")).where("rule_id IS NOT NULL")


@query("trimmed_rules", " UNION ALL ".join(f"SELECT {quote(r.id)} AS id, 0 AS examples, " + ("concat_ws(',', " + ", ".join(f"sha256({quote(x)})" for x in r.examples) + ")" if r.examples else "''") + " AS digests" for r in RULES))
def trimmed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without sample texts, with the digests of their examples."""
    rows = [(r.id, len(r.examples), ",".join(r.extra["examples_sha256"])) for r in map(bundles.trimmed, RULES)]
    return spark.createDataFrame(rows, "id string, examples int, digests string")


# --- catalogues

_audit_id = "concat(" + _case("n_nationkey", "'AAK-RUGPULL-'", "'AAK-COMPOSE-'", "'AAK-'") + ", n_nationkey)"
_audit = f"""SELECT {_audit_id} AS source_id, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'PIN' ELSE 'CFG' END AS surface, CASE WHEN n_nationkey % 3 = 1 THEN 'BROAD' WHEN n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 THEN 'NARROW' ELSE 'MEDIUM' END AS breadth,
CASE WHEN n_nationkey % 2 = 0 THEN concat('CVE-', n_nationkey) ELSE '' END AS refs, {_case('n_regionkey', quote('high'), quote('low'))} AS severity, concat('c', n_regionkey) AS tag FROM nation"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(
        F.expr(_audit_id).alias("rule_id"), F.col("n_name").alias("title"), F.expr(_case("n_regionkey", "'high'", "'low'")).alias("severity"), F.concat(F.lit("c"), "n_regionkey").alias("category"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("CVE-"), "n_nationkey"))).alias("cve_references"),
    )
    return catalogs.audit_registry(spark, _one_file(table(spark, sf_dir, "nation"), item))


@query("audit_catalogue", f"SELECT source_id, title, surface, breadth, refs FROM ({_audit})")
def audit_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as an audit registry's rules."""
    return _registry(spark, sf_dir).select("source_id", "title", "surface", "breadth", F.array_join("references", ",").alias("refs"))


@query("catalogue_census", f"WITH a AS ({_audit}) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS key, count(*) AS n FROM a GROUP BY 2" for c in ("severity", "surface", "breadth", "tag")))
def catalogue_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.census(_registry(spark, sf_dir))


@query("generated_catalogue", f"SELECT concat('g', n_nationkey) AS source_id, n_name AS title, CASE n_nationkey % 3 WHEN 0 THEN 'OUT' WHEN 1 THEN 'CFG' ELSE 'NONE' END AS surface, 'MEDIUM' AS breadth, concat('T', n_regionkey) AS refs FROM nation")
def generated_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a generated registry's rules."""
    k = F.col("n_nationkey") % 3
    item = F.struct(
        F.concat(F.lit("g"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.when(k == 0, "output").otherwise("other").alias("family"), F.when(k == 1, "artifact").alias("target_kind"), F.lit("build").alias("surface"),
        F.array(F.struct(F.concat(F.lit("T"), "n_regionkey").alias("reference"))).alias("taxonomy"),
    )
    rows = catalogs.generated_registry(spark, _one_file(table(spark, sf_dir, "nation"), item))
    return rows.select("source_id", "title", "surface", "breadth", F.array_join("references", ",").alias("refs"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as records, one file each, and regions as crosswalks that name their nations."""
    top = fresh_folder(spark)
    nations = table(spark, sf_dir, "nation").withColumn("ave_id", F.concat(F.lit("AVE-"), "n_nationkey"))
    nations.select(F.col("n_nationkey").alias("k"), "ave_id", F.col("n_name").alias("title"), F.expr(_case("n_nationkey", "'(a+)+'", "'a+'")).alias("regex")).write.partitionBy("k").json(f"{top}/records")
    walks = nations.groupBy("n_regionkey").agg(F.collect_list("ave_id").alias("ave_ids"), F.min_by("ave_id", "n_nationkey").alias("ave_id"))
    deep = F.struct(F.lit(None).cast("array<string>").alias("ave_ids"), F.array(F.struct("ave_id")).alias("a/b"))
    flat = F.struct(F.col("ave_ids"), F.lit(None).cast("array<struct<ave_id:string>>").alias("a/b"))
    walks.select("n_regionkey", F.array(flat, deep).alias("mappings")).write.partitionBy("n_regionkey").json(f"{top}/crosswalks")
    return catalogs.record_folder(spark, f"{top}/records", f"{top}/crosswalks")


@query("record_crosswalks", "SELECT concat('AVE-', n_nationkey) AS source_id, n_name AS title, CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN '/mappings/0,/mappings/1/a~1b/0' ELSE '/mappings/0' END AS pointers FROM nation")
def record_crosswalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the places of crosswalks that name them."""
    return _records(spark, sf_dir).select("source_id", "title", F.array_join(F.transform("crosswalks", lambda c: c["pointer"]), ",").alias("pointers"))


@query("record_patterns", f"SELECT concat('AVE-', n_nationkey) AS doc, '' AS pointer, {_case('n_nationkey', quote('(a+)+'), quote('a+'))} AS ref, {_case('n_nationkey', quote('nested_quantifier'), 'NULL')} AS refusal FROM nation")
def record_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that records carry, and whether they may run."""
    return catalogs.pattern_refusals(_records(spark, sf_dir))


# --- YAML corpora

_yaml = """id: R-%s
status: %s
tags: {category: tool-poisoning, scan_target: tool_response}
detection:
  condition: %s
  conditions:
    - {field: tool_response, operator: regex, value: '%s'}
    - {field: tool_response, operator: regex, value: 'marker'}
test_cases: {true_positives: [marker %s]}
%s"""


def _yaml_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as YAML rules, one file each; some are drafts, hazards, or repeat a key."""
    path = fresh_folder(spark)
    status, logic, pattern, more = (F.expr(_case("n_nationkey", *x)) for x in (("'stable'", "'draft'", "'stable'", "'stable'", "'stable'"), ("'any'", "'any'", "'all'", "'any'", "'any'"), ("'x[0-9]'", "'x[0-9]'", "'x[0-9]'", "'(a+)+'", "'x[0-9]'"), ("''", "''", "''", "''", "'id: again'")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.format_string(_yaml, "n_nationkey", status, logic, pattern, "n_name", more).alias("value"))
    rows.write.partitionBy("k").text(path)
    return yamlrules.load(spark, path, glob="*.txt")


@query("yaml_rules", f"""SELECT CASE WHEN n_nationkey % 5 < 4 THEN concat('R-', n_nationkey) END AS id, {_case('n_nationkey', quote('REGEX'), quote('NONE'), quote('REGEX_ALL'), quote('NONE'), 'NULL')} AS kind, {_case('n_nationkey', quote('(?:x[0-9])|(?:marker)'), quote(''), quote('x[0-9] marker'), quote(''), 'NULL')} AS patterns,
{_case('n_nationkey', quote(''), quote('status:draft'), quote(''), quote('screen:nested_quantifier'), 'NULL')} AS reasons, CASE WHEN n_nationkey % 5 < 4 THEN 'OUT' END AS surface, CASE WHEN n_nationkey % 5 < 4 THEN concat('marker ', n_name) END AS examples, n_nationkey % 5 = 4 AS bad FROM nation""")
def yaml_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _yaml_rules(spark, sf_dir)
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return rows.select("id", "kind", joined("patterns", " "), joined("reasons", ","), "surface", joined("examples", "|"), F.col("error").isNotNull().alias("bad"))


@query("yaml_refusals", "SELECT CASE n_nationkey % 5 WHEN 1 THEN 'status:draft' ELSE 'screen:nested_quantifier' END AS key, count(*) AS n FROM nation WHERE n_nationkey % 5 IN (1, 3) GROUP BY 1")
def yaml_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rules of the corpus don't run."""
    return yamlrules.losses(_yaml_rules(spark, sf_dir)).where("metric = 'refused'").select("key", "n")


_bool = """id: S-%s
title: %s
author: Own
logsource: {product: ai_agent, category: tool_output}
detection:
  a:
    content|%s
  condition: %s"""


def _boolean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as boolean rules, one document each in files of one region's."""
    path = fresh_folder(spark)
    body, said = F.expr(_case("n_nationkey", "'contains: [x, y]'", "'contains|all: [x, y]'", "'re: (a+)+'", "'contains: x*'", "'contains: x'")), F.expr(_case("n_nationkey", "'a'", "'a'", "'a'", "'a'", "'not a'"))
    docs = table(spark, sf_dir, "nation").select("n_regionkey", F.format_string(_bool, "n_nationkey", "n_name", body, said).alias("doc"))
    files = docs.groupBy("n_regionkey").agg(F.array_join(F.collect_list("doc"), "\n---\n").alias("value"))
    files.write.partitionBy("n_regionkey").text(path)
    return boolyaml.load(spark, path, glob="*.txt")


_bool_reason = _case("n_nationkey", "''", "''", "'screen_pattern_rejection'", "'boolean_tree_requires_structured_runtime,wildcard_value'", "'boolean_tree_requires_structured_runtime'")


@query("boolean_corpus", f"SELECT concat('S-', n_nationkey) AS id, n_name AS title, {_case('n_nationkey', quote('SUBSTRING_ANY'), quote('SUBSTRING_ALL'), quote('NONE'), quote('NONE'), quote('NONE'))} AS kind, {_case('n_nationkey', quote('x|y'), quote('x|y'), quote(''), quote(''), quote(''))} AS patterns, 'OUT' AS surface, {_bool_reason} AS reasons FROM nation")
def boolean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean rules read from files of several documents."""
    return _boolean_corpus(spark, sf_dir).select("id", "title", "kind", F.array_join("patterns", "|").alias("patterns"), "surface", F.array_join("reasons", ",").alias("reasons"))


@query("boolean_refusals", f"SELECT reason, count(*) AS n, count(*) FILTER (len(rs) = 1) AS alone FROM (SELECT unnest(rs) AS reason, rs FROM (SELECT string_split({_bool_reason}, ',') AS rs FROM nation)) WHERE reason <> '' GROUP BY 1")
def boolean_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolyaml.refusals(_boolean_corpus(spark, sf_dir))


@query("boolean_census", """SELECT c AS construct, count(*) AS n FROM (SELECT unnest(['selection:dict', 'field:content', CASE WHEN n_nationkey % 5 < 2 THEN 'value:list' ELSE 'value:str' END, CASE n_nationkey % 5 WHEN 1 THEN 'modifiers:contains|all' WHEN 2 THEN 'modifiers:re' ELSE 'modifiers:contains' END,
CASE WHEN n_nationkey % 5 = 4 THEN 'condition:not' END]) AS c FROM nation) WHERE c IS NOT NULL GROUP BY 1""")
def boolean_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, modifiers, value types and condition words of the corpus."""
    return boolyaml.census(_boolean_corpus(spark, sf_dir))


# --- corpora on disk


@query("manifest_units", f"""SELECT n_name AS id, {_case('n_nationkey', 'concat(n_name, chr(10))', 'concat(n_name, chr(10))', 'NULL', 'concat(n_name, chr(10))')} AS text, 'CFG' AS surface, concat('r', n_regionkey) AS region, {_case('n_nationkey', 'NULL', quote('digest'), quote('missing'), 'NULL')} AS problem FROM nation""")
def manifest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a manifest: nations' files, some with a wrong digest, some not there."""
    root = fresh_folder(spark)
    nations = table(spark, sf_dir, "nation")
    nations.select("n_name", F.col("n_name").alias("value")).write.partitionBy("n_name").text(f"{root}/units")
    name = F.regexp_extract("path", "n_name=([^/]*)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/units").select(name.alias("n_name"), corpora.relative(F.col("path"), root).alias("path"), F.sha2("content", 256).alias("sha256"))
    k = F.col("n_nationkey") % 4
    unit = F.struct(F.col("n_name").alias("id"), F.when(k == 2, "units/none.txt").otherwise(F.col("path")).alias("path"), F.when(k == 1, "0").otherwise(F.col("sha256")).alias("sha256"), F.create_map(F.lit("region"), F.concat(F.lit("r"), "n_regionkey")).alias("strata"))
    manifest = nations.join(files, "n_name").agg(F.collect_list(unit).alias("units")).select(F.lit("c").alias("identity"), F.lit("CFG").alias("surface"), "units")
    manifest.coalesce(1).write.json(f"{root}/said")
    rows = corpora.manifest_corpus(spark, root, "said")
    return rows.select("id", "text", "surface", F.col("strata")["region"].alias("region"), "problem")


@query("prose_texts", "SELECT DISTINCT sha256(r_name || chr(10)) AS sha256, r_name || chr(10) AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def prose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of a folder of prose; nations of one region say the same."""
    path = fresh_folder(spark)
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    both.select("n_nationkey", F.col("r_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    return corpora.prose_folder(spark, path).select("sha256", "text")


_lock_problem = _case("n_nationkey", "NULL", "'repo_url'", "'commit'", "'archive_sha256'", "'fetched_at'", "'license'", "'record_count'")


@query("lock_entries", f"SELECT lower(n_name) AS name, {_lock_problem} AS problem FROM nation")
def lock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a lock file with the first thing that is wrong."""
    k = F.col("n_nationkey") % 7
    entry = F.struct(
        F.lower("n_name").alias("name"), F.when(k == 1, "http://x").otherwise("https://x").alias("repo_url"), F.when(k == 2, "main").otherwise(F.sha1("n_name")).alias("commit"), F.when(k == 3, "0").otherwise(F.sha2("n_name", 256)).alias("archive_sha256"),
        F.when(k == 4, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00Z").alias("fetched_at"), F.when(k == 5, "").otherwise("MIT").alias("license"), F.when(k == 6, -1).otherwise(F.col("n_nationkey")).alias("record_count"),
    )
    path = fresh_folder(spark)
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(entry))).coalesce(1).write.text(path)
    return corpora.locks(spark, path).select("name", "problem")


@query("record_counts", """WITH h AS (SELECT source, count(*) AS records, count(DISTINCT lang) AS files, count(*) - count(DISTINCT n_chars) AS duplicates FROM documents WHERE source IS NOT NULL GROUP BY 1), w AS (SELECT source, max(k) AS declared FROM (SELECT 'src' || n_nationkey AS source, 100 AS k FROM nation) GROUP BY 1)
SELECT source, records, files, duplicates, declared::BIGINT AS declared, coalesce(records = declared, false) AS agrees FROM h FULL JOIN w USING (source)""")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source against declared counts; a length seen before counts as a duplicate."""
    records = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", F.col("n_chars").alias("id"), F.col("lang").alias("path"))
    declared = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("source"), F.lit(100).cast("long").alias("record_count"))
    return corpora.record_census(records, declared)


_member = "concat(coalesce(lang, 'x'), '/', coalesce(source, 'x'), '/', " + _case("doc_id", "'SKILL.md'", "'a.agent.md'", "'Readme.RST'", "concat('d', doc_id, '.TXT')", "'Makefile'", "'.hidden'") + ")"


@query("archive_members", f"SELECT concat(coalesce(lang, 'x'), '/', coalesce(source, 'x')) AS folder, {_case('doc_id', quote('SKILL.md'), quote('.agent.md'), quote('README'), quote('.txt'), quote('no_extension'), quote('no_extension'))} AS extension, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1, 2")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive counted by folder and type, unread."""
    return corpora.archive_census(table(spark, sf_dir, "documents").select(F.expr(_member).alias("path"), F.col("n_chars").alias("size")))


@query("labelled_units", "SELECT concat('s', min(doc_id)) AS sample_id, arg_min(toxic, doc_id) = 1 AS attack, arg_min(length(text), doc_id) AS n_chars FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY lower(left(text, 200))")
def labelled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as samples of a published corpus, told apart by their beginning."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row"), "text", "toxic")
    return corpora.labelled_samples(rows, "text", "toxic", "1").select("sample_id", "attack", F.length("text").cast("long").alias("n_chars"))


@query("timing_sweep", """SELECT substr(sha256(p_type || p_brand), 1, 16) AS fingerprint, CASE WHEN count(*) FILTER (p_size > 40) > 0 THEN 'slow' ELSE 'fast' END AS verdict, min(p_partkey) FILTER (p_size > 40) AS crossing_bytes FROM part GROUP BY p_type || p_brand""")
def timing_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of patterns from a sweep's lines; slow wins, and the earliest crossing stays."""
    path = fresh_folder(spark)
    slow = F.col("p_size") > 40
    lines = table(spark, sf_dir, "part").select(F.concat("p_type", "p_brand").alias("pattern"), F.when(slow, "slow").otherwise("fast").alias("verdict"), F.when(slow, F.col("p_partkey")).alias("crossing_bytes"), F.when(slow, F.col("p_retailprice")).alias("wall_s"))
    lines.write.json(path)
    return lookups.timing_table(corpora.sweep(spark, path)).select("fingerprint", "verdict", "crossing_bytes")


@query("stored_report", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's rows, stored as CSV and read again."""
    path = fresh_folder(spark)
    corpora.write_report(table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("lang string, source string, n bigint").csv(path)


# --- streams

_text = "coalesce(text, '')"
_rules = {
    "e:deny": f"doc_id % 2 = 0 AND contains(lower({_text}), 'la') AND contains(lower({_text}), 'token')", "e:advise": f"doc_id % 2 = 0 AND regexp_matches({_text}, '(?i)copyright')",
    "e:call": f"doc_id % 2 = 1 AND contains(lower({_text}), 'the')", "e:note": f"doc_id % 2 = 1 AND regexp_matches({_text}, '[0-9]{{4}}')",
}


@query("stream_findings_log", " UNION ALL ".join(f"SELECT sha256(text) AS text_sha256, {quote(r)} AS rule_id FROM documents WHERE {p}" for r, p in _rules.items()))
def stream_findings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of events, decided and logged; the rules that the log names."""
    top = fresh_folder(spark)
    spread(payloads(spark, sf_dir)).write.json(f"{top}/events")
    stream = monitor.event_stream(spark, f"{top}/events", "event_id string, payload string")
    config = events.Config(limits=events.Limits(seconds=30.0))
    monitor.append_log(monitor.decide_stream(stream, EVENT_RULES, LANES, config), f"{top}/log", f"{top}/state").awaitTermination()
    log = spark.read.schema("value string").text(f"{top}/log")
    return log.select(F.inline(F.from_json("value", "array<struct<rule_id:string,text_sha256:string>>"))).where("rule_id IS NOT NULL")
