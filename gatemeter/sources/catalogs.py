"""JSON catalogues without predicates: two registries and a folder of records with crosswalks.

Rows come back in one shape; rules of a catalogue never run, they say why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatemeter.functions import classify
from gatemeter.functions.screen import screen_pattern
from gatemeter.operators.lookups import tree_references

AUDIT_REFERENCES = ("adversa_references", "aicm_references", "cve_references", "incident_references", "owasp_agentic_references", "owasp_ast_references", "owasp_mcp_references")
TAXONOMIES = ("owasp_asi", "owasp_mcp", "nist_ai_rmf", "mitre_atlas")
PATTERN_KEYS = ("pattern", "patterns", "regex", "regexes")


def texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, json) of whole files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def strict(docs: DataFrame) -> DataFrame:
    """The documents as variants in `v`; text that isn't a JSON object, or repeats a key, is an error."""
    v = F.parse_json("json")  # repeated keys raise
    kind = F.schema_of_variant(v)
    return docs.withColumn("v", F.when(kind.startswith("OBJECT"), v).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), "path"))))


def checked(rows: DataFrame, id_col: str = "source_id") -> DataFrame:
    """The rows, or an error if ids are missing or repeat. Catalogues are small."""
    bad = rows.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col(id_col) == "") | (F.col("n") > 1))
    found = bad.limit(5).collect()
    if found:
        raise ValueError("ids are missing or repeat: " + ", ".join(str(r[id_col]) for r in found))
    return rows


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _list(v: Column, path: str) -> Column:
    one = F.try_variant_get(v, path, "string")
    many = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def _items(docs: DataFrame) -> DataFrame:
    return strict(docs).select("path", F.explode(F.try_variant_get("v", "$.rules", "array<variant>")).alias("v"))


def audit_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry keyed by rule_id: (source_id, title, description, severity, tag, surface, breadth, references, reason)."""
    v, key = F.col("v"), _text(F.col("v"), "$.rule_id")
    refs = F.flatten(F.array(*[_list(v, f"$.{c}") for c in AUDIT_REFERENCES]))
    rows = _items(texts(spark, path)).select(
        key.alias("source_id"), _text(v, "$.title").alias("title"), _text(v, "$.description").alias("description"), _text(v, "$.severity").alias("severity"), _text(v, "$.category").alias("tag"),
        classify.audit_surface(key).alias("surface"), classify.audit_breadth(key, F.size(_list(v, "$.cve_references"))).alias("breadth"), refs.alias("references"),
        F.lit("the registry holds metadata; scanner conditions are not in it").alias("reason"), v.cast("string").alias("raw"),
    )
    return checked(rows)


def generated_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a generated registry keyed by id, in the same shape."""
    v = F.col("v")
    taxonomy = F.transform(F.coalesce(F.try_variant_get(v, "$.taxonomy", "array<variant>"), F.array().cast("array<variant>")), lambda t: F.coalesce(F.try_variant_get(t, "$.reference", "string"), F.lit("")))
    rows = _items(texts(spark, path)).select(
        _text(v, "$.id").alias("source_id"), _text(v, "$.title").alias("title"), F.lit("").alias("description"), _text(v, "$.severity").alias("severity"), _text(v, "$.family").alias("tag"),
        classify.generated_surface(_text(v, "$.target_kind"), _text(v, "$.surface"), _text(v, "$.family")).alias("surface"), F.lit("MEDIUM").alias("breadth"), taxonomy.alias("references"),
        F.lit("generated metadata only; evaluators have no expectations here").alias("reason"), v.cast("string").alias("raw"),
    )
    return checked(rows)


def record_folder(spark: SparkSession, records: str, crosswalks: str | None = None) -> DataFrame:
    """Rows of a folder of records keyed by ave_id, with the crosswalk entries that name each.

    Entries are found at any depth of the crosswalks' trees; a record without any has none.
    """
    v = F.col("v")
    refs = F.flatten(F.array(*[_list(v, f"$.{c}") for c in TAXONOMIES]))
    rows = checked(
        strict(texts(spark, records)).select(
            _text(v, "$.ave_id").alias("source_id"), _text(v, "$.title").alias("title"), _text(v, "$.description").alias("description"), _text(v, "$.severity").alias("severity"),
            F.array_join(_list(v, "$.behavioral_vector"), ",").alias("tag"), F.lit("NONE").alias("surface"), F.lit("BROAD").alias("breadth"), refs.alias("references"),
            F.lit("a behavioural class; examples are no signatures").alias("reason"), v.cast("string").alias("raw"),
        )
    )
    if crosswalks is None:
        return rows.withColumn("crosswalks", F.array().cast("array<struct<doc:string,pointer:string>>"))
    found = tree_references(texts(spark, crosswalks), ("ave_id", "ave_ids", "primary_ave_id"), "path")
    entries = found.groupBy(F.col("ref").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("doc", "pointer"))).alias("crosswalks"))
    return rows.join(entries, F.col("source_id") == F.col("_id"), "left").drop("_id").withColumn("crosswalks", F.coalesce("crosswalks", F.array().cast("array<struct<doc:string,pointer:string>>")))


def pattern_refusals(rows: DataFrame, keys: tuple[str, ...] = PATTERN_KEYS) -> DataFrame:
    """(doc, pointer, ref, refusal): strings under pattern-like keys and whether they may run. A report only."""
    return tree_references(rows, keys, "source_id", "raw").withColumn("refusal", screen_pattern("ref", F.lit(None).cast("boolean")))


def census(rows: DataFrame) -> DataFrame:
    """(metric, key, n) of a catalogue: severity, surface, breadth, tag."""
    out = None
    for c in ("severity", "surface", "breadth", "tag"):
        part = rows.groupBy(F.lit(c).alias("metric"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
