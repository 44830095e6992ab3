"""Corpora to measure on: manifests, snapshots, transcripts, prose folders, lock files, timing sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatemeter.functions import classify
from gatemeter.functions.screen import fingerprint

UNIT = "id:string,path:string,sha256:string,surface:string,strata:map<string,string>"
PROSE_SUFFIXES = ("md", "txt", "rst", "adoc", "markdown")
MOST_BYTES = 4 << 20


def _files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def utf8(content: Column) -> Column:
    """The text of bytes, null where they aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def relative(path: Column, root: str) -> Column:
    """A file's path below the root folder, whatever the scheme before it."""
    inner = root.rstrip("/").split("://", 1)[-1]
    return F.regexp_replace(path, rf"^.*?\Q{inner}\E/", "")


def manifest_corpus(spark: SparkSession, root: str, name: str = "corpus.json") -> DataFrame:
    """(id, text, surface, strata, sha256, size_bytes, problem) of a manifest's units.

    A unit is sound if its path stays inside, the file is there, its digest is as said, its
    text is UTF-8 and not empty (by its digest: Spark reads no empty files), and its labels are
    plain. Others keep their problem.
    """
    said = spark.read.option("multiLine", True).schema(f"identity string, revision string, surface string, required_strata array<string>, units array<struct<{UNIT}>>").json(f"{root.rstrip('/')}/{name}")
    units = said.select(F.col("surface").alias("_default"), F.explode("units").alias("u")).select("_default", "u.*")
    files = _files(spark, root).select(relative(F.col("path"), root).alias("_file"), "content")
    met = units.join(files, F.col("path") == F.col("_file"), "left")
    text = utf8(F.col("content"))
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("strata", none)
    made = F.create_map(F.lit("file_type"), classify.file_type(F.col("path")), F.lit("prose"), classify.path_prose(F.col("path")))
    strata = F.map_concat(F.map_filter(made, lambda k, v: ~F.map_contains_key(own, k)), own)
    plain = F.forall(F.map_values(strata), lambda v: v.isNotNull() & (v != "") & ~v.rlike("[=&]"))
    problem = (
        F.when(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path_escapes").when(F.col("sha256") == F.sha2(F.lit(""), 256), "empty").when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "digest")
        .when(text.isNull(), "not_utf8").when(~plain, "label")
    )
    return met.select("id", text.alias("text"), F.coalesce("surface", "_default").alias("surface"), strata.alias("strata"), "sha256", F.length("content").cast("long").alias("size_bytes"), problem.alias("problem"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Units of a traffic snapshot (JSON lines), each digest checked again in `sound`."""
    schema = "id string, text string, sha256 string, size_bytes bigint, surface string, strata struct<file_type:string,prose:string,tool:string,exposure:string,result_status:string>, invocation string, occurrences bigint"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("sound", F.sha2("text", 256) == F.col("sha256")).withColumn("occurrences", F.coalesce("occurrences", F.lit(1)))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of files as they lie there."""
    return _files(spark, path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of transcript lines: keys of session and call id.

    calls: session, call_id, tool, arguments, body. results: session, call_id, text (null if
    any block isn't text), is_error, problem.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    session = F.coalesce(F.try_variant_get("v", "$.sessionId", "string"), F.col("file"))
    blocks = lines.select(session.alias("session"), F.explode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("b"))
    kind = F.try_variant_get("b", "$.type", "string")
    calls = blocks.where(kind == "tool_use").select(
        "session", F.try_variant_get("b", "$.id", "string").alias("call_id"), F.try_variant_get("b", "$.name", "string").alias("tool"), F.try_variant_get("b", "$.input", "variant").cast("string").alias("arguments"), F.col("b").cast("string").alias("body"),
    )
    plain = F.try_variant_get("b", "$.content", "string")
    parts = F.try_variant_get("b", "$.content", "array<variant>")
    joined = classify.text_blocks(F.transform(parts, lambda p: F.try_variant_get(p, "$.type", "string")), F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")))
    text = F.when(parts.isNotNull(), joined).otherwise(plain)
    results = blocks.where(kind == "tool_result").select("session", F.try_variant_get("b", "$.tool_use_id", "string").alias("call_id"), text.alias("text"), F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)).alias("is_error"))
    problem = F.when(F.col("text").isNull(), "nontext").when(F.octet_length("text") > MOST_BYTES, "too_large")
    return calls, results.withColumn("problem", problem)


def traffic_units(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Measurable units of paired calls and results, with strata."""
    from gatemeter.operators.lookups import calls_and_results

    good = calls_and_results(calls, results).where("status = 'paired'").select("session", "call_id")
    one = calls.join(good, ["session", "call_id"], "left_semi").groupBy("session", "call_id").agg(F.first("tool").alias("tool"), F.first("arguments").alias("arguments"))
    two = results.where("problem IS NULL").groupBy("session", "call_id").agg(F.first("text").alias("text"), F.max("is_error").alias("is_error"))
    met = one.join(two, ["session", "call_id"])
    command = F.try_variant_get(F.try_parse_json("arguments"), "$.command", "string")
    strata = F.struct(F.lit("tool-result").alias("file_type"), classify.prose(F.col("text")).alias("prose"), F.col("tool").alias("tool"), classify.exposure(F.col("tool"), command).alias("exposure"), F.when(F.col("is_error"), "error").otherwise("ok").alias("result_status"))
    digest = F.sha2("text", 256)
    invocation = F.to_json(F.struct(F.col("tool").alias("name"), "arguments"))
    return met.select(F.sha2(F.concat_ws(":", "session", "call_id"), 256).alias("id"), "text", digest.alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("OUT").alias("surface"), strata.alias("strata"), invocation.alias("invocation"))


def prose_folder(spark: SparkSession, root: str, most: int = MOST_BYTES, suffixes: tuple[str, ...] = PROSE_SUFFIXES) -> DataFrame:
    """(sha256, path, text): distinct UTF-8 texts of the folder's prose files; larger files are left out."""
    files = _files(spark, root, "*.{" + ",".join(suffixes) + "}").where(F.col("length") <= most)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), utf8(F.col("content")).alias("text")).where("text IS NOT NULL")
    return rows.groupBy("sha256").agg(F.min("path").alias("path"), F.min_by("text", "path").alias("text"))


LOCK = "name string, repo_url string, commit string, archive_sha256 string, fetched_at string, license string, record_count bigint"


def locks(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a lock file with `problem`, null if sound."""
    rows = spark.read.option("multiLine", True).schema(LOCK).json(path)
    return rows.withColumn("problem", lock_problem())


def lock_problem() -> Column:
    bad = lambda c, p: ~F.coalesce(F.col(c).rlike(p), F.lit(False))
    return (
        F.when(bad("name", "^[a-z0-9_-]+$"), "name").when(bad("repo_url", "^https://"), "repo_url").when(bad("commit", "^[0-9a-f]{40}$"), "commit").when(bad("archive_sha256", "^[0-9a-f]{64}$"), "archive_sha256")
        .when(bad("fetched_at", r"(?:Z|[+-]\d\d:\d\d)$") | F.try_to_timestamp("fetched_at").isNull(), "fetched_at").when(F.coalesce(F.col("license"), F.lit("")) == "", "license").when(~F.coalesce(F.col("record_count") >= 0, F.lit(False)), "record_count")
    )


def record_census(records: DataFrame, declared: DataFrame) -> DataFrame:
    """(source, records, files, duplicates, declared, agrees) of records (source, id, path)."""
    have = records.groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("path").alias("files"), (F.count("*") - F.countDistinct("id")).alias("duplicates"))
    return have.join(declared.select("source", F.col("record_count").alias("declared")), "source", "full_outer").withColumn("agrees", F.coalesce(F.col("records") == F.col("declared"), F.lit(False)))


def archive_census(members: DataFrame, depth: int = 2) -> DataFrame:
    """(folder, extension, files, bytes) of withheld members (path, size): counts only."""
    folder = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return members.groupBy(folder.alias("folder"), classify.file_type(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def labelled_samples(rows: DataFrame, text_col: str, label_col: str, positive: str, key_chars: int | None = 200) -> DataFrame:
    """(sample_id, text, attack): samples of a published corpus, deduplicated by their beginning.

    Ids come from the raw order in `row`; of equal keys the first row stays. Without key_chars all stay.
    """
    out = rows.select("row", F.col(text_col).alias("text"), (F.col(label_col).cast("string") == positive).alias("attack")).where("text IS NOT NULL")
    if key_chars is not None:
        out = out.groupBy(F.lower(F.substring("text", 1, key_chars)).alias("_k")).agg(F.min("row").alias("row"), F.min_by(F.struct("text", "attack"), "row").alias("x")).select("row", "x.*")
    return out.select(F.concat(F.lit("s"), "row").alias("sample_id"), "text", "attack")


def sweep(spark: SparkSession, path: str) -> DataFrame:
    """A timing sweep's rows (fingerprint, verdict, crossing_bytes, wall_s, over_60s); broken lines are left out."""
    schema = "pattern string, verdict string, crossing_bytes bigint, wall_s double, over_60s boolean"
    return spark.read.schema(schema).json(path).where("pattern IS NOT NULL AND verdict IN ('slow', 'fast')").select(fingerprint(F.col("pattern")).alias("fingerprint"), "verdict", "crossing_bytes", "wall_s", "over_60s")


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Store a report's rows as CSV with a header, JSON lines or Parquet."""
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
