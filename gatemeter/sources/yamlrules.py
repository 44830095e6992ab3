"""YAML rule corpora: files are parsed in parallel and normalised to rule rows.

Each file is one mapping, read strictly: no timestamps, no repeated keys. Files that fail
are kept as errors. A rule's conditions become one predicate or a reason why not, and a
document binding with its gates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.functions import classify
from gatemeter.functions.screen import hazards, join_surrogates, refusal, scoped_flags

# Fixed values.
TEXT_FIELDS = frozenset("input content user_input agent_output tool_response tool_description tool_args tool_name tool_input response".split())
DETECTION_KEYS = frozenset("method condition conditions semantic false_positives".split())
CONDITION_KEYS = frozenset("field operator value description".split())
EXEMPT_TARGETS = ("skill",)
MOST_BRANCHES = 64


def strict_yaml(text: str, many: bool = False) -> list[Any]:
    """The documents of a YAML text; repeated keys and directives are refused, dates stay text."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len({json.dumps(k, sort_keys=True, default=str) for k in keys}) < len(keys):
            raise yaml.constructor.ConstructorError(None, None, "repeated key", node.start_mark)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: mapping(loader, node, True))
    if any(line.startswith("%") for line in text.splitlines()):
        raise ValueError("directives are refused")
    return [d for d in yaml.load_all(text, Loader) if d is not None] if many else [yaml.load(text, Loader)]


def predicate(detection: dict, status: str | None, suppress: bool, slow: dict[str, bool] | None = None) -> tuple[str, list[str], list[str]]:
    """(kind, patterns, reasons). With any reason the kind is NONE."""
    why: list[str] = []
    method = detection.get("method", "pattern")
    if method == "semantic":
        if (detection.get("semantic") or {}).get("fallback_method") != "pattern":
            why.append("semantic_without_pattern_fallback")
    elif method != "pattern":
        why.append(f"method:{method}")
    if status in ("draft", "deprecated"):
        why.append(f"status:{status}")
    if suppress:
        why.append("suppress_in_code_blocks")
    why += [f"unknown_detection_key:{k}" for k in sorted(detection.keys() - DETECTION_KEYS)]
    conditions = detection.get("conditions")
    if not isinstance(conditions, list) or not conditions:
        return "NONE", [], [*why, "no_conditions"]
    fields = {c.get("field") for c in conditions if isinstance(c, dict)}
    if len(fields) > 1:
        why.append("several_fields")
    why += [f"unknown_field:{f}" for f in sorted(map(str, fields)) if f not in TEXT_FIELDS]
    patterns = []
    for c in conditions:
        if not isinstance(c, dict):
            why.append("condition_not_a_mapping")
            continue
        why += [f"unknown_condition_key:{k}" for k in sorted(c.keys() - CONDITION_KEYS)]
        if c.get("operator") != "regex" or not isinstance(c.get("value"), str):
            why.append("not_a_regex")
            continue
        ported = join_surrogates(c["value"])[0]
        timing = (slow or {}).get(ported, (slow or {}).get(c["value"]))
        if said := refusal(ported, timing):
            why.append(f"screen:{said}")
        patterns.append(ported)
    logic = detection.get("condition", "any")
    if logic not in ("any", "all"):
        why.append(f"logic:{logic}")
    if why:
        return "NONE", [], why
    if len(patterns) == 1:
        return "REGEX", patterns, []
    if logic == "all":
        return "REGEX_ALL", patterns, []
    if any("backreference" in hazards(p) for p in patterns):
        return "NONE", [], ["backreference_in_composition"]
    union = "|".join(f"(?:{scoped_flags(p)})" for p in patterns)
    if refusal(union, False) is None:
        return "REGEX", [union], []
    return ("REGEX_ANY", patterns, []) if len(patterns) <= MOST_BRANCHES else ("NONE", [], ["composition_too_long"])


def binding(doc: dict, slow: dict[str, bool] | None = None) -> dict:
    """How the rule runs on whole documents: gates in order, and the conditions that stay."""
    detection, tags = doc.get("detection") or {}, doc.get("tags") or {}
    conditions = [c for c in detection.get("conditions") or [] if isinstance(c, dict)] if isinstance(detection.get("conditions"), list) else []
    logic, n = detection.get("condition", "any"), len(conditions)
    kept, dropped = [], 0
    for c in conditions:
        value = c.get("value")
        if c.get("operator") == "regex" and isinstance(value, str) and refusal(join_surrogates(value)[0], (slow or {}).get(value)) is None:
            kept.append(join_surrogates(value)[0])
        else:
            dropped += 1
    reach = n if logic == "all" else 1
    exempt = tags.get("scan_target") in EXEMPT_TARGETS
    passed = {
        "status": doc.get("status") not in ("draft", "deprecated"), "method": detection.get("method", "pattern") in ("pattern", "semantic"), "conditions": n > 0,
        "compound": exempt or reach >= max(2, -(-3 * n // 10)), "field": all(c.get("field") in TEXT_FIELDS for c in conditions), "screen": bool(kept) and (logic == "any" or not dropped),
    }
    gates = [{"name": k, "verdict": "pass" if v else "block"} for k, v in passed.items()]
    return {"channel": "CFG", "eligible": all(passed.values()), "logic": logic if logic in ("any", "all") else "any", "conditions": kept, "suppress_in_code": bool(tags.get("suppress_in_code_blocks")), "gates": gates}


def _texts(value: Any, path: str = "") -> list[tuple[str, str]]:
    if isinstance(value, str):
        return [(path, value)]
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [y for k, v in items for y in _texts(v, f"{path}.{k}" if path else str(k))]


def examples(doc: dict, polarity: str) -> list[str]:
    """Texts of the test cases that belong to the conditions' field; plain inputs if it has none."""
    conditions = (doc.get("detection") or {}).get("conditions")
    fields = {c.get("field") for c in conditions if isinstance(c, dict)} if isinstance(conditions, list) else set()
    out = []
    for case in (doc.get("test_cases") or {}).get(polarity) or []:
        if isinstance(case, str):
            out.append(case)
            continue
        found = [(p, t) for p, t in _texts({k: v for k, v in case.items() if k in TEXT_FIELDS or k == "tool_call"} if isinstance(case, dict) else case)]
        if len(fields) == 1:
            f = next(iter(fields))
            own = {f, f"input.{f}", {"tool_response": "response", "tool_args": "tool_call.args", "tool_name": "tool_call.name"}.get(f), {"tool_response": "input.response"}.get(f)}
            picked = [x for x in found if x[0] in own]
            for name in ("tool_response", "input", "content", "input.response", "input.tool_args", "tool_args", "user_input", "agent_output", "tool_description", "tool_name", "input.tool_name"):
                picked = picked or [x for x in found if x[0] == name]
            found = picked
        out += [t for _, t in found]
    return out


ROW_DDL = (
    "path string, sha256 string, error string, id string, title string, status string, severity string, author string, method string, target string, category string, source_kind string, fields array<string>, kind string, patterns array<string>, "
    "reasons array<string>, examples array<string>, negatives array<string>, binding struct<channel:string,eligible:boolean,logic:string,conditions:array<string>,suppress_in_code:boolean,gates:array<struct<name:string,verdict:string>>>, raw string"
)


def _row(path: str, sha: str, content: bytes, slow: dict[str, bool]) -> dict:
    try:
        doc = strict_yaml(content.decode("utf-8"))[0]
        if not isinstance(doc, dict) or not isinstance(doc.get("id"), str) or not doc["id"] or not isinstance(doc.get("detection"), dict):
            raise ValueError("a rule is a mapping with id and detection")
    except Exception as why:  # a bad file is a row of the result, whatever is wrong with it
        return {"path": path, "sha256": sha, "error": f"{type(why).__name__}: {str(why)[:300]}"}
    detection, tags = doc["detection"], doc.get("tags") if isinstance(doc.get("tags"), dict) else {}
    kind, patterns, reasons = predicate(detection, doc.get("status"), bool(tags.get("suppress_in_code_blocks")), slow)
    conditions = detection.get("conditions") if isinstance(detection.get("conditions"), list) else []
    text = lambda v: v if isinstance(v, str) else None
    source = doc.get("agent_source") if isinstance(doc.get("agent_source"), dict) else {}
    return {
        "path": path, "sha256": sha, "id": doc["id"], "title": text(doc.get("title")), "status": text(doc.get("status")), "severity": text(doc.get("severity")), "author": text(doc.get("author")),
        "method": str(detection.get("method", "pattern")), "target": text(tags.get("scan_target")), "category": text(tags.get("category")), "source_kind": text(source.get("type")),
        "fields": sorted({str(c.get("field", "")) for c in conditions if isinstance(c, dict)}), "kind": kind, "patterns": patterns, "reasons": reasons, "examples": examples(doc, "true_positives"), "negatives": examples(doc, "true_negatives"),
        "binding": binding(doc, slow), "raw": json.dumps(doc, ensure_ascii=False, default=str),
    }


def load(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), slow: dict[str, bool] | None = None, glob: str = "*.yaml") -> DataFrame:
    """One row a file: the normalised rule with its surface, or its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema: StructType = _parse_datatype_string(ROW_DDL)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    for e in excluded:
        files = files.where(~F.col("path").contains(f"/{e.strip('/')}/"))
    wire = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(*x, slow or {}) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in wire.names} for r in rows], schema=wire)

    parsed = files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, schema)
    surface = F.when(F.col("error").isNull(), classify.rule_surface(*map(F.col, ("method", "target", "fields", "source_kind", "category"))))
    return parsed.withColumn("surface", surface)


def verified(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows with `verdict` against a manifest (source_path, sha256): ok, changed or undeclared."""
    want = manifest.select("source_path", F.col("sha256").alias("_want"))
    met = rows.join(want, F.col("path").endswith(F.concat(F.lit("/"), F.col("source_path"))), "left")
    return met.withColumn("verdict", F.when(F.col("_want").isNull(), "undeclared").when(F.col("_want") == F.col("sha256"), "ok").otherwise("changed")).drop("_want")


def losses(rows: DataFrame) -> DataFrame:
    """(metric, key, n): what was refused and why, by surface, kind and gate."""
    ok = rows.where("error IS NULL")
    count = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    out = count(rows.where("error IS NOT NULL"), "error", F.substring_index("error", ":", 1))
    for df, metric, key in (
        (ok.select(F.explode("reasons").alias("r")), "refused", F.col("r")), (ok, "surface", F.col("surface")), (ok, "kind", F.col("kind")), (ok, "status", F.col("status")),
        (ok.select(F.explode("binding.gates").alias("g")), "gate", F.concat("g.name", F.lit(":"), "g.verdict")),
    ):
        out = out.unionByName(count(df, metric, key))
    return out
