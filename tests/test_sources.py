import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gatemeter.model import Rule, rules_list, rules_table
from gatemeter.sources import boolyaml, bundles, catalogs, corpora, yamlrules

RULE = """
id: R-1
title: one
author: someone (corpus X)
status: stable
severity: high
tags: {category: tool-poisoning, scan_target: tool_response}
detection:
  condition: any
  conditions:
    - {field: tool_response, operator: regex, value: 'inert[0-9]+'}
    - {field: tool_response, operator: regex, value: '(?i)marker'}
test_cases:
  true_positives: [inert1, {tool_response: a marker, tool_name: x}]
  true_negatives: [nothing]
when: 2026-01-01
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return path


def test_bundle_round_trip(spark, tmp_path):
    rules = [*bundles.starter(), Rule("a:1", "REGEX_ALL", ("x", "y"), source="a", source_id="1", extra={"tags": ["t"]}), Rule("a:2", "NONE", (), not_runnable_reason="why")]
    bundles.write(spark, str(tmp_path / "b"), rules, made_by="test")
    got, meta = bundles.read(spark, str(tmp_path / "b"))
    assert got == rules and meta["made_by"] == "test" and got[4].extra == {"tags": ["t"]}
    assert [r.id for r in rules_list(rules_table(spark, rules))] == sorted(r.id for r in rules)
    assert bundles.trimmed(rules[0]).examples == () and len(bundles.trimmed(rules[0]).extra["examples_sha256"]) == 1


def test_bundle_data_source_and_export(spark, tmp_path):
    from gatemeter.sources.datasource import RuleBundleSource

    rules = [*bundles.starter(), Rule("a:1", "NONE", (), not_runnable_reason="why", source="builtin"), Rule("b:1", "REGEX", ("x",), source="b", bindings=(yamlrules_binding(),))]
    put(tmp_path / "x.json", bundles.render(rules))
    spark.dataSource.register(RuleBundleSource)
    assert rules_list(spark.read.format("rulebundle").load(str(tmp_path / "x.json"))) == sorted(rules, key=lambda r: r.id)
    enabled = bundles.export_enabled(spark, str(tmp_path / "e"), rules, ["OUT"], {"builtin": "RECORD"})
    assert bundles.read(spark, str(tmp_path / "e"))[0] == enabled == rules[:4]


def yamlrules_binding():
    from gatemeter.model import Binding

    return Binding("CFG", True, "all", ("x", "y"), True, (("status", "pass"),))


@pytest.mark.parametrize("text", ['{"rules": [{"id": "x", "id": "y"}]}', '[{"id": "x", "odd": 1, "predicate_kind": "NONE", "not_runnable_reason": "w"}]', '{"rules": 3}', '{"format_version": 9, "rules": []}', '[{"id":"x","predicate_kind":"REGEX","predicate":"a"},{"id":"x","predicate_kind":"REGEX","predicate":"a"}]', '[{"id":"x","predicate_kind":"REGEX","predicate":"a","surface":"ODD"}]'])
def test_bad_bundles_are_refused(text):
    with pytest.raises((ValueError, KeyError)):
        bundles.parse(text)


def test_assigned_fields_are_dropped():
    rules, _ = bundles.parse('[{"id":"x","predicate_kind":"REGEX","predicate":"a","lane":"DENY","benign":{"trials":1}}]')
    assert rules[0].lane == "RECORD" and "benign" not in rules[0].extra


def test_yaml_rules(spark, tmp_path):
    put(tmp_path / "r/a.yaml", RULE)
    put(tmp_path / "r/sub/b.yaml", RULE.replace("R-1", "R-2").replace("condition: any", "condition: all"))
    put(tmp_path / "r/c.yaml", RULE.replace("R-1", "R-3").replace("status: stable", "status: draft"))
    put(tmp_path / "r/d.yaml", "id: R-4\nid: R-5\ndetection: {}\n")
    put(tmp_path / "r/e.yaml", RULE.replace("R-1", "R-6").replace("'inert[0-9]+'", "'(a+)+'"))
    put(tmp_path / "r/private/f.yaml", RULE)
    rows = yamlrules.load(spark, str(tmp_path / "r"), excluded=("private",))
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(got) == {"a.yaml", "b.yaml", "c.yaml", "d.yaml", "e.yaml"}
    assert got["a.yaml"]["kind"] == "REGEX" and got["a.yaml"]["patterns"] == ["(?:inert[0-9]+)|(?:(?i:marker))"] and got["a.yaml"]["surface"] == "OUT"
    assert got["a.yaml"]["examples"] == ["inert1", "a marker"] and got["b.yaml"]["kind"] == "REGEX_ALL"
    assert got["c.yaml"]["reasons"] == ["status:draft"] and "repeated key" in got["d.yaml"]["error"] and got["e.yaml"]["reasons"] == ["screen:nested_quantifier"]
    assert {g["name"]: g["verdict"] for g in got["a.yaml"]["binding"]["gates"]}["compound"] == "block" and got["b.yaml"]["binding"]["eligible"]
    assert {(r["metric"], r["key"]): r["n"] for r in yamlrules.losses(rows).collect()}[("refused", "status:draft")] == 1
    sha = hashlib.sha256(RULE.encode()).hexdigest()
    manifest = spark.createDataFrame([("r/a.yaml", sha), ("r/sub/b.yaml", "0")], "source_path string, sha256 string")
    assert {r["path"][-6:]: r["verdict"] for r in yamlrules.verified(rows, manifest).collect()} == {"a.yaml": "ok", "b.yaml": "changed", "c.yaml": "undeclared", "d.yaml": "undeclared", "e.yaml": "undeclared"}


def test_boolean_yaml(spark, tmp_path):
    doc = "id: {}\ntitle: t\nauthor: Own\nlogsource: {{product: ai_agent, category: tool_output}}\ndetection:\n  a:\n    content|{}: {}\n  condition: {}\n"
    text = "---\n".join([doc.format("S1", "contains", "[x, y]", "a"), doc.format("S2", "contains|all", "[x, y]", "a"), doc.format("S3", "re", "'(a+)+'", "a"), doc.format("S4", "contains", "'x*'", "a"), doc.format("S5", "contains", "x", "not a"), "title: no id\n"])
    put(tmp_path / "s/x.yml", text)
    put(tmp_path / "s/bad.yml", "%TAG ! x\n---\nid: 1\n")
    rows = boolyaml.load(spark, str(tmp_path / "s"))
    got = {r["id"]: r for r in rows.where("id IS NOT NULL").collect()}
    assert (got["S1"]["kind"], got["S2"]["kind"]) == ("SUBSTRING_ANY", "SUBSTRING_ALL") and got["S1"]["surface"] == "OUT"
    assert got["S3"]["reasons"] == ["screen_pattern_rejection"] and "wildcard_value" in got["S4"]["reasons"] and got["S5"]["reasons"] == ["boolean_tree_requires_structured_runtime"]
    assert rows.where("error IS NOT NULL").count() == 2
    assert {r["construct"]: r["n"] for r in boolyaml.census(rows).collect()}["modifiers:contains"] == 3
    assert {r["reason"]: (r["n"], r["alone"]) for r in boolyaml.refusals(rows).collect()}["screen_pattern_rejection"] == (1, 1)
    refs = spark.createDataFrame([("c1", "Conv", ["https://h.example/rules/O-1", "https://other/rules/O-2"], None), ("c2", "Pre x", [], None), ("c3", "else", [], None)], "id string, author string, references array<string>, error string")
    assert {r["id"]: r["candidates"] for r in boolyaml.candidates(refs, "Conv", ("h.example",), "/rules/([A-Z]-[0-9]+)", "Pre").collect()} == {"c1": ["O-1"], "c2": ["c2"], "c3": []}


def test_catalogues(spark, tmp_path):
    put(tmp_path / "a/rules.json", json.dumps({"rules": [{"rule_id": "AAK-RUGPULL-1", "title": "t", "severity": "high", "category": "c"}, {"rule_id": "AAK-2", "cve_references": ["CVE-1"]}, {"rule_id": "AAK-COMPOSE-1"}]}))
    got = {r["source_id"]: r for r in catalogs.audit_registry(spark, str(tmp_path / "a")).collect()}
    assert [(got[k]["surface"], got[k]["breadth"]) for k in ("AAK-RUGPULL-1", "AAK-2", "AAK-COMPOSE-1")] == [("PIN", "NARROW"), ("CFG", "NARROW"), ("CFG", "BROAD")] and got["AAK-2"]["references"] == ["CVE-1"]
    put(tmp_path / "g/rules.json", json.dumps({"rules": [{"id": "x", "family": "output", "taxonomy": [{"reference": "T1"}]}, {"id": "y", "target_kind": "artifact", "surface": "build"}]}))
    got = {r["source_id"]: r for r in catalogs.generated_registry(spark, str(tmp_path / "g")).collect()}
    assert got["x"]["surface"] == "OUT" and got["x"]["references"] == ["T1"] and got["y"]["surface"] == "CFG"
    put(tmp_path / "v/records/AVE-1.json", json.dumps({"ave_id": "AVE-1", "title": "t", "behavioral_vector": ["b"], "regex": "(a+)+"}))
    put(tmp_path / "v/records/AVE-2.json", json.dumps({"ave_id": "AVE-2"}))
    put(tmp_path / "v/crosswalks/c.json", json.dumps({"mappings": [{"ave_ids": ["AVE-1"], "rule_id": "Q"}, {"deep": [{"ave_id": "AVE-1"}]}]}))
    rows = catalogs.record_folder(spark, str(tmp_path / "v/records"), str(tmp_path / "v/crosswalks"))
    got = {r["source_id"]: r for r in rows.collect()}
    assert [c["pointer"] for c in got["AVE-1"]["crosswalks"]] == ["/mappings/0", "/mappings/1/deep/0"] and got["AVE-2"]["crosswalks"] == []
    assert [r["refusal"] for r in catalogs.pattern_refusals(rows).collect()] == ["nested_quantifier"]
    assert catalogs.census(rows).where("metric = 'surface'").collect()[0]["n"] == 2
    put(tmp_path / "d/rules.json", json.dumps({"rules": [{"rule_id": "x"}, {"rule_id": "x"}]}))
    with pytest.raises(ValueError):
        catalogs.audit_registry(spark, str(tmp_path / "d"))
    put(tmp_path / "e/rules.json", '{"rules": [{"rule_id": "x", "rule_id": "y"}]}')
    with pytest.raises(Exception):
        catalogs.audit_registry(spark, str(tmp_path / "e"))


def test_manifest_corpus(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = {"u/a.md": b"plain text", "u/SKILL.md": b"skill", "u/audit.txt": b"x", "u/bin.txt": b"\xff\xfe", "u/empty.txt": b""}
    for k, v in files.items():
        put(tmp_path / k, v)
    units = [{"id": k, "path": k, "sha256": sha(v), "strata": {}} for k, v in files.items()] + [{"id": "no", "path": "u/no.md", "sha256": "0"}, {"id": "out", "path": "../x", "sha256": "0"}, {"id": "digest", "path": "u/a.md", "sha256": "0"}, {"id": "label", "path": "u/a.md", "sha256": sha(b"plain text"), "strata": {"team": "a=b"}}]
    put(tmp_path / "corpus.json", json.dumps({"identity": "c", "revision": "r", "surface": "CFG", "units": units}))
    got = {r["id"]: r for r in corpora.manifest_corpus(spark, str(tmp_path)).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"u/a.md": None, "u/SKILL.md": None, "u/audit.txt": None, "u/bin.txt": "not_utf8", "u/empty.txt": "empty", "no": "missing", "out": "path_escapes", "digest": "digest", "label": "label"}
    assert got["u/SKILL.md"]["strata"] == {"file_type": "SKILL.md", "prose": "ordinary"} and got["u/audit.txt"]["strata"]["prose"] == "security-adjacent" and got["u/a.md"]["text"] == "plain text"


def test_transcripts(spark, tmp_path):
    line = lambda *blocks, s="s1": json.dumps({"type": "m", "sessionId": s, "message": {"content": list(blocks)}})
    use = lambda i, tool="Bash", **a: {"type": "tool_use", "id": i, "name": tool, "input": a}
    res = lambda i, c, **k: {"type": "tool_result", "tool_use_id": i, "content": c} | k
    lines = [line(use("1", command="cat x"), use("2", "WebFetch")), line(res("1", "done"), res("2", [{"type": "text", "text": "a"}, {"type": "text", "text": "security"}], is_error=True)), line(use("3"), use("4"), use("4", command="other")), line(res("4", "t"), res("5", "alone")), line(use("6")), line(res("6", [{"type": "image"}])), "no json"]
    put(tmp_path / "t.jsonl", "\n".join(lines))
    calls, results = corpora.transcripts(spark, str(tmp_path / "t.jsonl"))
    from gatemeter.operators.lookups import calls_and_results

    got = {r["call_id"]: r["status"] for r in calls_and_results(calls, results).collect()}
    assert got == {"1": "paired", "2": "paired", "3": "call_only", "4": "ambiguous", "5": "result_only", "6": "nontext"}
    units = {r["text"]: r["strata"] for r in corpora.traffic_units(calls, results).collect()}
    assert units["done"]["exposure"] == "file-origin-unknown" and units["a\nsecurity"]["prose"] == "security-adjacent" and units["a\nsecurity"]["result_status"] == "error"


def test_small_sources(spark, tmp_path):
    put(tmp_path / "p/a.md", "one")
    put(tmp_path / "p/b.txt", "one")
    put(tmp_path / "p/c.md", "x" * 50)
    put(tmp_path / "p/d.bin", "no")
    put(tmp_path / "p/e.md", b"\xff")
    got = corpora.prose_folder(spark, str(tmp_path / "p"), most=20).collect()
    assert len(got) == 1 and got[0]["text"] == "one" and got[0]["path"].endswith("a.md")
    assert corpora.file_digest(spark, str(tmp_path / "p")).count() == 5
    good = {"name": "a", "repo_url": "https://x", "commit": "0" * 40, "archive_sha256": "1" * 64, "fetched_at": "2026-01-01T00:00:00Z", "license": "MIT", "record_count": 1}
    put(tmp_path / "lock.json", json.dumps([good, good | {"commit": "x"}, good | {"fetched_at": "2026-01-01T00:00:00"}, good | {"record_count": -1}]))
    assert [r["problem"] for r in corpora.locks(spark, str(tmp_path / "lock.json")).collect()] == [None, "commit", "fetched_at", "record_count"]
    put(tmp_path / "sweep.json", '{"pattern":"a","verdict":"slow","crossing_bytes":1,"wall_s":2.0,"over_60s":false}\nbroken\n{"pattern":"b","verdict":"odd"}')
    assert corpora.sweep(spark, str(tmp_path / "sweep.json")).count() == 1
    put(tmp_path / "snap.jsonl", json.dumps({"id": "1", "text": "t", "sha256": hashlib.sha256(b"t").hexdigest()}) + "\n" + json.dumps({"id": "2", "text": "t", "sha256": "x"}))
    assert [(r["sound"], r["occurrences"]) for r in corpora.snapshot(spark, str(tmp_path / "snap.jsonl")).orderBy("id").collect()] == [(True, 1), (False, 1)]
    records = spark.createDataFrame([("a", "1", "f"), ("a", "1", "g"), ("b", "1", "f")], "source string, id string, path string")
    declared = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "source string, record_count long")
    assert {r["source"]: (r["duplicates"], r["agrees"]) for r in corpora.record_census(records, declared).collect()} == {"a": (1, True), "b": (0, False), "c": (None, False)}
    members = spark.createDataFrame([("a/b/c.txt", 5), ("a/b/d.txt", 6), ("a/x", 1)], "path string, size long")
    assert {(r["folder"], r["extension"]): (r["files"], r["bytes"]) for r in corpora.archive_census(members).collect()} == {("a/b", ".txt"): (2, 11), ("a/x", "no_extension"): (1, 1)}
    samples = spark.createDataFrame([(0, "Aa", "1"), (1, "aA", "0"), (2, None, "1"), (3, "b", "0")], "row int, t string, l string")
    assert {r["sample_id"]: (r["text"], r["attack"]) for r in corpora.labelled_samples(samples, "t", "l", "1").collect()} == {"s0": ("Aa", True), "s3": ("b", False)}
    corpora.write_report(declared, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert bundles.starter()[0].kind == "SUBSTRING_ALL" and F is not None


def test_deep_trees_are_an_error(spark):
    from gatemeter.operators.lookups import tree_references

    nested = lambda n: '{"a":' * n + '{"ave_id": "x"}' + "}" * n
    docs = lambda n: spark.createDataFrame([("d", nested(n))], "doc string, json string")
    assert tree_references(docs(60), ("ave_id",)).collect()[0]["pointer"] == "/a" * 60
    with pytest.raises(Exception, match="more than 64 levels"):
        tree_references(docs(70), ("ave_id",)).collect()
