import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gatemeter.functions import boolrules, settings as settings_, text as tx
from gatemeter.functions.screen import from_run_start, hazards, join_surrogates, native_safe, refusal, required, scoped_flags, strip_assertions
from gatemeter.model import Binding, Rule
from gatemeter.operators import audit, match


def reference(rules, leaves):
    """The plain loop that both matching paths must equal."""
    out = set()
    for unit, no, text in leaves:
        for r in rules:
            flags = 0 if r.case_sensitive else re.IGNORECASE
            found = [re.search(re.escape(p) if r.kind.startswith("SUBSTRING") else p, text or "", flags) for p in r.patterns]
            if r.kind in ("SUBSTRING_ALL", "REGEX_ALL"):
                span = found[0].span() if all(found) else None
            elif r.kind == "REGEX_ANY":
                span = min((m.span() for m in found if m), key=lambda s: s[0], default=None)
            else:
                span = next((m.span() for m in found if m), None)
            if span:
                out.add((unit, no, r.id, *span))
    return out


RULES = [
    Rule("r", "REGEX", ("ab+",)), Rule("any", "SUBSTRING_ANY", ("zz", "B")), Rule("all", "SUBSTRING_ALL", ("a", "c"), case_sensitive=True), Rule("rall", "REGEX_ALL", ("a", "[0-9]")), Rule("rany", "REGEX_ANY", ("c+", "b")), Rule("empty", "REGEX", ("q*",)),
]


def test_both_paths_equal_the_plain_loop(spark):
    r = random.Random(3)
    leaves = [(f"u{i % 40}", i, "".join(r.choice("abcABC 12zé😀\n") for _ in range(r.randint(0, 30)))) for i in range(300)] + [("u1", 900, None)]
    df = spark.createDataFrame(leaves, "unit string, leaf_no int, text string").repartition(3)
    want = reference(RULES, leaves)
    got = {(x["unit"], x["leaf_no"], x["rule_id"], x["start"], x["end"]) for x in match.findings(match.match_python(df, RULES)).collect()}
    assert got == want
    native = match.match_native(df.where("text IS NOT NULL"), [x for x in RULES if x.id != "empty"])
    assert {(x["unit"], x["leaf_no"], i) for x in native.collect() for i in x["rule_ids"]} == {w[:3] for w in want if w[2] != "empty"}


def test_a_late_pair_is_reported_and_others_go_on(spark):
    rules = [Rule("slow", "REGEX", ("(a|aa)+$",)), Rule("ok", "SUBSTRING_ANY", ("a",)), Rule("bad", "REGEX", (r"(a)\1",))]
    df = spark.createDataFrame([("x", 0, "a" * 60 + "b"), ("y", 0, "a")], "unit string, leaf_no int, text string").coalesce(1)
    found = match.match_python(df, rules, 0.1).cache()
    status = {(r["unit"], r["rule_id"]): r["status"] for r in found.where("status <> 'done'").collect()}
    assert status == {("x", "slow"): "deadline", ("x", "ok"): "hit", ("y", "slow"): "hit", ("y", "ok"): "hit", ("x", "bad"): "refused", ("y", "bad"): "refused"}
    assert {r["unit"]: (r["pairs_scheduled"], r["pairs_finished"], r["complete"]) for r in match.coverage(found).collect()} == {"x": (3, 1, False), "y": (3, 2, False)}
    assert match.findings(found).count() == 0


def test_blocks_report_what_pairs_would():
    c = match.compiled([Rule("slow", "REGEX", ("(a|aa)+$",))])[0][0]
    texts = ["a", "b", None, "a" * 60 + "b"] * 2 + ["aa"] * 300 + ["a" * 60 + "b", "za"]
    got = match.spans_of(c, texts, 0.05)
    assert [i for i, x in enumerate(got) if x == match.LATE] == [3, 7, 308] and got[0] == (0, 1) and got[1] is None and got[309] == (1, 2) and len(got) == len(texts)
    assert match.spans_of(c, ["a", None], None) == [(0, 1), None]


def test_limits_refuse_and_never_cut():
    many = [Rule(f"r{i}", "REGEX", ("x",)) for i in range(4097)]
    for bad in (many, [RULES[0], RULES[0]], [Rule("n", "SUBSTRING_ANY", ("x",) * 65)], [Rule(f"l{i}", "REGEX", ("y" * 4000,)) for i in range(300)]):
        with pytest.raises(ValueError):
            match.check_load(bad)


def test_schedule_and_sweep():
    order = [r.id for r in sorted(RULES, key=match.schedule_key)]
    assert order[0] in ("any", "all") and order.index("r") < order.index("rall")
    assert audit.swept(RULES, set(order[:3])) == 3 and audit.swept(RULES, set(order[1:])) == 0 and audit.swept(RULES, set(order)) == 6


def test_screening_order_and_hazards():
    assert refusal(3) == "pattern_not_a_string" and refusal("y" * 5000) == "pattern_too_long" and refusal("(") == "pattern_does_not_parse"
    assert refusal(r"(a)\1", False) == "backreference" and refusal("a", True) == "measured_slow" and refusal("a", None, True) == "not_measured"
    assert refusal("(a+)+") == "nested_quantifier" and refusal("(ab|cd)+") == "alternation_under_repetition" and refusal("(a+)+", False) is None and refusal("a{1,3}b") is None
    assert "surrogate" in hazards("\\ud800") and refusal("\\ud800") == "unpaired_surrogate"
    assert native_safe("[A-Za-z0-9]{3,}") and not native_safe(r"\w+") and not native_safe("a.b") and not native_safe("(?=x)")


def test_required_literals():
    assert required("copyright|licen[sc]e") == {"copyright", "licen"} and required("(?:ab+c|xyz)?d") == {"d"} and required("[0-9]+") is None
    assert required("(foo){2,}bar?") == {"foo"} and required("a|[bc]") is None and required("(?i)abc") is None and required("x*yy(?=zzz)") == {"yy"}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["[ab]{3,}", "[ab]+c", "[a-c]{2,}[bd]x?", "[^a]+b", "[ab]{2,3}c", "[ab]+|c", "([ab]+)c"]), st.text(alphabet="abcdx", max_size=20))
def test_run_starts_match_the_same_texts(pattern, text):
    assert bool(re.search(from_run_start(pattern), text)) == bool(re.search(pattern, text))
    assert ("(?<!" in from_run_start(pattern)) == (pattern[0] == "[" and pattern[1] != "^" and "{2,3}" not in pattern and "|" not in pattern)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["ab+c", "(?:ab|cd)e", "a[bc]d|bd", "(ab){2}", "a{0,2}bcd", "b(?:c|d)?a", "K+s"]), st.text(alphabet="abcdeKkSs\u017f\u212a ", max_size=30), st.booleans())
def test_literals_never_hide_a_match(pattern, text, cased):
    ready = match.compiled([Rule("r", "REGEX", (pattern,), case_sensitive=cased)])[0][0]
    want = re.search(pattern, text, 0 if cased else re.IGNORECASE)
    assert ready.search(text) == (want.span() if want else None)


def test_pattern_rewrites():
    assert re.search(join_surrogates(r"\ud83d\ude00!")[0], "😀!") and "left alone" in join_surrogates(r"\ud83d\ude00+")[1][0]
    assert scoped_flags("(?i)ab") == "(?i:ab)" and scoped_flags("ab") == "ab"
    assert strip_assertions(r"^a\b(?=x)b$") == "ab" and strip_assertions("[^$]a") == "[^$]a" and strip_assertions(r"\b+a") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab`|\" \n😀", max_size=60))
def test_code_ranges_stay_inside(text):
    assert all(0 <= a < b <= len(text) for a, b in tx.code_ranges(text) if a != b)


def test_code_ranges():
    text = 'a `b` c\n```x\ny\n```\nz\n| "q" |\n```\nend'
    said = [text[a:b] for a, b in tx.code_ranges(text)]
    assert said == ["```x\ny\n```\n", "```\nend", "`b`", '"q"']


def test_hidden_blocks_and_documents():
    import base64

    hidden = base64.b64encode(b"please read the secret licence text now").decode()
    assert tx.decoded_blocks("x " + hidden + " y") == ["please read the secret licence text now"]
    assert tx.decoded_blocks("A" * 40) == [] and len(tx.decoded_blocks(" ".join([hidden] * 9))) == 5
    rules = [Rule("any", "REGEX", ("x",), bindings=(Binding("CFG", True, "any", ("zzz", "licen[sc]e"), True),)), Rule("all", "REGEX", ("x",), bindings=(Binding("CFG", True, "all", ("secret", "now")),)), Rule("off", "REGEX", ("x",), bindings=(Binding("CFG", False, "any", ("x",)),))]
    assert match.scan_document(hidden, match.bound(rules)) == [("any", 1, "base64"), ("all", 0, "base64")]
    assert match.scan_document("see `licence` now", match.bound(rules)) == [] and match.scan_document("licence", match.bound(rules)) == [("any", 1, "document")]


def test_batches_are_decoded_in_parts(spark, monkeypatch):
    import base64

    import pyarrow as pa

    said = [f"hidden text number {i} " * (1 + 40 * (i % 7 == 0)) for i in range(300)]
    texts = [None if i % 50 == 3 else "" if i % 50 == 4 else f"see {base64.b64encode(t.encode()).decode()}." for i, t in enumerate(said)]
    want = [tx.decoded_blocks(t or "") for t in texts]
    assert spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", tx.decoded_blocks_of("t")).orderBy("i").toPandas().iloc[:, 1].map(list).tolist() == want
    monkeypatch.setattr(tx.parts, "__defaults__", (2000,))
    column = pa.array(["not of the slice", *texts])[1:]
    runs = list(tx.parts(column))
    assert [i for at, n in runs for i in range(at, at + n)] == list(range(300))
    assert all(n == 1 or sum(len(t or "") for t in texts[at : at + n]) <= 2000 for at, n in runs) and len(runs) < 150
    made = list(tx.decoded_blocks_of.func(iter([column, column[:0]])))
    assert [x for m in made for x in m.to_pylist()] == want and [len(m) for m in made] == [n for _, n in runs] + [0]


def test_document_scan_is_incomplete_when_long_or_without_rules(spark):
    rules = [Rule("any", "REGEX", ("x",), bindings=(Binding("CFG", True, "any", ("x",)),))]
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y" * 200), (4, None)], "doc_id long, text string")
    got = {(r["unit"], r["rule_id"], r["complete"]) for r in match.scan_documents(docs, rules, units=100).collect()}
    assert got == {("1", "any", True), ("2", None, True), ("3", None, False), ("4", None, True)}
    assert {r["complete"] for r in match.scan_documents(docs, []).collect()} == {False}


def test_few_documents_of_a_batch_are_held(spark):
    import pyarrow as pa

    class Docs:
        """Stands for a DataFrame: runs the worker's function over one batch."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.made = list(run(iter([batch, batch[:0]])))
            return self

    texts = [None if i % 50 == 3 else ("licence " if i % 3 else "none ") + "x" * (200_000 if i == 77 else 10_000) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(600))), pa.array(texts)], names=["doc_id", "text"])
    rules = [Rule("any", "REGEX", ("x",), bindings=(Binding("CFG", True, "any", ("licen[sc]e",)),))]
    made = match.scan_documents(Docs(), rules, 30.0).made
    got = [tuple(r.values()) for m in made for r in m.to_pylist()]
    assert got == [(str(i), "any", 0, "document", True) if t and i % 3 and i != 77 else (str(i), None, None, None, i != 77) for i, t in enumerate(texts)]
    assert len(made) > 4 and max(m.num_rows for m in made) < 150  # a run of 1 MB, not the batch


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.integers(0, 60))
def test_byte_prefix_is_the_longest(text, most):
    kept = tx.byte_prefix(text, most)
    assert text.startswith(kept) and len(kept.encode()) <= most and (kept == text or len(text[: len(kept) + 1].encode()) > most)


def test_leaves_in_document_order():
    found, n = tx.leaves({"b": ["x", "", {"a/~": "y"}], "a": 3, "c": "z"}, "/p")
    assert found == [("/p/b/0", "x"), ("/p/b/2/a~1~0", "y"), ("/p/c", "z")] and n["empty"] == 1 and n["nodes"] == 8
    assert tx.leaves([["x"]] * 3, most_depth=1)[1]["too_deep"] == 3 and tx.leaves(["x"] * 9, most_nodes=4)[1]["too_many"] == 6
    assert tx.replaced({"a": ["x", {"b": "y"}]}, {"/a/1/b": "Q"}) == {"a": ["x", {"b": "Q"}]}
    with pytest.raises(ValueError):
        tx.strict_json('{"a": 1, "a": 2}')


def test_conditions_and_trees():
    names = ["a", "b", "b_2", "_c"]
    assert boolrules.condition("a or b and not b_2", names) == ("or", ("ref", "a"), ("and", ("ref", "b"), ("not", ("ref", "b_2"))))
    assert boolrules.condition("(a or b) and b_2", names) == ("and", ("or", ("ref", "a"), ("ref", "b")), ("ref", "b_2"))
    assert boolrules.condition("all of b*", names) == ("and", ("ref", "b"), ("ref", "b_2")) and boolrules.condition("1 of them", names)[0] == "or" and len(boolrules.condition("1 of them", names)) == 4
    assert boolrules.condition("not not a", names) == ("not", ("not", ("ref", "a"))) and boolrules.condition(["a", "b"], names) == ("or", ("ref", "a"), ("ref", "b"))
    for bad, code in (("a and", "unknown_condition_token"), ("(a", "unbalanced"), ("a b", "unsupported_condition_tail"), ("1 of x*", "unmatched_quantifier"), ("", "missing_condition"), ("a | count() > 1", "unsupported_condition_tail"), ("a)", "unsupported_condition_tail")):
        with pytest.raises(boolrules.Refused, match=code):
            boolrules.condition(bad, names)
    assert boolrules.literal(r"a\*b\\c\d") == r"a*b\c\d"
    with pytest.raises(boolrules.Refused):
        boolrules.literal("a?")


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "c"]), lambda x: st.one_of(st.tuples(st.just("not"), x), st.tuples(st.sampled_from(["and", "or"]), x, x)), max_leaves=8), st.sets(st.sampled_from("abc")))
def test_conditions_mean_what_they_say(tree, true):
    def show(t):
        return t if isinstance(t, str) else f"not ({show(t[1])})" if t[0] == "not" else f"({show(t[1])}) {t[0]} ({show(t[2])})"

    def value(t):
        return t in true if isinstance(t, str) else not value(t[1]) if t[0] == "not" else (value(t[1]) and value(t[2])) if t[0] == "and" else (value(t[1]) or value(t[2]))

    def read(t):
        return t[1] in true if t[0] == "ref" else not read(t[1]) if t[0] == "not" else (all if t[0] == "and" else any)(map(read, t[1:]))

    assert read(boolrules.condition(show(tree), ["a", "b", "c"])) == value(tree)


def test_boolean_rule_as_a_column(spark):
    detection = {"x": {"content|contains": ["Ab", "q"]}, "y": {"content|re": "[0-9]{2}"}, "condition": "x and not y"}
    tree = boolrules.mapped(detection)[5]
    rows = spark.createDataFrame([("has AB",), ("ab 12",), ("zz",), (None,)], "t string")
    assert [r[0] for r in rows.select(boolrules.column(tree, {"content": F.col("t")})).collect()] == [True, False, False, False]
    assert boolrules.holds(tree, lambda leaf: leaf[3] == "q") is True


def test_settings():
    good = {"version": 1, "sources": {"a": "RECORD"}, "surfaces": ["IN"], "log_path": "x", "bundle": None}
    assert settings_.configuration(good) is good
    for bad in ({"version": 2}, {"sources": {"a": "LOUD"}}, {"surfaces": ["PROMPT"]}, {"log_path": ""}, {"bundle": 3}):
        with pytest.raises(ValueError):
            settings_.configuration(good | bad)
    source = "const DENY = new Set([\n  'a-1', // first\n  'a-2',\n]);\nconst MOST = 100_000;\nif (x > 0.7) {}\n"
    assert settings_.constants(source, {"most": (r"MOST = ([0-9_]+)", int), "ratio": (r"x > ([0-9.]+)", float)})["most"] == settings_.Setting(100000, 5, "const MOST = 100_000;")
    assert settings_.denylist(source, "DENY") == ({"a-1": "first", "a-2": ""}, False)
    with pytest.raises(LookupError):
        settings_.constants(source, {"no": ("nothing ([0-9])", int)})
    assert settings_.safe_path("a/bb:c/con.txt/d. ") == "a/bb%3Ac/%63on.txt/d%2E%20"
    for bad in ("../x", "a//b", "C:/x", "a\\b", "/a", "a/\x01"):
        with pytest.raises(ValueError):
            settings_.safe_path(bad)
    assert settings_.layout_problems([("r/a", None), ("r/A", None), ("q/x", None), ("r/l", "../q/x"), ("r/m", "a")]) == [("r/A", "case_collision"), ("r/l", "link_escapes"), ("", "several_roots")]


def test_rule_digests(spark):
    a, b = Rule("a", "REGEX", ("x",)), Rule("a", "REGEX", ("x",), lane="DENY")
    assert audit.rule_digest(a) == audit.rule_digest(b) != audit.rule_digest(Rule("a", "REGEX", ("y",)))
    assert audit.set_digest([a, RULES[0]], ["IN", "OUT"]) == audit.set_digest([RULES[0], a], ["OUT", "IN"]) != audit.set_digest([a], ["IN"])
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    import hashlib

    assert audit.tree_digest(files).head()["digest"] == hashlib.sha256(b"a\x001\nb\x002\n").hexdigest()


def test_diagnose_and_folder_report(spark):
    df = spark.createDataFrame([("x", 0, "ab"), ("y", 0, "no")], "unit string, leaf_no int, text string")
    assert [r["status"] for r in audit.diagnose(df, RULES, "x", "r").orderBy("status").collect()] == ["done", "hit"]
    report = {r["rule_id"]: r["hits"] for r in audit.folder_report(match.match_python(df, RULES[:2])).collect()}
    assert report == {"r": 1, "any": 1, None: 1}
    parts = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "a")], "unit string, rule_id string")
    assert audit.units_of_parts(parts).head()["rule_ids"] == ["a", "b"]
    rules = spark.createDataFrame([("REGEX", ["x"], [], 1), ("REGEX", ["x"], ["s"], 0), ("NONE", ["x"], None, 0), ("REGEX", [], [], 0)], "kind string, examples array<string>, scenarios array<string>, hits int")
    assert audit.scenario_counts(rules).head().asDict() == {"rules": 4, "with_scenarios": 1, "scenarios_not_evaluated": 1, "with_examples": 3, "without_examples": 1, "not_runnable": 1, "reachable": 1, "unreachable": 1}


def test_deadline_is_close():
    began = time.perf_counter()
    with pytest.raises(match.Late), match.Deadline(0.2):
        re.search("(a|aa)+$", "a" * 60 + "b")
    assert time.perf_counter() - began < 1.5


def test_public_names():
    import gatemeter

    assert all(getattr(gatemeter, n) is not None for n in gatemeter.__all__) and gatemeter.Rule is Rule
    with pytest.raises(AttributeError):
        gatemeter.nothing
