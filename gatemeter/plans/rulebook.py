"""A small rule set whose patterns mean the same in Python, the JVM and SQL engines.

It serves the registered queries: each rule is kept as a record, run natively, and has an
SQL twin.
"""

from __future__ import annotations

from gatemeter.model import Rule

RULES = (
    Rule("own:licence", "REGEX", ("copyright|licen[sc]e",), source="own", source_id="licence", title="licence line", examples=("Copyright 2020 nobody", "under the MIT licence")),
    Rule("own:ipv4", "REGEX", (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",), source="own", source_id="ipv4", title="address", examples=("ping 10.0.0.1",)),
    Rule("own:token", "REGEX", ('token = "[0-9a-f]+"',), source="own", source_id="token", title="assigned token", surface="IN", case_sensitive=True, examples=('set token = "00ff00ff"', "nothing here")),
    Rule("own:mail", "REGEX", ("[A-Za-z0-9_.]+@[A-Za-z0-9_.]+",), source="own", source_id="mail", title="mail address", breadth="MEDIUM", examples=("write to a@b.example",)),
    Rule("own:blob", "REGEX", ("[A-Za-z0-9+/]{32,}",), source="other", source_id="blob", title="long run", breadth="BROAD", restricted=True, source_path="data/private/blob.yaml"),
    Rule("own:any", "SUBSTRING_ANY", ("released under", "all rights reserved", "permission is hereby"), source="own", source_id="any", title="grants", examples=("All Rights Reserved.",)),
    Rule("own:all", "SUBSTRING_ALL", ("the", "and", "token"), source="own", source_id="all", title="three words", surface="IN", examples=("the token and the rest", "token alone")),
    Rule("own:both", "REGEX_ALL", ("[0-9]{2,}", "[#$%&]"), source="other", source_id="both", title="digits and signs", surface="PROMPT", examples=("no digits",)),
    Rule("own:either", "REGEX_ANY", ("[0-9]{3}[ -][0-9]{3,4}", "[|<>]{1,}"), source="own", source_id="either", title="numbers or marks", surface="PROMPT", lane="ADVISE", examples=("call 555 1234",)),
    Rule("own:never", "REGEX", ("qqqqqqqq[0-9]",), source="own", source_id="never", title="never", examples=("qqqq",)),
    Rule("own:idle", "NONE", (), source="other", source_id="idle", title="metadata", surface="CFG", not_runnable_reason="metadata only"),
)
RUNNABLE = tuple(r for r in RULES if r.runnable)
IDS = tuple(r.id for r in RUNNABLE)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_predicate(rule: Rule, text: str = "text") -> str:
    """The rule as an SQL condition for DuckDB."""
    parts = []
    for p in rule.patterns:
        if rule.kind.startswith("SUBSTRING"):
            parts.append(f"contains({text}, {quote(p)})" if rule.case_sensitive else f"contains(lower({text}), {quote(p.lower())})")
        else:
            parts.append(f"regexp_matches({text}, {quote(p if rule.case_sensitive else '(?i)' + p)})")
    return "(" + (" AND " if rule.kind in ("SUBSTRING_ALL", "REGEX_ALL") else " OR ").join(parts) + ")"


def sql_findings(table: str = "documents", unit: str = "doc_id", text: str = "text", extra: str = "") -> str:
    """Rows (unit, extra, rule_id) of all findings."""
    also = f", {extra}" if extra else ""
    return " UNION ALL ".join(f"SELECT {unit}{also}, {quote(r.id)} AS rule_id FROM {table} WHERE {sql_predicate(r, text)}" for r in RUNNABLE)


def sql_rules() -> str:
    """The rule set as a table: id, source, surface, kind, breadth, lane, restricted, source_path, reason, n_patterns, chars, cost."""
    from gatemeter.operators.match import schedule_key

    rows = []
    for r in RULES:
        key = schedule_key(r) if r.runnable else (9, 0, 0, r.id)
        rows.append(f"({quote(r.id)}, {quote(r.source)}, {quote(r.surface)}, {quote(r.kind)}, {quote(r.breadth)}, {quote(r.lane)}, {str(r.restricted).lower()}, {quote(r.source_path)}, {len(r.patterns)}, {sum(map(len, r.patterns))}, {quote(chr(31).join(r.patterns))}, {key[0]})")
    return "(VALUES " + ", ".join(rows) + ") AS rules(id, source, surface, kind, breadth, lane, restricted, source_path, n_patterns, n_chars, patterns, class)"
