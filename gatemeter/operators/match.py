"""Matching rules against texts: a native path and a path with Python's own semantics.

``match_native`` takes rules whose patterns mean the same everywhere (``native_safe``) and
builds one projection of literal predicates, which stays in generated code and reads the
text column once. ``match_python`` runs any screened rule with Python's ``re``, rule by
rule over Arrow batches, under a deadline for each (rule, text) pair, and also returns
coverage: a pair that ran out of time is reported, never counted as quiet.
"""

from __future__ import annotations

import re
import signal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gatemeter.functions.screen import from_run_start, native_safe, refusal, required, scoped_flags
from gatemeter.functions.text import code_ranges, decoded_blocks, parts
from gatemeter.model import MAX_NEEDLES, MAX_PREDICATE_CHARS, MAX_RULES, Rule


def check_load(rules: list[Rule]) -> None:
    """Refuse a set of rules that is over the limits; nothing is ever cut."""
    if len(rules) > MAX_RULES or sum(len(p) for r in rules for p in r.patterns) > MAX_PREDICATE_CHARS:
        raise ValueError("too many rules or predicate characters")
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    if any(r.kind.startswith("SUBSTRING") and len(r.patterns) > MAX_NEEDLES for r in rules):
        raise ValueError("too many needles")


def schedule_key(r: Rule) -> tuple:
    """Cheapest first: substrings, single patterns, composed patterns."""
    if r.kind.startswith("SUBSTRING"):
        return (0, len(r.patterns), sum(map(len, r.patterns)), r.id)
    if r.kind == "REGEX":
        return (1, len(r.patterns[0]) + 32 * sum(c in "*+?{|(" for c in r.patterns[0]), 0, r.id)
    return (2, sum(map(len, r.patterns)), 0, r.id)


def predicate(rule: Rule, text: Column, low: Column | None = None) -> Column:
    """The rule as a boolean column; only for native-safe patterns.

    A pattern is tried only where a literal that it needs is found; ASCII letters of any case
    stay themselves when the text is lowered, so nothing is lost. low: the lowered text, if it
    is there already.
    """
    parts: list[Column] = []
    low = F.lower(text) if low is None else low
    for p in rule.patterns:
        if rule.kind.startswith("SUBSTRING"):
            parts.append(text.contains(p) if rule.case_sensitive else low.contains(p.lower()))
            continue
        if not native_safe(p):
            raise ValueError(f"{rule.id}: not safe on the native path")
        cased = rule.case_sensitive or not re.search("[A-Za-z]", p)
        hit = text.rlike(from_run_start(p) if cased else f"(?i){from_run_start(p)}")
        needs = sorted(required(p) or ())
        if needs:
            there = text.contains(needs[0]) if cased else low.contains(needs[0].lower())
            for n in needs[1:]:
                there = there | (text.contains(n) if cased else low.contains(n.lower()))
            hit = there & hit
        parts.append(hit)
    out = parts[0]
    for c in parts[1:]:
        out = out & c if rule.kind in ("SUBSTRING_ALL", "REGEX_ALL") else out | c
    return out


def match_native(units: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The units with `rule_ids`, the ids of the rules that match, in schedule order."""
    check_load(rules)
    if not rules:
        return units.withColumn("rule_ids", F.array().cast("array<string>"))
    low = "_low" + "_" * max(map(len, units.columns))  # a name that the units don't have
    lowered = units.withColumn(low, F.lower(F.col(text_col)))  # once for all rules
    ids = [F.when(predicate(r, F.col(text_col), F.col(low)), F.lit(r.id)) for r in sorted(rules, key=schedule_key)]
    return lowered.withColumn("rule_ids", F.array_compact(F.array(*ids))).drop(low)


def first_span(needle: str, text: Column, case_sensitive: bool = False) -> tuple[Column, Column]:
    """(start, end) in code points of the first occurrence; null where there is none."""
    at = F.locate(needle if case_sensitive else needle.lower(), text if case_sensitive else F.lower(text))
    return F.when(at > 0, at - 1), F.when(at > 0, at - 1 + len(needle))


class Late(Exception):
    """A match ran out of time."""


@dataclass
class Compiled:
    rule: Rule
    patterns: list[re.Pattern]
    #: for each pattern, literals of which a match needs one; None if unknown
    needs: list[frozenset[str] | None]

    def _find(self, k: int, text: str) -> re.Match | None:
        need = self.needs[k]
        if need and (self.rule.case_sensitive or text.isascii()):  # beyond ASCII, ignoring case isn't lowering
            where = text if self.rule.case_sensitive else text.lower()
            if not any(n in where for n in need):
                return None
        return self.patterns[k].search(text)

    def search(self, text: str) -> tuple[int, int] | None:
        """The span that the rule reports, or None."""
        kind = self.rule.kind
        if kind in ("REGEX_ALL", "SUBSTRING_ALL"):
            first = None
            for k in range(len(self.patterns)):
                m = self._find(k, text)
                if m is None:
                    return None
                first = first or m
            return first.span()
        if kind == "REGEX_ANY":
            found = [self._find(k, text) for k in range(len(self.patterns))]
            return min((m.span() for m in found if m), key=lambda s: s[0], default=None)
        for k in range(len(self.patterns)):
            if m := self._find(k, text):
                return m.span()
        return None


def _needs(rule: Rule) -> list[frozenset[str] | None]:
    if rule.kind.startswith("SUBSTRING"):
        return [None] * len(rule.patterns)
    found = map(required, rule.patterns)
    return [f if f is None or rule.case_sensitive else frozenset(x.lower() for x in f) if all(x.isascii() for x in f) else None for f in found]


def compiled(rules: list[Rule]) -> tuple[list[Compiled], list[tuple[str, str]]]:
    """(rules ready to run, (id, reason) of those that can't)."""
    ready, failed = [], []
    for r in sorted(rules, key=schedule_key):
        if not r.runnable:
            continue
        plain = r.kind.startswith("SUBSTRING")
        why = None if plain else next((x for x in map(refusal, r.patterns, [False] * len(r.patterns)) if x), None)
        if why:
            failed.append((r.id, why))
            continue
        flags = 0 if r.case_sensitive else re.IGNORECASE
        ready.append(Compiled(r, [re.compile(re.escape(p) if plain else scoped_flags(p), flags) for p in r.patterns], _needs(r)))
    return ready, sorted(failed)


class Deadline:
    """Interrupts a match in the main thread after so many seconds; without signals it can't."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds

    def __enter__(self):
        if self.seconds is not None:
            self.before = signal.signal(signal.SIGALRM, self._ring)
            signal.setitimer(signal.ITIMER_REAL, max(self.seconds, 1e-6))
        return self

    def __exit__(self, *_):
        if self.seconds is not None:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)

    @staticmethod
    def _ring(*_):
        raise Late


LATE = "late"
BLOCK = 128


def spans_of(c: Compiled, texts: list[str | None], seconds: float | None) -> list:
    """What the rule reports of each text: a span, None, or LATE for a pair that ran out of time.

    A block of texts that is done within the time of one pair has no late pair, so one alarm
    serves it. If it rings, the rest of the block is done pair by pair.
    """
    out: list = []
    for first in range(0, len(texts), BLOCK):
        last = min(first + BLOCK, len(texts))
        try:
            with Deadline(seconds):
                while len(out) < last:
                    out.append(c.search(texts[len(out)] or ""))
        except Late:
            pass
        while len(out) < last:
            span: object = LATE
            try:
                with Deadline(seconds):
                    span = c.search(texts[len(out)] or "")
            except Late:
                pass
            out.append(span)
    return out


FOUND = "unit string, leaf_no int, rule_id string, surface string, status string, start int, end int"


def match_python(leaves: DataFrame, rules: list[Rule], seconds: float | None = 1.0, unit_col: str = "unit", leaf_col: str = "leaf_no", text_col: str = "text") -> DataFrame:
    """Rows of findings ('hit'), late pairs ('deadline'), refused rules ('refused') and, for
    each leaf, one row 'done' whose start and end are the pairs scheduled and finished.

    At most one finding for a rule and leaf; spans are code points; no text is returned.
    """
    check_load(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, failed = compiled(rules)
        for batch in batches:
            units, numbers, texts = (c.to_pylist() for c in batch.columns)
            done = [0] * len(texts)
            out: list[tuple] = []
            for c in ready:
                for i, span in enumerate(spans_of(c, texts, seconds)):
                    if span == LATE:
                        out.append((units[i], numbers[i], c.rule.id, c.rule.surface, "deadline", None, None))
                        continue
                    done[i] += 1
                    if span:
                        out.append((units[i], numbers[i], c.rule.id, c.rule.surface, "hit", *span))
            for i in range(len(texts)):
                out += [(units[i], numbers[i], r, None, "refused", None, None) for r, _ in failed]
                out.append((units[i], numbers[i], None, None, "done", len(ready) + len(failed), done[i]))
            names = ["unit", "leaf_no", "rule_id", "surface", "status", "start", "end"]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    picked = leaves.select(F.col(unit_col).cast("string").alias("unit"), F.col(leaf_col).cast("int").alias("leaf_no"), text_col)
    return picked.mapInArrow(run, FOUND)


def coverage(found: DataFrame) -> DataFrame:
    """For each unit: leaves, pairs_scheduled, pairs_finished, complete."""
    done = found.where("status = 'done'").groupBy("unit").agg(F.count("*").alias("leaves"), F.sum("start").alias("pairs_scheduled"), F.sum("end").alias("pairs_finished"))
    return done.withColumn("complete", F.col("pairs_scheduled") == F.col("pairs_finished"))


def findings(found: DataFrame) -> DataFrame:
    """Findings of complete units only: an unfinished scan has none to show.

    Hits meet their unit's coverage in one aggregate, so the texts are scanned once.
    """
    hit = F.when(F.col("status") == "hit", F.struct("leaf_no", "rule_id", "surface", "start", "end"))
    done = F.col("status") == "done"
    units = found.groupBy("unit").agg(F.sum(F.when(done, F.col("start"))).alias("due"), F.sum(F.when(done, F.col("end"))).alias("did"), F.collect_list(hit).alias("hits"))
    return units.where("due = did").select("unit", F.inline("hits"))


def byte_allowance(leaves: DataFrame, most: int, unit_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """The leaves with `scheduled` and `truncated` under a running allowance of UTF-8 bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy(unit_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return leaves.withColumn("scheduled", before < most).withColumn("truncated", (before < most) & (before + size > most))


@dataclass
class Bound:
    """A rule's binding to a channel, ready to run."""

    rule_id: str
    all_of: bool
    suppress_in_code: bool
    tests: list[re.Pattern]

    def holds(self, text: str, in_code: Callable[[int], bool]) -> int | None:
        """The first condition that holds, if enough do. A first match inside code is a miss."""
        first = None
        for i, t in enumerate(self.tests):
            m = t.search(text)
            if m is None or self.suppress_in_code and in_code(m.start()):
                if self.all_of:
                    return None
            elif not self.all_of:
                return i
            elif first is None:
                first = i
        return first


def bound(rules: list[Rule], channel: str = "CFG") -> list[tuple[str, list[Bound]]]:
    """(rule id, its executable bindings) of the rules that are bound to the channel."""
    ready = lambda r, b: Bound(r.id, b.logic == "all", b.suppress_in_code, [re.compile(scoped_flags(c), re.IGNORECASE) for c in b.conditions])
    made = [(r.id, [ready(r, b) for b in r.bindings if b.channel == channel and b.executable]) for r in rules]
    return [(i, b) for i, b in made if b]


def scan_document(text: str, ready: list[tuple[str, list[Bound]]]) -> list[tuple[str, int, str]]:
    """(rule, condition index, origin) of the bindings that hold on a document or a block hidden in it.

    Each rule reports once: its first binding that holds, on the document before its blocks.
    """
    payloads = [("document", text), *(("base64", b) for b in decoded_blocks(text))]
    ranges: dict[int, list[tuple[int, int]]] = {}

    def in_code(k: int) -> Callable[[int], bool]:
        def test(at: int) -> bool:
            if k not in ranges:
                ranges[k] = code_ranges(payloads[k][1])
            return any(a <= at < b for a, b in ranges[k])

        return test

    out = []
    for rule_id, bindings in ready:
        found = ((i, payloads[k][0]) for b in bindings for k in range(len(payloads)) if (i := b.holds(payloads[k][1], in_code(k))) is not None)
        if (first := next(found, None)) is not None:
            out.append((rule_id, *first))
    return out


def scan_documents(docs: DataFrame, rules: list[Rule], seconds: float | None = 2.0, units: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, rule_id, condition_index, origin, complete): a row for each finding, one without for a quiet or unfinished document."""
    check_load(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = bound(rules)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            for at, n in parts(batch.column(1)):
                rows: list[tuple] = []
                for unit, text in zip(*(c.to_pylist() for c in batch.slice(at, n).columns), strict=True):
                    text = text or ""
                    try:
                        if len(text.encode("utf-16-le")) // 2 > units or not rules:
                            raise Late
                        with Deadline(seconds):
                            found = scan_document(text, ready)
                        rows += [(unit, *f, True) for f in found] or [(unit, None, None, None, True)]
                    except Late:
                        rows.append((unit, None, None, None, False))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["unit", "rule_id", "condition_index", "origin", "complete"])

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "unit string, rule_id string, condition_index int, origin string, complete boolean")
