"""Screening of patterns before they may run.

Patterns use Python's dialect. A pattern is refused, in this order, if it is no string, too
long or doesn't parse; refers back to a group; is recorded as slow; needs a recorded timing
and has none; or, where it has no timing, repeats a repeat or an alternation; if it holds a
lone surrogate; or doesn't compile. Refusals have a reason; nothing is rewritten silently.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from gatemeter.model import MAX_PATTERN_CHARS

_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
_PAIR = re.compile(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})")
_UNIT = r"\\u[dD][89abAB][0-9a-fA-F]{2}"
_LEADING_FLAGS = re.compile(r"\A\(\?([aiLmsux]+)\)")


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256, by which timings are recorded."""
    return F.substring(F.sha2(text, 256), 1, 16)


def _children(op, value):
    if op in _REPEATS:
        yield value[2]
    elif op is C.SUBPATTERN:
        yield value[-1]
    elif op is C.BRANCH:
        yield from value[1]
    elif op in (C.ASSERT, C.ASSERT_NOT):
        yield value[1]
    elif op is C.ATOMIC_GROUP:
        yield value
    elif op is C.GROUPREF_EXISTS:
        yield from (x for x in value[1:] if x is not None)


def hazards(pattern: str) -> set[str]:
    """Of nested_repeat, alternation_in_repeat, backreference, surrogate: those that it holds."""
    out: set[str] = set()

    def walk(tree, repeated: bool) -> None:
        for op, value in tree:
            if op in (C.GROUPREF, C.GROUPREF_EXISTS):
                out.add("backreference")
            if op is C.BRANCH and repeated:
                out.add("alternation_in_repeat")
            if op in (C.LITERAL, C.NOT_LITERAL) and 0xD800 <= value <= 0xDFFF:
                out.add("surrogate")
            if op is C.IN:
                for kind, x in value:
                    if kind is C.LITERAL and 0xD800 <= x <= 0xDFFF or kind is C.RANGE and (0xD800 <= x[0] <= 0xDFFF or 0xD800 <= x[1] <= 0xDFFF):
                        out.add("surrogate")
            many = op in _REPEATS and value[1] > 1
            if repeated and op in _REPEATS and (many or value[0] != value[1]):
                out.add("nested_repeat")
            for child in _children(op, value):
                walk(child, repeated or many)

    walk(parser.parse(pattern), False)
    return out


def refusal(pattern: object, slow: bool | None = None, must_be_measured: bool = False) -> str | None:
    """Why a pattern may not run, or None. slow: its recorded timing, None if there is none."""
    if not isinstance(pattern, str):
        return "pattern_not_a_string"
    if len(pattern) > MAX_PATTERN_CHARS:
        return "pattern_too_long"
    try:
        found = hazards(pattern)
    except (re.error, RecursionError, OverflowError):
        return "pattern_does_not_parse"
    if "backreference" in found:
        return "backreference"
    if slow:
        return "measured_slow"
    if slow is None and must_be_measured:
        return "not_measured"
    if slow is None and "nested_repeat" in found:
        return "nested_quantifier"
    if slow is None and "alternation_in_repeat" in found:
        return "alternation_under_repetition"
    if "surrogate" in found:
        return "unpaired_surrogate"
    try:
        re.compile(pattern)
    except (re.error, RecursionError, OverflowError):
        return "pattern_does_not_compile"
    return None


@F.pandas_udf(T.StringType())
def screen_pattern(pattern: pd.Series, slow: pd.Series) -> pd.Series:
    """The refusal of each pattern, null if it may run; slow is null where no timing is known."""
    return pd.Series([refusal(p, None if s is None or pd.isna(s) else bool(s)) for p, s in zip(pattern, slow, strict=True)], dtype=object)


def join_surrogates(pattern: str) -> tuple[str, list[str]]:
    r"""Escaped UTF-16 pairs as one code point each, with notes of what was changed.

    A pair followed by a quantifier is left alone, as the quantifier meant its second half;
    so are pairs inside a class, where halves stand for themselves.
    """
    notes: list[str] = []
    out, at, in_class = [], 0, False
    while at < len(pattern):
        m = _PAIR.match(pattern, at)
        if m:
            point = 0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00
            if in_class:
                notes.append("pair in a class left alone")
            elif re.match(r"[*+?{]", pattern[m.end() : m.end() + 1]):
                notes.append("quantified pair left alone")
            else:
                notes.append(f"pair joined to U+{point:X}")
                out.append(f"\\U{point:08x}")
                at = m.end()
                continue
            out.append(m[0])
            at = m.end()
            continue
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(c)
        at += 1
    return "".join(out), notes


def scoped_flags(pattern: str) -> str:
    """Leading global flags as a group of their own, so that a union can hold the pattern."""
    m = _LEADING_FLAGS.match(pattern)
    return f"(?{m[1]}:{pattern[m.end() :]})" if m else pattern


def strip_assertions(pattern: str) -> str | None:
    """The pattern without anchors, boundaries and lookarounds; None where that isn't plain to do."""
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith(("\\b", "\\B", "\\A", "\\Z"), at):
            at += 2
            if re.match(r"[*+?{]", pattern[at : at + 1]):
                return None
        elif pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        elif pattern[at] == "[":
            end = at + 1 + (pattern[at + 1 : at + 2] == "^")
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(pattern[at : end + 1])
            at = end + 1
        elif pattern[at] in "^$":
            at += 1
        elif re.match(r"\(\?<?[=!]", pattern[at : at + 4]):
            depth, end = 0, at
            while end < len(pattern):
                if pattern[end] == "\\":
                    end += 1
                elif pattern[end] == "[":
                    return None
                elif pattern[end] == "(":
                    depth += 1
                elif pattern[end] == ")":
                    depth -= 1
                    if depth == 0:
                        break
                end += 1
            if depth or re.match(r"[*+?{]", pattern[end + 1 : end + 2]):
                return None
            at = end + 1
        else:
            out.append(pattern[at])
            at += 1
    made = "".join(out)
    try:
        re.compile(made)
    except re.error:
        return None
    return made


#: Characters and classes on which Python, java.util.regex and RE2 agree.
_NATIVE = re.compile(r"(?:[A-Za-z0-9 _\"'=:;,@#%&<>/!~`-]|\\[.\-+*?()\[\]{}|/\\^$]|\[\^?(?:[A-Za-z0-9 _.,:;/@=+#%&<>\"'!~()*?{}|$-]|\\[\[\]\\^.-])+\]|\((?!\?)|\(\?:|[)|]|[*+?]\??|\{\d+(?:,\d*)?\})*")


def native_safe(pattern: str) -> bool:
    """Whether the pattern means the same in the JVM: ASCII literals, explicit classes, plain groups."""
    return _NATIVE.fullmatch(pattern) is not None and refusal(pattern, False) is None


def required(pattern: str, most: int = 8) -> frozenset[str] | None:
    """Literals of which every match contains at least one; None where none can be named.

    Looking for a literal is far cheaper than a pattern, so a match is only tried where one
    is there. Patterns with inline flags aren't read.
    """
    if re.search(r"\(\?[aiLmsux-]", pattern):
        return None

    def best(found: list[frozenset[str]]) -> frozenset[str] | None:
        return max((f for f in found if len(f) <= most), key=lambda f: (min(map(len, f)), -len(f)), default=None)

    def walk(tree) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run: list[str] = []

        def close() -> None:
            if run:
                found.append(frozenset({"".join(run)}))
                run.clear()

        for op, value in tree:
            if op is C.LITERAL:
                run.append(chr(value))
                continue
            close()
            inner: frozenset[str] | None = None
            if op is C.BRANCH:
                each = [walk(x) for x in value[1]]
                inner = None if None in each else frozenset().union(*each)
            elif op is C.SUBPATTERN or op in _REPEATS and value[0] >= 1:
                inner = walk(value[-1] if op is C.SUBPATTERN else value[2])
            elif op is C.ATOMIC_GROUP:
                inner = walk(value)
            if inner:
                found.append(inner)
        close()
        return best(found)

    return walk(parser.parse(pattern))


def from_run_start(pattern: str) -> str:
    """A pattern that matches somewhere in just the same texts, tried only where a run begins.

    If a pattern begins with an unbounded repeat of a class, a match from within a run goes on
    from the run's first character too. For yes-or-no tests only: spans differ.
    """
    tree = parser.parse(pattern)
    if not len(tree) or tree[0][0] is not C.MAX_REPEAT:
        return pattern
    least, most, inner = tree[0][1]
    own = re.match(r"\[(?:\\.|[^\]\\])+\]", pattern)
    if least < 1 or most is not C.MAXREPEAT or len(inner) != 1 or inner[0][0] is not C.IN or own is None:
        return pattern
    return f"(?<!{own[0]}){pattern}"
