"""Settings: a user's configuration, and constants read from another engine's source text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from gatemeter.model import LANES


def configuration(said: Any) -> dict:
    """A checked configuration: version, sources and lanes, surfaces, log path, bundle."""
    if not isinstance(said, dict) or said.get("version") != 1:
        raise ValueError("configuration version isn't 1")
    sources = said.get("sources")
    if not isinstance(sources, dict) or any(lane not in LANES for lane in sources.values()):
        raise ValueError("sources map names to lanes")
    if not isinstance(said.get("surfaces"), list) or not set(said["surfaces"]) <= {"IN", "OUT"}:
        raise ValueError("surfaces are IN and OUT")
    if not isinstance(said.get("log_path"), str) or not said["log_path"]:
        raise ValueError("log_path is missing")
    if not isinstance(said.get("bundle"), str | None):
        raise ValueError("bundle is a path or null")
    return said


@dataclass(frozen=True)
class Setting:
    """A constant as found: its value and where it stands."""

    value: Any
    line: int
    excerpt: str


def constants(source: str, wanted: dict[str, tuple[str, type]]) -> dict[str, Setting]:
    """Each wanted constant by its pattern's first group. One that isn't there is an error: a
    gate is never assumed."""
    out = {}
    for name, (pattern, kind) in wanted.items():
        m = re.search(pattern, source)
        if m is None:
            raise LookupError(f"{name} isn't in the source")
        line = source.count("\n", 0, m.start())
        text = m[1].replace("_", "") if kind in (int, float) else m[1]
        out[name] = Setting(kind(text), line + 1, source.splitlines()[line].strip()[:200])
    return out


def denylist(source: str, name: str) -> tuple[dict[str, str], bool]:
    """(entries with their comments, whether the set is read anywhere) of a named set of strings."""
    found = re.search(rf"\b{re.escape(name)}\b[^\[]*\[(.*?)\]", source, re.DOTALL)
    if found is None:
        raise LookupError(f"{name} isn't in the source")
    entries = {m[1]: (m[2] or "").strip() for m in re.finditer(r"'([^'\n]+)'\s*,?[ \t]*(?://([^\n]*))?", found[1])}
    if not entries:
        raise LookupError(f"{name} is empty")
    return entries, len(re.findall(rf"\b{re.escape(name)}\b", source)) > 1


def safe_path(name: str) -> str:
    """An archive member's path made portable; one that could leave the folder is an error."""
    out = []
    for part in name.rstrip("/").split("/"):
        if part in ("", ".", "..") or "\\" in part or re.match(r"[A-Za-z]:", part) or any(ord(c) < 32 for c in part):
            raise ValueError(f"unsafe path: {name!r}")
        escape = lambda c: f"%{ord(c):02X}"
        part = re.sub(r'[%:<>"|?*]', lambda m: escape(m[0]), part)
        part = re.sub(r"[. ]+$", lambda m: "".join(map(escape, m[0])), part)
        if re.fullmatch(r"(?i)(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\..*)?", part):
            part = escape(part[0]) + part[1:]
        out.append(part)
    return "/".join(out)


def layout_problems(members: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    """(member, problem) of an archive's (path, link target): one root, safe paths, links inside, no names that differ by case."""
    out, roots, seen = [], set(), {}
    for path, target in members:
        try:
            safe = safe_path(path)
        except ValueError:
            out.append((path, "unsafe"))
            continue
        roots.add(safe.split("/")[0])
        if seen.setdefault(safe.casefold(), safe) != safe:
            out.append((path, "case_collision"))
        if target is not None:
            import posixpath

            to = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
            if target.startswith("/") or to.split("/")[0] != path.split("/")[0]:
                out.append((path, "link_escapes"))
    return out + ([("", "several_roots")] if len(roots) > 1 else [])
