"""Classifiers as plain columns: exposure, topic, file type, surfaces, breadth, lineage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TOPIC = r"(?i)\b(security|vulnerabilit\w*|malware|prompt injection|penetration|exploit\w*)\b"
SECURITY_PATH = r"(?i)security|threat|attack|inject|secret|vulnerab|pentest|audit|red.team"
NETWORK_COMMAND = r"(?i)\b(curl|wget|Invoke-WebRequest|Invoke-RestMethod)\b|\bgh\s+(api|issue|pr)\b|requests\.(get|post)|urllib\.request|https?://"
READER_COMMAND = r"(?i)\b(cat|type|Get-Content|head|tail|sed|grep|rg)\b|read_text|read_bytes|open\("
WEB_TOOLS = ("WebFetch", "WebSearch")
SHELL_TOOLS = ("Bash", "PowerShell")
FILE_TOOLS = ("Read", "Grep", "Edit", "MultiEdit", "Skill")
LOCAL_TOOLS = (
    "Glob", "LS", "Write", "NotebookEdit", "TodoWrite", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskStop",
    "AskUserQuestion", "EnterPlanMode", "ExitPlanMode", "KillBash", "KillShell", "ToolSearch",
)
CORPUS_MARKERS = ("garak", "corpus", "benchmark", "DoNotAnswer")
TRIAL_DEFINITIONS = {
    "CFG": "One complete configuration or repository file at rest.",
    "IN": "One complete tool invocation payload, including its name and arguments.",
    "OUT": "One complete tool result payload from one invocation, with chunks reassembled.",
    "PROMPT": "One complete user message.",
    "PIN": "One complete before/after comparison of a pinned artifact.",
    "NONE": "No interception surface; diagnostic text matching only.",
}


def _cases(cases: list[tuple[Column, str]], other: str | Column | None) -> Column:
    """The value of the first condition that is true; a null condition is not."""
    out = None
    for when, value in cases:
        out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
    return out.otherwise(F.lit(other) if isinstance(other, str) or other is None else other)


def exposure(tool: Column, command: Column) -> Column:
    """Who may have written what a tool returns."""
    command = F.coalesce(command, F.lit(""))
    shell = tool.isin(*SHELL_TOOLS)
    return _cases(
        [
            (tool.isin(*WEB_TOOLS), "attacker-reachable"), (shell & command.rlike(NETWORK_COMMAND), "network-command-mixed"),
            (shell & command.rlike(READER_COMMAND), "file-origin-unknown"), (shell, "locally-generated"), (tool.isin(*FILE_TOOLS), "file-origin-unknown"),
            (tool.isin(*LOCAL_TOOLS), "locally-generated"), (tool.startswith("mcp__"), "external-tool-unknown"),
        ],
        "mixed-or-unknown",
    )


def prose(text: Column) -> Column:
    """The topic stratum of a text."""
    return F.when(text.rlike(TOPIC), "security-adjacent").otherwise("ordinary")


def path_prose(path: Column) -> Column:
    return F.when(path.rlike(SECURITY_PATH), "security-adjacent").otherwise("ordinary")


def file_type(path: Column) -> Column:
    """SKILL.md, .agent.md, README, the lower-case suffix, or no_extension."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    return _cases([(name == "SKILL.md", "SKILL.md"), (name.endswith(".agent.md"), ".agent.md"), (F.lower(name).startswith("readme"), "README")], F.when(suffix != "", suffix).otherwise("no_extension"))


def rule_surface(method: Column, target: Column, fields: Column, source_kind: Column, category: Column) -> Column:
    """Where a rule of the YAML corpus applies. `fields` are its conditions' distinct fields."""
    only = lambda name: (F.size(fields) == 1) & F.array_contains(fields, name)
    return _cases(
        [
            (method.isin("trace", "behavioral"), "NONE"), (target == "skill", "CFG"), (target == "user_input", "PROMPT"), (target.isin("tool_args", "tool_call"), "IN"),
            (target.isin("tool_output", "tool_response"), "OUT"), (only("tool_description"), "CFG"), (only("user_input"), "PROMPT"),
            ((F.size(fields) > 0) & (F.size(F.array_except(fields, F.array(*map(F.lit, ("tool_name", "tool_args", "tool_input"))))) == 0), "IN"),
            (F.array_contains(fields, "tool_response") | only("agent_output"), "OUT"), (source_kind == "tool_call", "IN"), (category.isin("skill-compromise", "tool-poisoning"), "CFG"),
        ],
        "OUT",
    )


def audit_surface(rule_id: Column, pinned: str = "AAK-RUGPULL-", reference_only: tuple[str, ...] = ("AAK-INTERNAL-SCANNER-FAIL", "AAK-OX-COVERAGE-MANIFEST-001", "AAK-PRISMA-AIRS-COVERAGE-001", "AAK-MCP-LINEAGE-STAINLESS-001")) -> Column:
    """Surface of an audit registry's row: a comparison with a pin, no surface, or a file at rest."""
    return _cases([(rule_id.startswith(pinned), "PIN"), (rule_id.isin(*reference_only), "NONE")], "CFG")


def audit_breadth(rule_id: Column, n_cves: Column, composed: str = "AAK-COMPOSE-", pinned: str = "AAK-RUGPULL-") -> Column:
    return _cases([(rule_id.startswith(composed), "BROAD"), ((n_cves > 0) | rule_id.startswith(pinned), "NARROW")], "MEDIUM")


def generated_surface(target_kind: Column, surface: Column, family: Column) -> Column:
    """Surface of a generated registry's row."""
    return _cases([((target_kind == "artifact") & (surface == "build"), "CFG"), (family == "output", "OUT")], "NONE")


def lineage(author: Column, project_authors: tuple[str, ...] = ()) -> Column:
    """(classification, spans in parentheses, corpus markers) of an author field."""
    markers = F.filter(F.array(*map(F.lit, CORPUS_MARKERS)), lambda m: F.lower(author).contains(F.lower(m)))
    kind = _cases([(F.size(markers) > 0, "corpus_or_benchmark"), (author.isin(*project_authors) if project_authors else F.lit(False), "project_attribution")], "other_attribution")
    return F.struct(kind.alias("classification"), F.regexp_extract_all(author, F.lit(r"(\([^()]*\))"), F.lit(1)).alias("spans"), markers.alias("markers"))


def origin_id(url: Column, hosts: tuple[str, ...], pattern: str) -> Column:
    """The rule id in the path of a URL of an allowed host; null otherwise."""
    found = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), pattern, 1)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & (found != ""), found)


def masked(reason: Column) -> Column:
    """A reason with its figures masked, by which like reasons are grouped."""
    return F.regexp_replace(reason, r"[0-9]+(?:\.[0-9]+)?", "#")


def text_blocks(kinds: Column, texts: Column) -> Column:
    """Text blocks joined by newlines; null if any block isn't text."""
    return F.when(F.forall(kinds, lambda k: F.coalesce(k == "text", F.lit(False))) & F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, "\n"))


def min_conditions(n: Column) -> Column:
    """How many conditions must hold for a document to count: 30 % of them, two at least."""
    return F.greatest(F.lit(2), F.ceil(n * F.lit(0.3)).cast("int"))


def skill_gate(exempt: Column, logic: Column, n: Column) -> Column:
    """Whether a rule can reach the required conditions; `any` stops at one."""
    reach = F.when(logic == "all", n).otherwise(1)
    return F.coalesce(exempt, F.lit(False)) | (reach >= min_conditions(n))
