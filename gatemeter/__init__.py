"""Measure how often text-detection rules fire, on Spark, and decide what each rule may do.

The names below are loaded when they are asked for, so that workers import only what they run.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOME = {
    "gatemeter.functions.screen": ("native_safe", "refusal", "screen_pattern"),
    "gatemeter.functions.stats": ("bound_within", "trials_needed", "u95", "upper_bound", "within"),
    "gatemeter.model": ("KINDS", "LANES", "SURFACES", "Binding", "Rule", "rules_list", "rules_table"),
    "gatemeter.operators.admission": ("active_rules", "admitted", "effective", "promotion", "reachability"),
    "gatemeter.operators.events": ("Config", "Limits", "decisions", "findings_log"),
    "gatemeter.operators.match": ("coverage", "findings", "match_native", "match_python", "scan_documents"),
    "gatemeter.operators.measure": ("bundle_failures", "bundle_hits", "combine", "corpus_digest", "corpus_tree_digest", "lanes", "rule_hits", "with_bounds"),
}
__all__ = sorted(name for names in _HOME.values() for name in names)


def __getattr__(name: str):
    for home, names in _HOME.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
