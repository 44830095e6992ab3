"""Queries: live events, leaf walks, allowances, rolling rates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.functions import text as text_functions
from gatemeter.model import Rule
from gatemeter.operators import events, match
from gatemeter.session import table
from gatemeter.streaming import monitor

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@query("byte_allowance", """SELECT conv_id, turn, role, before < 2000 AS scheduled, before < 2000 AND before + size > 2000 AS truncated FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT conv_id, turn, role, octet_length(encode(coalesce(text, ''))) AS size FROM conversations))""")
def byte_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of a conversation a running allowance of 2,000 bytes reaches."""
    return match.byte_allowance(table(spark, sf_dir, "conversations"), 2000, "conv_id", "turn").select("conv_id", "turn", "role", "scheduled", "truncated")


@query("leaf_walk_events", "SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS text FROM events")
def leaf_walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of JSON with their pointers (numbers are quoted here to be leaves)."""
    quoted = F.regexp_replace("props", r": ([0-9]+)", r': "$1"')
    walked = table(spark, sf_dir, "events").select("event_id", F.explode(text_functions.leaves_of(quoted)).alias("x"))
    return walked.select("event_id", "x.path", "x.text")


RULES = [
    Rule("e:deny", "SUBSTRING_ALL", ("la", "token"), surface="OUT"), Rule("e:advise", "REGEX", ("[Cc]opyright",), surface="OUT"), Rule("e:call", "SUBSTRING_ANY", ("the",), surface="IN"), Rule("e:note", "REGEX", ("[0-9]{4}",), surface="IN"),
]
LANES = {"e:deny": "DENY", "e:advise": "ADVISE", "e:call": "DENY", "e:note": "RECORD"}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events, every second one a call."""
    said = F.struct(F.when(F.col("doc_id") % 2 == 0, "PostToolUse").otherwise("PreToolUse").alias("hook_event_name"), F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("text").alias("body"), F.array("lang").alias("tags"))).alias("tool_response"), F.when(F.col("doc_id") % 2 == 1, F.struct(F.col("text").alias("command"))).alias("tool_input"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.to_json(said).alias("payload"))


_d = "contains(lower(coalesce(text, '')), 'la') AND contains(lower(coalesce(text, '')), 'token')"


@query("event_decisions", f"""SELECT doc_id AS event_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN {_d} THEN 'withhold' WHEN regexp_matches(text, '(?i)copyright') THEN 'advise' ELSE 'allow' END ELSE CASE WHEN text IS NULL THEN 'allow' WHEN contains(lower(text), 'the') THEN 'deny' ELSE 'allow' END END AS action, false AS incomplete FROM documents""")
def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to answer to each event."""
    config = events.Config(limits=events.Limits(seconds=30.0))
    return events.decisions(payloads(spark, sf_dir), RULES, LANES, config).select("event_id", "action", "incomplete")


@query("redact_leaves", f"""SELECT doc_id AS event_id, concat('{{"body": "{events.WITHHELD}", "tags": [', CASE WHEN lang IS NULL THEN 'null' ELSE concat('"', lang, '"') END, ']}}') AS updated FROM documents WHERE doc_id % 2 = 0 AND {_d}""")
def redact_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with the withheld leaves replaced."""
    config = events.Config(limits=events.Limits(seconds=30.0))
    return events.decisions(payloads(spark, sf_dir), RULES, LANES, config).where("updated IS NOT NULL").select("event_id", "updated")


@query("event_edge_cases")
def event_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown events, missing payloads, bad JSON and deep trees."""
    deep: object = "token"
    for _ in range(80):
        deep = [deep]
    rows = [
        ("unknown", json.dumps({"hook_event_name": "Stop"})), ("missing_in", json.dumps({"hook_event_name": "PreToolUse"})), ("missing_out", json.dumps({"hook_event_name": "PostToolUse"})), ("bad", "{"), ("null", None),
        ("deep", json.dumps({"hook_event_name": "PostToolUse", "tool_response": deep})), ("clean", json.dumps({"hook_event_name": "PostToolUse", "tool_response": {"a": ["", "b"]}})),
    ]
    df = spark.createDataFrame(rows, "event_id string, payload string")
    return events.decisions(df, RULES, LANES).select("event_id", "action", "incomplete", "n_leaves", F.size("records").alias("n_records"))


@query("rolling_firing_rate", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS trials, count(*) FILTER (value > 50) AS hits FROM events GROUP BY 1, 2")
def rolling_firing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firing rates of hourly windows by type."""
    out = monitor.rates(table(spark, sf_dir, "events"), F.col("value") > 50, by=("event_type",))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "trials", "hits")


@query("session_rates", """WITH g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS n FROM events))
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS trials, count(*) FILTER (value > 50) AS hits FROM g GROUP BY user_id, s""")
def session_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firing rates of each user's sessions."""
    out = monitor.sessions(table(spark, sf_dir, "events"), F.col("value") > 50, "user_id")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "trials", "hits")
