"""Structured Streaming: decisions on event streams, the findings log, rolling firing rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gatemeter.model import Rule
from gatemeter.operators.events import Config, decisions, findings_log


def event_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).format(kind).load(path)


def decide_stream(events: DataFrame, rules: list[Rule], lanes: dict[str, str], config: Config = Config(), id_col: str = "event_id", payload_col: str = "payload") -> DataFrame:
    """Stateless: each event is decided on its own, as in a batch."""
    return decisions(events, rules, lanes, config, id_col, payload_col)


def append_log(decided: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly one line an event with records; a restart goes on from the checkpoint."""
    return findings_log(decided).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, fired: Column, ts: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, by, trials, hits) over event time; late events count until the watermark.

    Timestamps without a zone are read in the session's zone, as watermarks need instants.
    """
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("_fired", fired)
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    w = F.window("_at", window, slide) if slide else F.window("_at", window)
    return timed.groupBy(w.alias("_w"), *by).agg(F.count("*").alias("trials"), F.count_if("_fired").alias("hits")).select(F.col("_w.start").alias("window_start"), *by, "trials", "hits")


def sessions(events: DataFrame, fired: Column, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, trials, hits): runs of events with no longer gap."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("_fired", fired)
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("_at", gap).alias("_w"), key).agg(F.count("*").alias("trials"), F.count_if("_fired").alias("hits"))
    return out.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "trials", "hits")
