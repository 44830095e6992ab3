"""Registered queries of the rule engine, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatemeter.plans import auditing, joining, living, loading, matching, measuring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (matching, measuring, joining, living, auditing, loading):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
