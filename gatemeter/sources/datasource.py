"""A data source for rule bundles: ``spark.read.format("rulebundle").load(path)``.

Register it with ``spark.dataSource.register(RuleBundleSource)``. Files are read where the
workers run, so the path must be one that they all see; ``bundles.read`` takes any path that
Spark reads.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gatemeter.model import RULE_DDL
from gatemeter.sources.bundles import parse


class RuleBundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rulebundle"

    def schema(self) -> str:
        return RULE_DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        """One bundle file each."""
        found = sorted(glob.glob(os.path.join(self.path, "*.json"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(x) for x in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            rules, _ = parse(f.read())
        for r in rules:
            bindings = [(b.channel, b.eligible, b.logic, list(b.conditions), b.suppress_in_code, [tuple(g) for g in b.gates]) for b in r.bindings]
            yield (
                r.id, r.source, r.source_id, r.title, r.surface, r.breadth, r.kind, list(r.patterns), r.case_sensitive, r.not_runnable_reason, r.lane, r.restricted, r.source_path, list(r.examples), list(map(tuple, r.lineage)), bindings,
            )
