"""The training-data queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatemeter.llm import bestfit, chat, licences, neardup, packing, pages, pieces, quality, secrets, simhash
from gatemeter.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _over(name: str, function: Callable[[DataFrame], DataFrame], source: str = "documents") -> None:
    QUERIES[name] = lambda spark, sf_dir: function(table(spark, sf_dir, source))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_over("op6_repetition_coverage", quality.query)
_over("op2_best_fit_matrices", bestfit.pack_matrices)
_over("op10_cost_balanced_packing", packing.pack_documents)
_over("op1_prefix_targets", chat.query, "conversations")
ORACLES["op1_prefix_targets"] = chat.ORACLE
_over("op3_simhash", simhash.query)
_over("op4_minhash_neardup", neardup.query)
ORACLES["op4_minhash_neardup"] = neardup.ORACLE
_over("op9_licence_digests", licences.query)
ORACLES["op9_licence_digests"] = licences.ORACLE
_over("op7_secret_crf", secrets.query)
_over("op8_sentencepiece", pieces.query)
QUERIES["pipeline"] = _pipeline
_over("op5_wrapper_extraction", pages.query, "pages")
