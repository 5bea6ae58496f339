"""Queries over the test tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import (
    blockmax, fingerprints, langid, licenses, lm, mixing, ngram_join, packing, quality_rules, resampling, sharding, toxicity, warc,
)
from folioscan.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": lambda spark, d: ngram_join.report(documents(spark, d)),
        "op2_toxicity": lambda spark, d: toxicity.report(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op3_fingerprints": lambda spark, d: fingerprints.report(documents(spark, d)),
        "op4_log_bilinear": lambda spark, d: lm.report(documents(spark, d)),
        "op5_warc_revisits": lambda spark, d: warc.report(spark.read.parquet(f"{d}/pages.parquet")),
        "op6_language": lambda spark, d: langid.report(documents(spark, d)),
        "op7_interleaved_shards": lambda spark, d: sharding.report(documents(spark, d)),
        "op8_best_fit_packing": lambda spark, d: packing.report(documents(spark, d), tokenizer_path()),
        "op9_quality_rules": lambda spark, d: quality_rules.report(documents(spark, d)),
        "op10_source_mix": lambda spark, d: mixing.report(documents(spark, d)),
        "op11_license_scan": lambda spark, d: licenses.report(documents(spark, d)),
        "op12_block_max_search": lambda spark, d: blockmax.report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op13_importance_resampling": lambda spark, d: resampling.report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    }
