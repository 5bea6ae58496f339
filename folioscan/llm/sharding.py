"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded key; a row's fractional rank is its place among its source's rows.
All rows are sorted by fractional rank and cut into shards of equal row counts, so that each shard has the mixture of
the whole table, and so has each stretch of a shard.

Ranks come from counts over key ranges and windows over a single range; no task holds a whole source. Repeated rows
are sharded as separate rows; a null source is a source of its own; a null text has no bytes; an empty table gives no
rows. Copies of a text are not kept together: the law is `rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import key_range, key_ranges, prefix_sums, random_key, settle, source_key


def interleaved(df: DataFrame, shards: int, seed: int = 7, source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (gapless from 0 in each shard) of each row of df."""
    body = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    narrow = settle(
        df.select(
            F.col(id_column).alias("doc_id"),
            F.col(source).alias("source"),
            source_key(source).alias("_source"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
        ).withColumn("_key", random_key(seed, F.col("doc_id")))
    )
    total = narrow.count()
    ranges = key_ranges(df.sparkSession, total)
    order = ["_key", "doc_id", "text_crc32", "size"]
    ranked = prefix_sums(narrow.withColumns({"_range": key_range("_key", ranges), "_one": F.lit(1)}), ["_source"], order, "_one", "_rank")
    sources = narrow.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    # Twice the middle of the row's share of its source, cut into as many equal ranges: (2 rank + 1) / (2 rows).
    ranked = settle(ranked.drop("_range").join(sources, "_source").withColumn("_share", (2 * F.col("_rank") + 1) / (2 * F.col("_rows"))))
    spread = ranked.withColumns({"_range": F.least(F.floor(F.col("_share") * ranges), F.lit(ranges - 1)), "_all": F.lit(0)})
    placed = prefix_sums(spread, ["_all"], ["_share", "_source", *order], "_one", "_place")
    shard = F.expr(f"_place * {shards} div {max(total, 1)}")
    first = F.expr(f"({'{0}'} * {total} + {shards - 1}) div {shards}".format("shard"))
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long")
    )


def report(df: DataFrame, shards: int = 24) -> DataFrame:
    return interleaved(df, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
