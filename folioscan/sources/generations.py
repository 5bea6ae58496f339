"""Generations of an index: tables of one build in one folder, and a pointer that is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.lines import lines
from folioscan.operators.trigram import postings


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def publish(documents: DataFrame, root: str) -> str:
    """Write documents (doc_key, path, text, digests), their lines and postings; then point to them. A failed build leaves the pointer as it was."""
    spark, name = documents.sparkSession, f"g{uuid.uuid4().hex}"
    folder = f"{root}/generation={name}"
    documents.write.parquet(f"{folder}/documents")
    stored = spark.read.parquet(f"{folder}/documents")
    check(stored)
    lines(stored, "doc_key", "path").write.parquet(f"{folder}/lines")
    postings(stored, "doc_key").write.parquet(f"{folder}/postings")
    summary = stored.agg(F.lit(name).alias("generation"), F.count(F.lit(1)).alias("documents"), F.sum("source_bytes").alias("source_bytes"), F.bit_xor(F.xxhash64("doc_key", "text_sha256")).alias("digest"))
    summary.coalesce(1).write.json(f"{root}/pointers/{name}")
    fs, new = _fs(spark, f"{root}/CURRENT.{name}")
    stream = fs.create(new, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    current = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    # One step: readers see the pointer before or after it, never none.
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(current), how)
    return name


def check(documents: DataFrame) -> None:
    """Paths and keys are unique, and digests are those of the texts."""
    bad = documents.groupBy("path").count().filter("count > 1").limit(1).count() + documents.filter("sha2(text, 256) <> text_sha256 OR doc_key <> substr(sha2(path, 256), 1, 24)").limit(1).count()
    if bad:
        raise ValueError("documents repeat a path or don't match their digests")


def current(spark: SparkSession, root: str) -> str:
    fs, path = _fs(spark, f"{root}/CURRENT")
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(path) else ""


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current generation, its digest checked."""
    name = current(spark, root)
    if not name:
        raise FileNotFoundError(f"no generation in {root}")
    tables = {t: spark.read.parquet(f"{root}/generation={name}/{t}") for t in ("documents", "lines", "postings")}
    told = spark.read.json(f"{root}/pointers/{name}").first()
    now = tables["documents"].agg(F.bit_xor(F.xxhash64("doc_key", "text_sha256")).alias("d")).first()["d"]
    if now != told["digest"]:
        raise ValueError(f"generation {name} isn't what was published")
    return tables
