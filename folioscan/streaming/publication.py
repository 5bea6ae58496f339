"""Generations built from a stream of files: each batch of new or changed files makes the next generation.

A generation is a set of content: its name is a digest of the documents that it has, so that the same documents give
the same name. A batch is published in two steps, each one small file written once: `prepared` names the batch, the
generation before it and its own; after that its tables are written under its name; then the pointer is replaced.
A batch that is run again, after a crash at any place between these, finds what is there and goes on: it makes the same
name, doesn't write tables that are complete, and leaves one generation. New files are discovered by the stream alone,
each once; a file that comes again under its path replaces its earlier text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.sources.corpus import described
from folioscan.sources.storage import exists, read_json, write_json

Step = Callable[[str, int], None]


def generation_name(documents: DataFrame) -> str:
    """A digest of documents (doc_key, text_sha256), whatever their order."""
    row = documents.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(s), "doc_key", "text_sha256").cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"d{s}") for s in (1, 2)]).first()
    return "g" + short_digest(f"{row['n']}:{row['d1']}:{row['d2']}")


def short_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:40]


def current(spark: SparkSession, root: str) -> dict | None:
    """The published generation: its name and the batch that made it."""
    return read_json(spark, f"{root}/current.json") if exists(spark, f"{root}/current.json") else None


def documents_of(spark: SparkSession, root: str, name: str | None) -> DataFrame:
    if name is None:
        return spark.createDataFrame([], "doc_key string, path string, text string, text_sha256 string, source_bytes long, batch long")
    return spark.read.parquet(f"{root}/{name}/documents")


def publish(batch: DataFrame, number: int, root: str, step: Step = lambda name, number: None) -> str:
    """Publish the generation after the current one: its documents, replaced and joined by those of a batch (path, text).

    `step` is told of each step done, for those who watch. A batch at or before the published one changes nothing.
    """
    spark = batch.sparkSession
    now = current(spark, root)
    if now is not None and now["batch"] >= number:
        return now["generation"]
    before = documents_of(spark, root, now and now["generation"])
    new = described(batch.groupBy("path").agg(F.max_by("text", "at").alias("text")), F.col("path"))
    new = new.select("doc_key", "path", "text", "text_sha256", "source_bytes", F.lit(number).cast("long").alias("batch"))
    kept = before.join(new.select("doc_key"), "doc_key", "left_anti").select(*new.columns)
    whole = kept.unionByName(new)
    name = generation_name(whole)
    told = f"{root}/prepared/{number:012d}.json"
    if exists(spark, told):
        if read_json(spark, told)["generation"] != name:
            raise ValueError(f"batch {number} was prepared as another generation")
    else:
        write_json(spark, told, {"batch": number, "generation": name, "before": now and now["generation"]})
    step("prepared", number)
    if not exists(spark, f"{root}/{name}/documents/_SUCCESS"):
        whole.write.mode("overwrite").parquet(f"{root}/{name}/documents")
    step("written", number)
    found = generation_name(documents_of(spark, root, name))
    if found != name:
        raise ValueError(f"generation {name} isn't what was prepared")
    write_json(spark, f"{root}/current.json", {"batch": number, "generation": name}, overwrite=True)
    step("published", number)
    return name


def follow(files: DataFrame, root: str, step: Step = lambda name, number: None) -> StreamingQuery:
    """Run a stream of files (path, text, at) to its present end. What was published under root goes on from there."""
    return (
        files.writeStream.option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
        .foreachBatch(lambda batch, number: publish(batch, number, root, step)).start()
    )


def text_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the text files in a folder and below: path in it, whole text, and the time of the file."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    stream = rows.schema("value string").load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("at"))
    path = F.url_decode(F.regexp_replace(F.substring_index("_path", base, -1), r"\+", "%2B"))
    return stream.select(path.alias("path"), "text", "at")
