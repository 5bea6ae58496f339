"""A training-corpus pipeline: five stages over documents, each writing its result for the next.

In every stage columns keep their names and values, whatever these are. Null and empty texts have no words, so the
quality stage drops them; null languages and character counts play no part, a null source is a source of its own. A row
without an id is never taken for a copy and packs like others. Rows repeated as wholes count as copies, of which one
stays; unlike texts that share an id all stay. An empty table goes through to an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import mixing, ngram_join, packing, quality_rules, toxicity
from folioscan.llm.common import shared_folder
from folioscan.llm.queries import tokenizer_path

WEIGHTS, SHARE, EPOCHS, TOXIC = (5, 2, 1), 1.5, 2.0, 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Each is judged alone; one without words fails."""
    return quality_rules.filtered(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model of the labelled ones among docs. Without labels none is."""
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"_toxic_{uuid.uuid4().hex}"  # no column of docs
    return toxicity.with_score(docs, model, score).filter(F.col(score) < TOXIC).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id."""
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: whole, so a source exceeds its target by less than a text."""
    return mixing.mixed(docs, WEIGHTS, SHARE, EPOCHS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids (ids: little-endian unsigned 32-bit numbers), and where in which sequence they stand.

    A repeated document has its pieces as often as it occurs.
    """
    return packing.report(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("mixture", mix), ("packing", pack)]

#: Training, similarity joins and tokenizing aren't SQL.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the session's shared folder and read again.

    A stage's folder is removed once the next one is written; the last one's stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
