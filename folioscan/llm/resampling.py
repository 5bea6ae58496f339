"""Importance resampling towards a target distribution, over a persisted matrix of documents by buckets of n-grams.

The matrix is a table of CSR blocks, each a stretch of rows that one task read: ids, row ends, buckets and counts. Its
column sums, added up within each task and then by bucket, are the corpus's distribution, and those of a target's
matrix the target's. A bucket's gain is 1000 times the log of its smoothed share in the target against that in the
corpus, and a block's product with the gains gives its documents' weights. Only the gains, one number for each bucket,
go through the driver and to every task. A seeded Gumbel term is added to a weight, so that the highest scores are a
draw without replacement with chances in proportion to exp(weight / 1000).

A null text has no words, weighs 0 and is never drawn (it has fewer words than any draw asks for; with least_words = 0
it may be). A null id draws like an empty one and comes last among equal scores. Repeated rows are drawn each; equal in
id and score, either comes first. An empty table gives no rows, an empty target has smoothed shares only. Extra columns
aren't read. A text is a row of one block, whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import new_folder, remove, settle, terms

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Features in a block of the matrix (about), and words whose buckets a worker keeps.
BLOCK, MOST_WORDS = 500_000, 300_000
#: Blocks in a file of the matrix. Spark's reader decodes thousands of rows at once, so a file bounds what a task holds.
BLOCKS = 4

MATRIX = "block long, ids array<long>, words array<int>, ends array<int>, buckets array<int>, counts array<int>"
_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64()))] + [(n, pa.list_(pa.int32())) for n in ("words", "ends", "buckets", "counts")])


class Buckets(dict):
    """The bucket of each feature: its crc32 modulo their number."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def features(words: list[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def csr(block: int, ids: list[int | None], words: list[int], found: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One block from the buckets of each row's features, with repeats."""
    row = np.repeat(np.arange(len(ids)), [len(f) for f in found])
    cells, counts = np.unique(row * buckets + np.concatenate(found), return_counts=True)
    ends = np.searchsorted(cells, np.arange(1, len(ids) + 1) * buckets)
    columns = [[block], [ids], [words], [ends], [cells % buckets], [counts]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def counted(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Write the matrix of all of docs to path, a folder that driver and executors share, and read it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, made, first = Buckets(buckets), 0, TaskContext.get().partitionId() << 32
        ids, words, found, held = [], [], [], 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                own = terms(body.as_py())
                ids.append(doc_id.as_py())
                words.append(len(own))
                found.append(np.fromiter((bucket[f] for f in features(own, longest)), np.int64))
                held += len(found[-1]) + 1
                if held >= BLOCK:
                    yield csr(first + made, ids, words, found, buckets)
                    made += 1
                    ids, words, found, held = [], [], [], 0
        if ids:
            yield csr(first + made, ids, words, found, buckets)

    docs.select(F.col(id_column).cast("long"), F.encode(F.col(text), "utf-8")).mapInArrow(build, MATRIX).write.option("maxRecordsPerFile", BLOCKS).parquet(path)
    return docs.sparkSession.read.schema(MATRIX).parquet(path)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; at most `buckets` rows come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for cells, counts in zip(batch.column(0), batch.column(1), strict=True):
                np.add.at(sums, np.asarray(cells.values), np.asarray(counts.values, np.int64))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for row in matrix.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target against that in the corpus, one added to each count."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    shares = (((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(share)) for share in shares], np.int64)


def weighed(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """block, row, doc_id, n_words, n_features and weight of each document: the matrix's product with the gains."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    schema = "block long, row int, doc_id long, n_words long, n_features long, weight long"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends, cells, counts = (np.asarray(batch.column(c)[i].values, np.int64) for c in (3, 4, 5))
                n, bounds = len(ends), np.r_[0, ends]
                parts = [np.r_[0, np.cumsum(v)][bounds] for v in (counts, counts * shared.value[cells])]
                columns = [np.full(n, batch.column(0)[i].as_py()), np.arange(n, dtype=np.int32), None, np.asarray(batch.column(2)[i].values, np.int64), *map(np.diff, parts)]
                arrays = [batch.column(1)[i].values if c is None else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return matrix.mapInArrow(multiply, schema)


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Add score: the weight and 1000 times a Gumbel number that the seed and the id determine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weights.withColumn("score", F.col("weight") + gumbel)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Add rank, 1 for the highest score, null beyond `most`. Ranges of the order are ranked each, from what stands before them."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("row")]
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Kept, so that a range stays what it was counted as.
    ranges = settle(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before, starts = 0, []
    for r, n in sorted(ranges.groupBy("_range").count().collect()):  # one row for each range
        starts.append((r, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    found = ranges.join(starts, "_range").withColumn("rank", place.cast("long")).drop("_range", "_before")
    return found.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))


def resampled(docs: DataFrame, target: DataFrame, folder: str, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, target_id: str = "item_id") -> DataFrame:
    """Each document's doc_id, n_words, n_features, weight, score and rank; rank is null unless drawn.

    Drawn are `percent` of the documents of least_words words or more. Both matrices stay in folder.
    """
    matrix = counted(docs, f"{folder}/corpus", buckets=buckets, longest=longest)
    gain = gains(column_sums(matrix, buckets), column_sums(counted(target, f"{folder}/target", target_id, buckets=buckets, longest=longest), buckets))
    rows = settle(scored(weighed(matrix, gain), seed))
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = ranked(enough, percent * enough.count() // 100)
    return drawn.unionByName(rows.filter(F.col("n_words") < least_words), allowMissingColumns=True).drop("block", "row")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The matrices are removed once the weights are taken: resampled() keeps those."""
    spark = docs.sparkSession
    folder = new_folder(spark, "matrix")
    found = resampled(docs, target, folder)
    remove(spark, folder)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
