"""A trigram index over documents, stored, and the candidates that a plan of trigrams leaves.

The index is cut by documents into segments, each made by one task from rows that it reads: a trigram's documents are
numbers into the segment's list of keys, so a posting takes a few bits. Rows are partitioned by a bucket of the trigram
and sorted by it; a search reads the buckets of its plan's trigrams, brings the lists of a segment together and works
the plan out by set operations on them. A byte order mark is not indexed: files that begin with one are always candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.patterns import trigrams_of
from folioscan.sources.storage import exists, read_json, write_json

VERSION, BUCKETS, BOM = 2, 64, "\ufeff"
#: Bytes of texts whose trigrams are sorted at once (a longer text stands alone), which bounds a worker's memory.
PIECE = 4 << 20


def distinct_trigrams(text: str) -> np.ndarray:
    """Distinct runs of three characters, each as one number: 21 bits for a character."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]) if len(codes) > 2 else codes[:0]


def written_out(number: int) -> str:
    return chr(number >> 42) + chr(number >> 21 & 0x1FFFFF) + chr(number & 0x1FFFFF)


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) cut where the bytes of texts would pass `most`."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        low = held = 0
        for at, size in enumerate(sizes.tolist()):
            if at > low and held + size > most:
                yield batch.slice(low, at - low)
                low, held = at, 0
            held += size
        if low < batch.num_rows:
            yield batch.slice(low)


def _posted(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigrams of some texts, where each one's list ends, and the lists of texts' numbers one after the other."""
    found = [distinct_trigrams(t.as_py() or "") for t in texts]
    numbers = np.concatenate([np.empty(0, np.int64), *found])
    of = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    order = np.argsort(numbers, kind="stable")
    own, counts = np.unique(numbers, return_counts=True)
    return [written_out(n) for n in own.tolist()], np.cumsum(counts), of[order]


def postings(documents: DataFrame, key: str) -> DataFrame:
    """tri and key: which documents have a trigram. Distinct within each document, so nothing is shuffled."""
    kind = documents.schema[key].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            tris, ends, of = _posted(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), batch.column(0).take(pa.array(of)))
            yield pa.RecordBatch.from_arrays([pa.array(tris, pa.string()), lists], ["tri", "keys"])

    return documents.select(key, "text").mapInArrow(post, f"tri string, keys array<{kind}>").select("tri", F.explode("keys").alias(key))


def literal_trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def bucket(tri: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tri), F.lit(buckets)).cast("int")


def _schema(kind: str) -> str:
    return f"segment long, tri string, at array<int>, keys array<{kind}>, marked array<boolean>"


def write_index(documents: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of documents (key, text) to path: segments' keys, postings, and a manifest once all is there.

    The manifest tells the version, and the number and digest of the keys.
    """
    spark, kind = documents.sparkSession, documents.schema[key].dataType.simpleString()
    if exists(spark, f"{path}/manifest.json"):
        raise FileExistsError(path)
    schema = _schema(kind)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for made, batch in enumerate(pieces(batches, PIECE)):
            texts = [t.as_py() or "" for t in batch.column(1)]
            marked = [t.startswith(BOM) for t in texts]
            tris, ends, of = _posted(pa.array([t.removeprefix(BOM) for t in texts], pa.string()))
            n, keys = len(tris), batch.column(0)
            own = [pa.array([first + made]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32()))]
            own += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (keys, pa.array(marked))]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(of, pa.int32()))
            rows = [pa.array(np.full(n, first + made)), pa.array(tris, pa.string()), lists, pa.nulls(n, own[3].type), pa.nulls(n, own[4].type)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(own, rows, strict=True)], [c.split()[0] for c in schema.split(", ")])

    rows = documents.select(key, "text").mapInArrow(post, schema)
    # Segments' keys are in a bucket of their own.
    rows = rows.withColumn("bucket", F.when(F.col("tri").isNull(), -1).otherwise(bucket(F.col("tri"), buckets)))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(8))).sortWithinPartitions("bucket", "tri")
    dealt.write.partitionBy("bucket").parquet(f"{path}/segments")
    files = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/segments").filter("bucket = -1")
    write_json(spark, f"{path}/manifest.json", {"version": VERSION, "complete": True, "key": key, "kind": kind, "buckets": buckets, **_files_digest(files)})


def _files_digest(files: DataFrame) -> dict:
    """How many keys there are and a digest of them, whatever their order."""
    rows = files.select(F.explode("keys").alias("k"))
    row = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.xxhash64("k").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return {"files": row["files"], "digest": row["digest"]}


@dataclass(frozen=True)
class Index:
    """segments: segment, tri, at, keys, marked, bucket."""

    segments: DataFrame
    key: str
    buckets: int

    def files(self) -> DataFrame:
        """key and marked (whether the file begins with a byte order mark) of all files."""
        rows = self.segments.filter("bucket = -1").select(F.explode(F.arrays_zip("keys", "marked")).alias("f"))
        return rows.select(F.col("f.keys").alias(self.key), F.col("f.marked").alias("marked"))

    def lists(self, tris: list[str]) -> DataFrame:
        """segment, tri and at of some trigrams, from the buckets that can have them."""
        spark = self.segments.sparkSession
        places = spark.range(1).select(F.explode(F.array(*[bucket(F.lit(t), self.buckets) for t in tris]) if tris else F.array().cast("array<int>")).alias("b"))
        return self.segments.filter(F.col("bucket").isin([r["b"] for r in places.distinct().collect()]) & F.col("tri").isin(tris)).select("segment", "tri", "at")

    def candidates(self, plan: object) -> DataFrame:
        """Keys of the files that a plan leaves, and of those with a byte order mark."""
        if plan is True:
            return self.files().select(self.key)
        listed = self.lists(trigrams_of(plan)).groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("tri", "at"))).alias("_m"))

        def of(tri: Column) -> Column:
            return F.coalesce(F.try_element_at("_m", tri), F.array().cast("array<int>"))

        def worked_out(part: object) -> Column:
            if isinstance(part, str):
                return of(F.lit(part))
            if part[0] == "and":
                return reduce(F.array_intersect, [worked_out(p) for p in part[1]])
            plain = [p for p in part[1] if isinstance(p, str)]
            lists = [F.transform(F.array(*map(F.lit, plain)), of)] if plain else []
            others = [worked_out(p) for p in part[1] if not isinstance(p, str)]
            return F.array_distinct(F.flatten(F.concat(*lists, *([F.array(*others)] if others else []))))

        keys = self.segments.filter("bucket = -1").select("segment", "keys", "marked")
        found = keys.join(listed.select("segment", worked_out(plan).alias("_at")), "segment", "left")
        chosen = F.filter(F.arrays_zip("keys", "marked"), lambda f: f["marked"])
        marked = found.select(F.explode(chosen).alias("f")).select(F.col("f.keys").alias(self.key))
        return found.select(F.explode("_at").alias("i"), "keys").select(F.element_at("keys", F.col("i") + 1).alias(self.key)).unionByName(marked).distinct()


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that is complete, of this version, and has the files that its manifest tells; others are an error."""
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"no complete index in {path}")
    told = read_json(spark, f"{path}/manifest.json")
    if not told.get("complete") or told.get("version") != VERSION:
        raise ValueError(f"incomplete or incompatible index in {path}")
    segments = spark.read.schema(f"{_schema(told['kind'])}, bucket int").parquet(f"{path}/segments")
    found = Index(segments, told["key"], told["buckets"])
    if _files_digest(segments.filter("bucket = -1")) != {"files": told["files"], "digest": told["digest"]}:
        raise ValueError(f"the index in {path} doesn't have the files of its manifest")
    return found


def read_index(spark: SparkSession, path: str, literal: str) -> DataFrame:
    """tri and key: postings of a literal's trigrams."""
    index = open_index(spark, path)
    keys = index.segments.filter("bucket = -1").select("segment", "keys")
    rows = index.lists(literal_trigrams(literal)).join(keys, "segment").select("tri", F.explode("at").alias("i"), "keys")
    return rows.select("tri", F.element_at("keys", F.col("i") + 1).alias(index.key))


def candidates(index: DataFrame, documents: DataFrame, key: str, literal: str) -> DataFrame:
    """Keys of the documents that have all trigrams of a literal, from postings (tri, key); all documents for one that is too short."""
    wanted = literal_trigrams(literal)
    if not wanted:
        return documents.select(key)
    return index.filter(F.col("tri").isin(wanted)).groupBy(key).agg(F.countDistinct("tri").alias("_n")).filter(F.col("_n") == len(wanted)).select(key)
