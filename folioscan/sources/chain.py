"""Ledgers of lines in hash chains: appends by one writer at a time, under budgets, to many ledgers at once.

A line's digest covers its number, the digest before it and its payload. An append reads each ledger's head, goes on
from there, and is either there as a whole or not at all: its lines are written to a folder of its own, and one small
file, which only one writer can create, commits it. What isn't committed is never read. A ledger whose budget an
append would break takes none of the append's lines; the others aren't touched by that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.accounting import chain_breaks
from folioscan.sources.storage import exists, read_json, write_json

LINE = "ledger string, sequence long, previous_sha256 string, payload string, sha256 string, bytes long"
_COLUMNS = [c.split()[0] for c in LINE.split(", ")]


@dataclass(frozen=True)
class Budget:
    """The most lines and bytes of a ledger, and bytes of a line."""

    lines: int = 1024
    ledger_bytes: int = 4 << 20
    line_bytes: int = 65536


class Taken(Exception):
    """Another writer has committed this append."""


def digest(sequence: int, before: str | None, payload: str) -> str:
    return hashlib.sha256(f"{sequence}|{before or ''}|{payload}".encode()).hexdigest()


def commits(spark: SparkSession, root: str) -> list[str]:
    """The folders of the committed appends, in order."""
    found: list[str] = []
    while exists(spark, f"{root}/commits/{len(found):09d}.json"):
        found.append(read_json(spark, f"{root}/commits/{len(found):09d}.json")["folder"])
    return found


def read(spark: SparkSession, root: str) -> DataFrame:
    """All lines of committed appends."""
    folders = [f"{root}/lines/append={name}" for name in commits(spark, root)]
    if not folders:
        return spark.createDataFrame([], f"{LINE}, append int")
    rows = spark.read.schema(f"{LINE}, append string").option("basePath", f"{root}/lines").parquet(*folders)
    return rows.withColumn("append", F.substring_index("append", "-", 1).cast("int"))


def heads(lines: DataFrame) -> DataFrame:
    """ledger, and its last digest, number of lines and bytes."""
    return lines.groupBy("ledger").agg(F.max_by("sha256", "sequence").alias("head"), F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("held"))


def append(events: DataFrame, root: str, budget: Budget | None = None) -> DataFrame:
    """Append events (ledger, ord, payload), in order, and tell of each ledger (ledger, lines, accepted) what became of it."""
    spark, budget = events.sparkSession, budget or Budget()
    number, before = len(commits(spark, root)), heads(read(spark, root))
    lists = events.groupBy("ledger").agg(F.array_sort(F.collect_list(F.struct("ord", "payload"))).alias("e"))  # a ledger is bounded by its budget
    rows = lists.join(before, "ledger", "left").select("ledger", "e.payload", "head", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("held", F.lit(0)).alias("held"))
    struct = pa.list_(pa.struct([("sequence", pa.int64()), ("previous_sha256", pa.string()), ("payload", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64())]))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last, made, held = row["head"], [], row["held"]
                for sequence, payload in enumerate(row["payload"], row["lines"]):
                    sha, size = digest(sequence, last, payload), len(payload.encode())
                    made.append({"sequence": sequence, "previous_sha256": last, "payload": payload, "sha256": sha, "bytes": size})
                    last, held = sha, held + size
                fits = row["lines"] + len(made) <= budget.lines and held <= budget.ledger_bytes and all(m["bytes"] <= budget.line_bytes for m in made)
                out.append(made if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in batch.column(1)], pa.int64()), pa.array(out, struct)], ["ledger", "lines", "made"])

    schema = "ledger string, lines long, made array<struct<sequence: bigint, previous_sha256: string, payload: string, sha256: string, bytes: bigint>>"
    # Every try has folders of its own, so that writers can't spoil each other's.
    name = f"{number}-{uuid.uuid4().hex}"
    rows.mapInArrow(chain, schema).write.parquet(f"{root}/tried/{name}")
    made = spark.read.schema(schema).parquet(f"{root}/tried/{name}")
    made.select("ledger", F.inline("made")).select(*_COLUMNS).write.parquet(f"{root}/lines/append={name}")
    try:
        write_json(spark, f"{root}/commits/{number:09d}.json", {"folder": name})
    except Exception as e:
        raise Taken(f"append {number}") from e
    return made.select("ledger", "lines", F.col("made").isNotNull().alias("accepted"))


def breaks(lines: DataFrame) -> DataFrame:
    """Lines that don't follow the one before, or whose digest isn't that of what they say."""
    wrong = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), F.coalesce("previous_sha256", F.lit("")), "payload"), 256) != F.col("sha256")
    return chain_breaks(lines).select("ledger", "sequence").unionByName(lines.filter(wrong).select("ledger", "sequence")).distinct()
