"""Texts as lines with exact byte offsets."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window


def raw_lines(text: Column) -> Column:
    """Lines with their carriage return, if any; a text's closing line feed begins no line."""
    parts = F.split(text, "\n")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@F.pandas_udf(ArrayType(LongType()))  # a type, as the text of one needs a session
def line_starts(texts: pd.Series) -> pd.Series:
    """The first byte of each of raw_lines()."""

    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.flatnonzero(raw == 10) + 1
        return np.r_[0, ends[:-1] if len(ends) and ends[-1] == len(raw) else ends]

    return texts.map(one)


def lines(documents: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (from 1), line, byte_start and byte_end of each line. A terminator is in no line; an empty text has one empty line.

    A document's lines and their first bytes are arrays of its row, so nothing is shuffled.
    """
    rows = documents.select(*keys, raw_lines(F.col("text")).alias("_raw"), line_starts("text").alias("_starts"), F.col("text").endswith("\n").alias("_closed"))
    every = rows.select(*keys, "_closed", F.size("_raw").alias("_n"), F.posexplode(F.arrays_zip("_raw", "_starts")).alias("_p", "_l"))
    every = every.select(*keys, "_closed", "_n", "_p", F.col("_l._raw").alias("_line"), F.col("_l._starts").alias("byte_start"))
    ended = (F.col("_p") + 1 < F.col("_n")) | F.col("_closed")
    line = F.when(ended & F.col("_line").endswith("\r"), F.expr("left(_line, length(_line) - 1)")).otherwise(F.col("_line"))
    every = every.withColumn("line", line)
    return every.select(*keys, (F.col("_p") + 1).alias("line_no"), "line", "byte_start", (F.col("byte_start") + F.octet_length("line")).alias("byte_end"))


def context(rows: DataFrame, around: int, *keys: str) -> DataFrame:
    """Add context: the lines from `around` before to `around` after, joined."""
    window = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list("line").over(window), "\n"))


def windows(matches: DataFrame, rows: DataFrame, before: int, after: int, *keys: str) -> DataFrame:
    """keys, match_line, first, last and text of the window around each matched line.

    A match is sent to each line of its window, so that the join is on equal line numbers.
    """
    spread = matches.select(*keys, F.col("line_no").alias("match_line"), F.explode(F.sequence(F.greatest(F.col("line_no") - before, F.lit(1)), F.col("line_no") + after)).alias("line_no"))
    joined = spread.join(rows.select(*keys, "line_no", "line"), [*keys, "line_no"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return joined.groupBy(*keys, "match_line").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), texts.alias("text"))


def byte_windows(documents: DataFrame, size: int, *keys: str) -> DataFrame:
    """keys, ordinal, byte_start, byte_end and sha256 of consecutive windows of at most size bytes that end between characters."""

    def cut(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(len(keys))]
            rows = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                raw, at, k = (text or b""), 0, 0
                while at < len(raw):
                    end = min(len(raw), at + size)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    if end == at:
                        raise ValueError(f"a window of {size} bytes is too small for the next character")
                    rows.append((*(x[i] for x in ids), k, at, end, hashlib.sha256(raw[at:end]).hexdigest()))
                    at, k = end, k + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(keys) + 4)
            kinds = [*(batch.schema.field(i).type for i in range(len(keys))), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*keys, "ordinal", "byte_start", "byte_end", "sha256"])

    rows = documents.select(*keys, F.col("text").cast("binary").alias("text"))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "ordinal int, byte_start long, byte_end long, sha256 string"])
    return rows.mapInArrow(cut, schema)


def encoded_bytes(raw: bytes) -> int:
    """Bytes of a text as a JSON string, quotes included; what isn't ASCII stays as it is."""
    return len(json.dumps(raw.decode(), ensure_ascii=False).encode())


def fitted_windows(documents: DataFrame, size: int, most: int, *keys: str, least: int = 4) -> DataFrame:
    """keys, ordinal, byte_start, byte_end and encoded of windows that tile each text, each of at most `most` bytes as JSON.

    A window begins where the one before ends. It is tried with `size` bytes, then with half of these, and so on down to
    `least`, always ended between characters; how large it gets depends on the text. A text of which no window fits is
    an error. A text is cut by one task, and an empty one has no window.
    """
    kinds = {k: documents.schema[k].dataType.simpleString() for k in keys}

    def cut(batches):
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                at, out = 0, []
                while at < len(raw or b""):
                    want = size
                    while True:
                        end = min(len(raw), at + want)
                        while at < end < len(raw) and raw[end] & 0xC0 == 0x80:
                            end -= 1
                        if end > at and (n := encoded_bytes(raw[at:end])) <= most:
                            break
                        if want <= least:
                            raise ValueError(f"no window at byte {at} fits in {most} bytes")
                        want = max(want // 2, least)
                    out.append({"ordinal": len(out), "byte_start": at, "byte_end": end, "encoded": n})
                    at = end
                rows.append(out)
            struct = pa.list_(pa.struct([("ordinal", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("encoded", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(rows, struct)], [*keys, "_w"])

    made = documents.select(*keys, F.encode("text", "utf-8").alias("text")).mapInArrow(cut, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", _w array<struct<ordinal: int, byte_start: bigint, byte_end: bigint, encoded: bigint>>")
    return made.select(*keys, F.inline("_w"))
