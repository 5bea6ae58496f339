"""A ledger's events folded into the latest state of each operation, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "sequence long, status string, n_events long, rejected long"


def fold(events: DataFrame, key: str = "operation", terminal: tuple[str, ...] = ()) -> DataFrame:
    """key, sequence, status, n_events and rejected after each batch, of the operations with events in it.

    An event replaces the state if its sequence is higher and the state isn't terminal; others are counted as rejected.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, status, n, rejected = state.get if state.exists else (-1, "", 0, 0)
        rows = pd.concat(list(batches)).sort_values("sequence")
        for row in rows.itertuples():
            if row.sequence <= sequence or status in terminal:
                rejected += 1
            else:
                sequence, status, n = int(row.sequence), row.status, n + 1
        state.update((sequence, status, n, rejected))
        yield pd.DataFrame({key: [k[0]], "sequence": [sequence], "status": [status], "n_events": [n], "rejected": [rejected]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "sequence", "status").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, source: str) -> DataFrame:
    """The Parquet files of a path, one file or a folder, as a stream."""
    schema = spark.read.parquet(source).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    # A stream reads folders.
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString()) if single else reader.parquet(source)


def folded(spark, source: str, checkpoint: str, columns: dict[str, str], key: str = "operation", terminal: tuple[str, ...] = ()) -> DataFrame:
    """All events that the files of source have now, through the stream: the last state of each operation.

    Updates are appended to a table beside the checkpoint, a batch to a folder, so that a batch that is run again
    replaces its own.
    """
    stream = file_stream(spark, source)
    events = stream.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    out = f"{checkpoint}/updates"
    query = (
        fold(events, key, terminal).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True)
        .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(out)
    last = F.max_by(F.struct("sequence", "status", "n_events", "rejected"), "batch").alias("s")
    return found.groupBy(key).agg(last).select(key, "s.*")
