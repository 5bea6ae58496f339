"""Ledgers, usage and cost: latest states, null-strict sums, retries, concurrency and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def strict(value: str, name: str | None = None) -> list[Column]:
    """Sum that is unknown if a value is; what is known of it; and how many values are missing."""
    name = name or value
    missing = F.count(F.when(F.col(value).isNull(), 1))
    return [F.when(missing == 0, F.sum(value)).alias(f"{name}_total"), F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_known"), missing.alias(f"{name}_missing")]


def latest(events: DataFrame, key: str, sequence: str, *columns: str) -> DataFrame:
    """The columns of each key's last event; it replaces the earlier ones."""
    last = F.max_by(F.struct(*columns), sequence).alias("_last")
    return events.groupBy(key).agg(last, F.max(sequence).alias(sequence), F.count(F.lit(1)).alias("n_events")).select(key, sequence, "n_events", "_last.*")


def chain_breaks(lines: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Lines of ledgers (sequence, previous_sha256, sha256) that don't follow the line before, or aren't numbered from 0 on."""
    before = Window.partitionBy(ledger).orderBy("sequence")
    rows = lines.withColumns({"_place": F.row_number().over(before) - 1, "_before": F.lag("sha256").over(before)})
    return rows.filter(~F.col("previous_sha256").eqNullSafe(F.col("_before")) | (F.col("sequence") != F.col("_place"))).drop("_place", "_before")


def gaps(events: DataFrame, ledger: str, at: str) -> DataFrame:
    """Per ledger: the number of events, how many repeat the time of the one before, and the longest time between two."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(ledger).orderBy(at, "event_id"))
    rows = events.withColumn("_step", step)
    return rows.groupBy(ledger).agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col("_step") == 0, 1)).alias("same_time"), F.max("_step").alias("longest_gap"))


def usage_totals(turns: DataFrame, group: str, thread: str, turn: str, counter: str) -> DataFrame:
    """Per group: totals over turns of the largest count observed of each, null-strict, and the turns observed with different counts."""
    once = turns.groupBy(group, thread, turn).agg(F.max(counter).alias(counter), F.countDistinct(counter).alias("_different"))
    return once.groupBy(group).agg(F.count(F.lit(1)).alias("turns"), *strict(counter), F.count(F.when(F.col("_different") > 1, 1)).alias("conflicts"))


def retried(calls: DataFrame, session: str, request: str, ordinal: str) -> DataFrame:
    """Failed calls with resolved_by, the first later success of the same request in the same session. calls has ok."""
    later = Window.partitionBy(session, request).orderBy(ordinal).rowsBetween(1, Window.unboundedFollowing)
    success = F.min(F.when(F.col("ok"), F.col(ordinal))).over(later)
    return calls.withColumn("resolved_by", success).filter(~F.col("ok"))


def concurrency(intervals: DataFrame, pool: str, start: str, end: str) -> DataFrame:
    """Per pool: peak, busy, summed and overlapping time of its intervals. An end comes before a start at the same time."""
    edges = intervals.select(pool, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).groupBy(pool, F.col("e.t").alias("t"), F.col("e.d").alias("d")).agg(F.sum("e.d").alias("s"))
    order = Window.partitionBy(pool).orderBy("t", "d")
    swept = edges.withColumns({"active": F.sum("s").over(order), "step": F.coalesce(F.lead("t").over(order) - F.col("t"), F.lit(0))})
    busy = F.sum(F.when(F.col("active") > 0, F.col("step")).otherwise(0))
    summed = F.sum(F.col("active") * F.col("step"))
    return swept.groupBy(pool).agg(F.max("active").alias("peak"), busy.alias("busy"), summed.alias("summed"), (summed - busy).alias("overlap"))


def priced(turns: DataFrame, bands: DataFrame) -> DataFrame:
    """Add band and cost of each turn (model, input, cached, output): the first band of the model that has room for the input, by rates per million tokens.

    bands: model, band, max_input (null: no bound), input_rate, cached_rate, output_rate, as decimals.
    """
    keyed = turns.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in turns.columns else turns
    fits = keyed.join(F.broadcast(bands.withColumnRenamed("model", "_model")), (F.col("model") == F.col("_model")) & (F.col("max_input").isNull() | (F.col("input") <= F.col("max_input"))), "left")
    chosen = fits.groupBy(*keyed.columns).agg(F.min_by(F.struct("band", "input_rate", "cached_rate", "output_rate"), "band").alias("_b"))
    money = (F.col("input") - F.col("cached")) * F.col("_b.input_rate") + F.col("cached") * F.col("_b.cached_rate") + F.col("output") * F.col("_b.output_rate")
    return chosen.select(*turns.columns, F.col("_b.band").alias("band"), (money / F.lit(1_000_000)).cast("decimal(38,12)").alias("cost"))


def transition_violations(events: DataFrame, ledger: str, sequence: str, state: str, terminal: list[str], allowed: list[str]) -> DataFrame:
    """Events in an unknown state, or after a terminal one."""
    before = Window.partitionBy(ledger).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col(state).isin(terminal).cast("int")).over(before)
    kind = F.when(~F.col(state).isin(allowed), "unknown_state").when(ended == 1, "after_terminal")
    return events.withColumn("violation", kind).filter("violation IS NOT NULL")


def first_valid(outcomes: DataFrame, origin: str, ordinal: str, valid: str, value: str) -> DataFrame:
    """Per origin: its first valid outcome, else the last one; how many there are; and whether valid ones disagree."""
    good = F.col(valid)
    return outcomes.groupBy(origin).agg(
        F.coalesce(F.min_by(F.when(good, F.col(ordinal)), F.when(good, F.col(ordinal))), F.max(ordinal)).alias("chosen"),
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(good, 1)).alias("valid"),
        (F.countDistinct(F.when(good, F.col(value))) > 1).alias("conflict"),
    )


def replayed(requests: DataFrame, producers: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The k-th request of a key with the key's k-th producer, or with none."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    left = requests.select(key, F.col(ordinal).alias("request"), k.alias("_k"))
    right = producers.select(key, F.col(ordinal).alias("producer"), k.alias("_k"))
    return left.join(right, [key, "_k"], "left").select(key, "request", F.col("_k").alias("occurrence"), "producer")


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: the number of intervals, their summed length, and the length of their union."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(end).over(before)
    new = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(reached, F.col(start))), F.lit(0))
    return rows.withColumn("_new", new).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(end) - F.col(start)).alias("summed"), F.sum("_new").alias("covered"))
