"""Rules on attempts, receipts, selections and costs, as frames of what breaks them or as totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def receipts(reservations: DataFrame, outcomes: DataFrame, key: str, group: str, cost: str) -> DataFrame:
    """Per group: calls reserved, observed and unobserved, and the observed cost, null if any is unknown."""
    seen = outcomes.groupBy(key).agg(F.max(cost).alias("_cost"), F.lit(True).alias("_seen"))
    rows = reservations.join(seen, key, "left")
    missing = F.count(F.when(F.col("_cost").isNull(), 1))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("reserved"), F.count("_seen").alias("observed"), F.count(F.when(F.col("_seen").isNull(), 1)).alias("unobserved"), F.when(missing == 0, F.sum("_cost")).alias("cost_total"), F.coalesce(F.sum("_cost"), F.lit(0)).alias("cost_known"))


def attempt_violations(updates: DataFrame, reservations: DataFrame, key: str, identity: str, most: int, group: str) -> DataFrame:
    """kind and n: updates without a reservation, attempts whose identity changes, and groups with more than `most` attempts."""
    orphan = updates.join(reservations.select(key).distinct(), key, "left_anti").select(F.lit("unreserved").alias("kind"))
    changed = updates.groupBy(key).agg(F.countDistinct(identity).alias("_n")).filter("_n > 1").select(F.lit("identity_changed").alias("kind"))
    many = reservations.groupBy(group).agg(F.countDistinct(key).alias("_n")).filter(F.col("_n") > most).select(F.lit("too_many_attempts").alias("kind"))
    return orphan.unionByName(changed).unionByName(many).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def regressions(events: DataFrame, key: str, sequence: str, counter: str) -> DataFrame:
    """Events whose counter is less than one before it in the same key, with the largest one before."""
    before = Window.partitionBy(key).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("reached", F.max(counter).over(before)).filter(F.col(counter) < F.col("reached"))


def pages_of(spec: Column) -> Column:
    """The pages of a specification such as 1-3,7: distinct, in order. A part that isn't a page or a range upward is an error."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^[1-9][0-9]{0,8}(-[1-9][0-9]{0,8})?$"))
    bounds = F.transform(parts, lambda p: F.struct(F.element_at(F.split(p, "-"), 1).try_cast("int").alias("a"), F.element_at(F.split(p, "-"), -1).try_cast("int").alias("z")))
    upward = F.forall(bounds, lambda b: b["a"] <= b["z"])
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(b["a"], b["z"])))))
    return F.when(good & upward, pages).otherwise(F.raise_error(F.concat(F.lit("not a page specification: "), spec)).cast("array<int>"))


def tier(name: Column) -> Column:
    """A tier by its first name: `fast` is `priority`."""
    low = F.lower(F.trim(name))
    return F.when(low == "fast", F.lit("priority")).otherwise(low)


def tier_agrees(asked: Column, observed: Column) -> Column:
    """Whether the observed tier is the one asked for; one that wasn't observed is no fault."""
    return observed.isNull() | (tier(asked) == tier(observed))


def distinct_views(views: DataFrame, text: str = "query") -> DataFrame:
    """Add repeats: whether an earlier view (view, text) says the same, white space and case aside."""
    said = F.lower(F.regexp_replace(F.trim(F.col(text)), r"\s+", " "))
    return views.withColumn("repeats", F.row_number().over(Window.partitionBy("request", said).orderBy("view")) > 1)


def anchors(windows: DataFrame, generation: str) -> DataFrame:
    """Add anchor_id: a name for a window (doc_key, byte_start, byte_end, sha256) of a generation."""
    name = F.concat_ws(":", F.lit(generation), "doc_key", F.col("byte_start").cast("string"), F.col("byte_end").cast("string"), "sha256")
    return windows.withColumn("anchor_id", F.concat(F.lit("nav_"), F.sha2(name, 256)))


def anchored(hints: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hints (hint_id, anchor_ids) with the windows that they name, and the names that no window has."""
    named = hints.select("hint_id", F.explode("anchor_ids").alias("anchor_id"))
    return named.join(windows, "anchor_id"), named.join(windows.select("anchor_id"), "anchor_id", "left_anti")


def gate(cases: DataFrame, ok: str, costs: list[str], least_correct: int, most_cost: str) -> DataFrame:
    """One row: questions, correct ones, cost of all parts together and of a question, null if a part is unknown, and whether both bounds hold."""
    known = F.lit(True)
    for c in costs:
        known = known & F.col(c).isNotNull()
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in costs), F.lit(0))
    rows = cases.agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col(ok), 1)).alias("correct"), F.count(F.when(~known, 1)).alias("cost_missing"), F.sum(total).cast("double").alias("_sum"))
    cost = F.when(F.col("cost_missing") == 0, F.col("_sum"))
    each = cost / F.col("questions")
    return rows.select("questions", "correct", "cost_missing", cost.alias("cost"), each.alias("cost_per_question"), ((F.col("correct") >= least_correct) & F.coalesce(each < F.lit(float(most_cost)), F.lit(False))).alias("passes"))


def quality(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query (query, mode): recall and reciprocal rank at k. A query without relevant items has no recall, and is right (no_answer) if it has no hit."""
    top = hits.filter(F.col("rank") <= k).groupBy("query", "item").agg(F.min("rank").alias("rank"))
    found = relevant.distinct().join(top, ["query", "item"], "left").groupBy("query").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    any_hit = hits.select("query").distinct().withColumn("_hit", F.lit(True))
    rows = queries.join(found, "query", "left").join(any_hit, "query", "left")
    return rows.select("query", "mode", "recall", "reciprocal_rank", F.when(F.col("recall").isNull(), F.col("_hit").isNull()).alias("no_answer"))


def macro(rows: DataFrame) -> DataFrame:
    """Means of quality() by mode and, with mode `all`, over all queries. Queries without a value aren't counted in its mean."""
    means = [F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.col("no_answer").cast("double")).alias("no_answer")]
    return rows.rollup("mode").agg(F.grouping("mode").alias("_all"), *means).withColumn("mode", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("mode"))).drop("_all")
