"""Mixing sources to target weights.

Each row gets a random key of its id. Within each source the rows are sorted by key, and distributed prefix sums of
the token counts give the key at which the source's budget is used up. A budget above the source's size takes whole
epochs first. What a row contributes follows from its key and its source's cut alone, so the table itself is neither
sorted nor shuffled, and a rerun takes the same rows.

Repeated rows have the same key and, if their sizes agree, the same place. If the cut falls among such rows, they are
numbered: the first of them are taken whole, one in part. Which of them is first is of no consequence where they are
equal, and else follows from their texts. A null source is a source of its own and the last; a null text has no words
and is never taken; null ids have one key. An empty table gives no rows. Sources are one row each in the steps on
budgets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import key_range, key_ranges, prefix_sums, quoted, random_key, range_offsets, settle, source_key, word_count

#: Sources are broadcast up to so many; a table of more is joined by a shuffle.
MOST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """Add _target to a frame of _source and _total, one row per source.

    Weights repeat over the sources in order. Budgets in proportion to the weights hold until a source would exceed
    most_epochs times its size; its excess goes to the others by weight. The result of such resharing is one level:
    a source gets the lesser of level * weight and its cap. Sorted by cap / weight, the level is the first at which
    the sources that aren't capped can take what is left.
    """
    ordered = Window.orderBy("_source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("_weight", table[(F.row_number().over(ordered) - 1) % len(weights)])
    weighted = weighted.withColumns({"_cap": most_epochs * F.col("_total"), "_full_at": most_epochs * F.col("_total") / F.col("_weight")})
    earlier = Window.orderBy("_full_at", "_source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_full_at", "_source").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("_total").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_weight").over(onward)
    leveled = weighted.withColumn("_level", level)
    reached = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_source", "_level"))).over(whole)
    found = leveled.withColumn("_reached", reached["_level"])
    target = F.when(F.col("_reached").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_reached") * F.col("_weight")))
    return found.withColumn("_target", target).select("_source", "_total", "_weight", "_target")


def planned(df: DataFrame, weights: Sequence[float], share: float = 1.0, most_epochs: float = 1.0, seed: int = 11, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of df as _doc, _source, _key and _size, and the cut of each source.

    A cut has _epochs (whole passes), _cut_key, _cut_doc and _cut_size (the place at which the last pass ends; null if
    none), _cut_rows (how many rows have that place) and _cut_words (how many words are still taken of these together).
    """
    narrow = settle(keyed(df, seed, id_column).select("_doc", "_source", "_key", "_size", "_text"))
    sizes = targets(narrow.groupBy("_source").agg(F.sum("_size").alias("_total")), weights, share, most_epochs)
    words = F.floor(F.col("_target") + 0.5).cast("long")
    sizes = sizes.withColumns({"_words": words, "_epochs": F.when(F.col("_total") > 0, F.expr("floor(_target + 0.5) div _total")).otherwise(F.lit(0)).cast("long")})
    sizes = settle(sizes.withColumn("_rest", F.col("_words") - F.col("_epochs") * F.col("_total")))
    ranges = key_ranges(df.sparkSession, narrow.count())
    ranged = narrow.withColumn("_range", key_range("_key", ranges))
    offsets = range_offsets(ranged, ["_source"], "_size").join(small(sizes.select("_source", "_rest")), "_source")
    cut_range = offsets.filter("_before < _rest AND _rest <= _before + _sum").select("_source", "_range", "_before", "_rest")
    # Rows of one place count together: a repeated row is one row here, however often it occurs.
    places = ranged.filter("_size > 0").join(small(cut_range), ["_source", "_range"]).groupBy("_source", "_range", "_before", "_rest", "_key", "_doc", "_size").agg(F.count(F.lit(1)).alias("_cut_rows"))
    places = places.withColumn("_all", F.col("_size") * F.col("_cut_rows"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_doc", "_size").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_all").over(inside), F.lit(0)))
    cuts = places.filter("_at < _rest AND _rest <= _at + _all").select(
        "_source", F.col("_key").alias("_cut_key"), F.col("_doc").alias("_cut_doc"), F.col("_size").alias("_cut_size"), "_cut_rows", (F.col("_rest") - F.col("_at")).alias("_cut_words")
    )
    return narrow, settle(sizes.join(cuts, "_source", "left"))


def keyed(df: DataFrame, seed: int, id_column: str = "doc_id") -> DataFrame:
    """_row (all columns of df), _doc, _source, _size, _key and _text, the text's hash."""
    row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row")
    return df.select(row, F.col(quoted(id_column)).alias("_doc"), source_key().alias("_source"), word_count("text").alias("_size"), random_key(seed, F.col(quoted(id_column))).alias("_key"), F.xxhash64("text").alias("_text"))


def small(per_source: DataFrame) -> DataFrame:
    """Broadcast a frame of a row per source if there are few sources; else leave the join to the optimizer."""
    return F.broadcast(per_source) if per_source.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else per_source


def contributions(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add _taken, the words that the mix takes of each row, repeats counted, to rows with the columns of keyed()."""
    place, cut = F.struct("_key", "_doc", "_size"), F.struct("_cut_key", "_cut_doc", "_cut_size")
    with_cut = rows.join(small(cuts), "_source")
    at_cut = F.col("_cut_key").isNotNull() & place.eqNullSafe(cut)
    last = F.when(F.col("_cut_key").isNull(), F.lit(0)).when(at_cut, F.col("_cut_words")).when(place < cut, F.col("_size")).otherwise(F.lit(0))
    taken = (F.col("_epochs") * F.col("_size") + last).cast("long")
    if cuts.filter("_cut_rows > 1").isEmpty():
        return with_cut.withColumn("_taken", taken)
    # Only rows at a cut are numbered. Their order is that of their texts, then any; the ranges keep tasks small.
    alone = with_cut.filter(~at_cut | (F.col("_cut_rows") == 1)).withColumn("_taken", taken)
    among = settle(with_cut.filter(at_cut & (F.col("_cut_rows") > 1)).withColumns({"_range": F.expr("shiftright(_text, 56)"), "_part": F.monotonically_increasing_id(), "_one": F.lit(1)}))
    among = prefix_sums(among, ["_source"], ["_text", "_part"], "_one", "_nth").drop("_range", "_part", "_one")
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_cut_words") - F.col("_nth") * F.col("_size")))
    among = among.withColumn("_taken", (F.col("_epochs") * F.col("_size") + rest).cast("long")).drop("_nth")
    return alone.unionByName(among)


def mixed(df: DataFrame, weights: Sequence[float], share: float = 1.0, most_epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """Rows of the mix, with the columns of df: a row appears as often as its text is taken, begun repeats included.

    Texts stay whole, so a source exceeds its budget by less than one text.
    """
    _, cuts = planned(df, weights, share, most_epochs, seed)
    taken = contributions(keyed(df, seed), cuts)
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")


def report(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    narrow, cuts = planned(df.select("doc_id", "source", "text"), weights, share, most_epochs)
    return contributions(narrow, cuts).select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.expr("CASE WHEN _source = '1' THEN NULL ELSE substr(_source, 2) END").alias("source")
    )
