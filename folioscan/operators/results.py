"""From matches to what a reader gets: windows in their section, pages of results, payloads, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_windows(matches: DataFrame, nodes: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """doc, match_line, node_id, first, last, text, byte_start, byte_end and column_start of the window around each match, ended at its section's bounds.

    matches: doc, line_no, node_id; nodes: doc, node_id, line_start, line_end; lines: doc, line_no, line, byte_start,
    byte_end. A match is sent to each line of its window, so all joins are equi-joins. column_start is the byte at
    which the matched line begins in the window, from 1.
    """
    bounded = matches.join(nodes.select("doc", "node_id", "line_start", "line_end"), ["doc", "node_id"]).select(
        "doc", "node_id", F.col("line_no").alias("match_line"), F.greatest(F.col("line_no") - before, "line_start").alias("_a"), F.least(F.col("line_no") + after, "line_end").alias("_z")
    )
    spread = bounded.withColumn("line_no", F.explode(F.sequence("_a", "_z"))).join(lines, ["doc", "line_no"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    at = F.min(F.when(F.col("line_no") == F.col("match_line"), F.col("byte_start")))
    return spread.groupBy("doc", "node_id", "match_line").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), texts.alias("text"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), (at - F.min("byte_start") + 1).alias("column_start")
    )


def fresh_matches(matches: DataFrame, recorded: DataFrame, current: DataFrame, most: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first matches of fresh documents, and the paths of stale documents that have a match.

    matches has path; recorded and current have path and source_sha256. Freshness comes before the budget: a stale
    document uses none of it.
    """
    now = current.select("path", F.col("source_sha256").alias("_now"))
    state = recorded.select("path", "source_sha256").join(now, "path", "left").select("path", F.coalesce(F.col("_now") == F.col("source_sha256"), F.lit(False)).alias("_fresh"))
    marked = matches.join(state, "path")
    return marked.filter("_fresh").drop("_fresh").orderBy(*order).limit(most), marked.filter("NOT _fresh").select("path").distinct()


def paginated(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows from offset on, at most limit, with their place (from 0) and next_offset, null on the last page. Only the rows up to one more than the page are sorted out."""
    seen = rows.orderBy(*order).limit(offset + limit + 1)
    placed = seen.withColumns({"place": F.row_number().over(Window.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    more = F.when(F.col("_n") > offset + limit, F.lit(offset + limit))
    return placed.filter((F.col("place") >= offset) & (F.col("place") < offset + limit)).withColumn("next_offset", more).drop("_n")


def payload(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The longest beginning of each group's rows whose sizes stay within the budget. Adds used, the bytes up to and with the row."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(upto)).filter(F.col("used") <= budget)


def packet(sizes: Column, most: int, budget: int) -> Column:
    """Which elements of an array of sizes a packet takes, in order: one that doesn't fit is passed over and later ones may. An array of booleans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["n"] < most) & (a["used"] + x <= budget)
        return F.struct((a["n"] + fits.cast("long")).alias("n"), (a["used"] + F.when(fits, x).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(a["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(sizes, start, step, lambda a: a["taken"])


def under_frames(headings: DataFrame, frames: DataFrame) -> DataFrame:
    """Headings (doc, line, level, title) under the latest frame (same columns) at or before their line: level is the frame's plus their own. A heading that repeats a frame's title on its line is dropped.

    An as-of join by a window over both, frames first at equal lines.
    """
    kept = headings.join(frames.select("doc", "line", F.lower("title").alias("_title")), [headings["doc"] == frames["doc"], headings["line"] == frames["line"], F.lower(headings["title"]) == F.col("_title")], "left_anti")
    both = frames.withColumn("_kind", F.lit(0)).unionByName(kept.withColumn("_kind", F.lit(1)))
    before = Window.partitionBy("doc").orderBy("line", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    active = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("title").alias("frame"), F.col("level").alias("frame_level"))), ignorenulls=True).over(before)
    rows = both.withColumn("_f", active).filter("_kind = 1")
    return rows.select("doc", "line", "title", F.col("_f.frame").alias("frame"), (F.col("level") + F.coalesce(F.col("_f.frame_level"), F.lit(0))).alias("level"))
