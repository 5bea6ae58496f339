"""Retrieval quality: recall and reciprocal rank against judgements, percentiles and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.text import TOKEN


def recall_mrr(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: recall at k and reciprocal rank. hits: query, item, rank (from 1); relevant: query, item. A query without relevant items has no recall."""
    found = relevant.distinct().join(hits.filter(F.col("rank") <= k).groupBy("query", "item").agg(F.min("rank").alias("rank")), ["query", "item"], "left")
    return found.groupBy("query").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.count(F.lit(1)).alias("relevant"))


def _asked(items: DataFrame) -> DataFrame:
    """item_id, text, words (different ones, lower-cased) and inner: those of all words but the first and last, null for an item of no more than two."""
    rows = items.select("item_id", "text", F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t)).alias("_w"))
    inner = F.when(F.size("_w") > 2, F.array_distinct(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(1)))))
    return rows.select("item_id", "text", F.array_distinct("_w").alias("words"), inner.alias("inner"))


def words_of(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and word, once each: which of the items' words, lower-cased, each document has. To be stored, as the steps below read it several times.

    A text is split here, once, and nowhere else. The array stands in the explode itself: a filter on an array's column
    would be pushed below it and split the text again.
    """
    every = F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    rows = documents.select("doc_id", F.explode(F.array_distinct(F.transform(every, lambda t: F.lower(t)))).alias("word"))
    return rows.join(_asked(items).select(F.explode("words").alias("word")).distinct(), "word", "left_semi").select("doc_id", "word")


def _rarest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """item_id and the one of an item's words (item_id, word) that the fewest documents have, of equally rare ones the first. held: doc_id, word, once each."""
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(counts, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("_r"))
    return found.filter("_r.n > 0").select("item_id", F.col("_r.word").alias("word"))


def containing(documents: DataFrame, items: DataFrame, held: DataFrame) -> DataFrame:
    """item_id and doc_id of the documents (doc_id, text) that contain the whole text of an item (item_id, text). held: words_of() them.

    A text that contains an item has all of its words but the first and last, which may be parts of longer ones. So the
    documents with the rarest of these, in whatever case, are compared, by an equi-join, and no other. Items of one or two words are
    compared with every document.
    """
    split = _asked(items).select("item_id", F.col("text").alias("item"), "inner")
    near = held.join(_rarest(split.select("item_id", F.explode("inner").alias("word")), held), "word").join(split.select("item_id", "item"), "item_id")
    found = near.join(documents.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    short = split.filter("inner IS NULL AND item IS NOT NULL").select("item_id", "item")
    if not short.isEmpty():
        found = found.unionByName(documents.join(short, F.contains("text", F.col("item"))).select("item_id", "doc_id"))
    return found


def retrieved(items: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """item_id, doc_id, score and rank of the documents that have an item's rarest word, by the share of its different words that they have. held: words_of() them."""
    asked = _asked(items).select("item_id", F.size("words").alias("_n"), F.explode("words").alias("word"))
    near = held.join(_rarest(asked.select("item_id", "word"), held), "word").select("doc_id", "item_id")
    both = near.join(held, "doc_id").join(asked, ["item_id", "word"])
    scored = both.groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.first("_n")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= most)


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: median and 95th percentile, interpolated and by nearest rank."""
    return rows.groupBy(group).agg(
        F.count(value).alias("n"), F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_nearest")
    )


def cohorts(rows: DataFrame, cohort: str, success: str, eligible: str) -> DataFrame:
    """Per cohort: cases, eligible and successful ones, accuracy over all cases, and accuracy over eligible ones."""
    good, fit = F.count(F.when(F.col(success), 1)), F.count(F.when(F.col(eligible), 1))
    both = F.count(F.when(F.col(success) & F.col(eligible), 1))
    return rows.groupBy(cohort).agg(F.count(F.lit(1)).alias("cases"), fit.alias("eligible"), good.alias("successes"), (good / F.count(F.lit(1))).alias("accuracy"), F.when(fit > 0, both / fit).alias("eligible_accuracy"))


def paired(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """One row: how many pairs both, only one, or neither of two systems got right."""
    rows = a.select(key, F.col(ok).alias("_a")).join(b.select(key, F.col(ok).alias("_b")), key)
    kinds = {"both": "_a AND _b", "only_first": "_a AND NOT _b", "only_second": "NOT _a AND _b", "neither": "NOT _a AND NOT _b"}
    return rows.agg(F.count(F.lit(1)).alias("pairs"), *[F.count(F.when(F.expr(e), 1)).alias(n) for n, e in kinds.items()])


def distribution_errors(answers: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Answers (id, probabilities map, choice) that aren't distributions, with the first thing wrong."""
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    chosen = F.col("probabilities")[F.col("choice")]
    kind = (
        F.when(F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)), "out_of_range")
        .when(F.abs(total - 1) > tolerance, "sum")
        .when(chosen.isNull(), "unknown_choice")
        .when(chosen < F.array_max(values), "not_the_most_probable")
    )
    return answers.withColumn("error", kind).filter("error IS NOT NULL").select("id", "error")


def json_faults(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Add valid: whether a text is a JSON object without repeated keys or values that aren't numbers."""
    parsed = F.try_parse_json(F.col(column))
    return rows.withColumn("valid", parsed.isNotNull() & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)))


def uncited(citations: DataFrame, issued: DataFrame) -> DataFrame:
    """Citations (node, byte_start, byte_end, sha256) that weren't issued; valid answers have none."""
    keys = ["node", "byte_start", "byte_end", "sha256"]
    return citations.join(issued.select(*keys).distinct(), keys, "left_anti")


def packed_batches(items, most: int, most_bytes: int):
    """Batches of consecutive items, closed before an item that would exceed the number or the bytes. A pandas group function's core."""
    batch, n, size, out = 0, 0, 0, []
    for b in items:
        if n and (n + 1 > most or size + b > most_bytes):
            batch, n, size = batch + 1, 0, 0
        out.append(batch)
        n, size = n + 1, size + b
    return out
