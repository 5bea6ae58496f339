"""Whole searches: a mode, its lanes, scoring and delivery."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.text import byte_clip, lexical_score, token_list
from folioscan.operators.hits import lexical_hits, regex_hits
from folioscan.operators.search import Options, budgeted, floored, grep, lexical, routed
from folioscan.sources.corpus import fresh, scoped
from folioscan.sources.storage import settle


class Scorer(Protocol):
    """Scores candidates (id, text) for a query: id and score from 0 to 1, for each candidate."""

    def score(self, query: str, candidates: DataFrame) -> DataFrame: ...


class TermOverlap:
    """A deterministic stand-in for a model: the share of the query's terms that a text contains."""

    def score(self, query: str, candidates: DataFrame) -> DataFrame:
        return candidates.select("id", lexical_score(F.col("text"), token_list(query)).alias("score"))


def descriptions(documents: DataFrame, most: int) -> DataFrame:
    """doc_key, path and what routing is told of the first documents by path: path, title and opening, in at most 900 bytes."""
    opening = byte_clip(F.regexp_replace("text", r"\s+", " "), 300)
    text = F.concat(F.lit("Path: "), F.col("path"), F.lit("\nTitle: "), F.col("title"), F.lit("\nOpening: "), opening)
    return documents.orderBy("path").limit(most).select("doc_key", "path", byte_clip(text, 900).alias("description"))


def search(documents: DataFrame, query: str, options: Options | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Hits of a query.

    `regex` gives matching lines in order of document key and line. `lexical` gives each document's best window.
    `semantic` adds the documents that routing picks, and `hybrid` both, with half of the candidates for the lexical
    lane; they are scored again, floored and cut to the limit.
    """
    options = options or Options()
    options.check(query)
    documents = scoped(documents, options.path)
    if options.mode == "regex":
        return budgeted(grep(documents, query, options.literal, options.ignore_case), options.limit, "doc_key", "line_no")[0]
    if options.mode == "lexical":
        return lexical(documents, query, options.limit)
    scorer = scorer or TermOverlap()
    told = descriptions(documents, options.routing_docs)
    ranked = routed(scorer.score(query, told.select(F.col("doc_key").alias("id"), F.col("description").alias("text"))).withColumnRenamed("id", "doc"))
    columns = ["doc_key", "path", "first", "last", "text", "literal_anchor"]
    semantic = documents.join(ranked, documents["doc_key"] == ranked["doc"]).select("doc_key", "path", F.lit(1).cast("long").alias("first"), F.size(F.split("text", "\n")).cast("long").alias("last"), byte_clip(F.col("text"), 1400).alias("text"), F.lit(False).alias("literal_anchor"), "rank")
    if options.mode == "hybrid":
        lex = lexical(documents, query, options.max_candidates // 2).select(*[F.col(c).cast("long") if c in ("first", "last") else c for c in columns])
        fresh = semantic.join(lex.select("doc_key"), "doc_key", "left_anti").orderBy("rank").limit(options.max_candidates - options.max_candidates // 2)
        hits = lex.unionByName(fresh.select(*columns))
    else:
        hits = semantic.orderBy("rank").limit(options.max_candidates).select(*columns)
    scores = scorer.score(query, hits.select(F.col("doc_key").alias("id"), "text")).withColumnRenamed("id", "doc_key")
    joined = hits.join(scores, "doc_key", "left").withColumn("score", F.coalesce("score", F.raise_error(F.lit("a candidate has no score")).cast("double")))
    return floored(joined, options.min_score).orderBy(F.desc("literal_anchor"), F.desc("score"), "path", "first").limit(options.limit)


@dataclass(frozen=True)
class Found:
    """hits in order (place from 1), stale: paths that were left out as their source has changed or gone, truncated: whether there are more hits than the limit."""

    hits: DataFrame
    stale: DataFrame
    truncated: bool


def located(
    documents: DataFrame, query: str, options: Options, nodes: DataFrame | None = None, spans: DataFrame | None = None, recorded: DataFrame | None = None, probe: Callable[[], DataFrame] | None = None
) -> Found:
    """A regex or lexical search whose hits have snippets, sections, pages and coverage.

    recorded (path, source_sha256) tells what was indexed, and probe what is there now. Stale documents are left out before
    their text is read, so that they use nothing of the limit; the hits' documents are probed again at the end, as they may
    have changed meanwhile, and what is stale then is left out too.
    """
    options.check(query)
    documents = scoped(documents, options.path)
    spark = documents.sparkSession
    stale = spark.createDataFrame([], "path string")
    if probe is not None:
        state = settle(fresh(recorded, probe()).select("path", "source_fresh"))
        stale = documents.select("path").join(state.filter("NOT source_fresh"), "path", "left_semi").select("path")
        documents = documents.join(state.filter("source_fresh"), "path", "left_semi")
    if options.mode == "regex":
        rows = regex_hits(documents, query, options.limit + 1, options.context, options.literal, options.ignore_case, nodes, spans)
        order = ("doc_key", "match_line")
    elif options.mode == "lexical":
        rows = lexical_hits(documents, query, options.limit + 1, nodes, spans)
        order = (F.desc("score"), "path", "line_start", "match_line")
    else:
        raise ValueError(f"not a mode without a model: {options.mode!r}")
    rows = settle(rows.withColumn("place", F.row_number().over(Window.orderBy(*order))))  # at most one more than the limit
    hits, truncated = rows.filter(F.col("place") <= options.limit), rows.count() > options.limit
    if probe is not None:
        own = recorded.join(hits.select("path").distinct(), "path", "left_semi")
        state = settle(fresh(own, probe()).select("path", "source_fresh"))
        hits = hits.join(F.broadcast(state.filter("source_fresh")), "path", "left_semi")
        stale = stale.unionByName(state.filter("NOT source_fresh").select("path")).distinct()
    return Found(hits.orderBy("place"), stale.orderBy("path"), truncated)
