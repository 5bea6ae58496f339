"""Search lanes over lines, ranking, and unions of several views."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.patterns import plan
from folioscan.functions.text import byte_column, citation, pattern, token_list
from folioscan.operators.hits import best_windows, contains_any, strongest, window_text, with_lines
from folioscan.operators.lines import lines
from folioscan.operators.trigram import Index, candidates, postings

#: The window of a lexical match, the cap on lexical matches, documents that routing keeps.
BEFORE, AFTER, MOST_MATCHES, ROUTED = 4, 12, 10_000, 8


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    limit: int = 20
    context: int = 0
    max_candidates: int = 24
    routing_docs: int = 32
    min_score: float = 0.5
    ignore_case: bool = False
    literal: bool = False
    path: str | None = None

    def check(self, query: str) -> None:
        limits = {"limit": (1, 1000), "context": (0, 100), "max_candidates": (1, 24), "routing_docs": (1, 32), "min_score": (0.0, 1.0)}
        if self.mode not in ("regex", "lexical", "semantic", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 1 <= len(query.encode()) <= 8192 or not query.strip():
            raise ValueError("a query has 1 to 8192 bytes")
        for name, (low, high) in limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


def budgeted(matches: DataFrame, most: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first matches in order, and a row that tells whether more were seen. Sorting stops at one more than wanted."""
    seen = matches.orderBy(*order).limit(most + 1)
    ranked = seen.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank"), ranked.agg((F.count(F.lit(1)) > most).alias("truncated"))


def grep(documents: DataFrame, query: str, literal: bool = False, ignore_case: bool = False) -> DataFrame:
    """doc_key, path, line_no, line, byte_start, byte_end, match_column and citation of each matching line.

    A literal is looked for in the whole text before it is split into lines; that reaches the scan as a filter.
    """
    regex = pattern(query, ignore_case, literal)
    if literal and not ignore_case:
        documents, hit = documents.filter(F.contains("text", F.lit(query))), F.contains("line", F.lit(query))
    else:
        hit = F.col("line").rlike(regex)
    found = lines(documents.filter("text <> ''"), "doc_key", "path").filter(hit)
    return found.withColumns({"match_column": byte_column(F.col("line"), regex), "citation": citation(F.col("path"), F.col("line_no"), F.col("line_no"))})


def grep_indexed(documents: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """grep() of a literal in the documents that a trigram index leaves. index: tri, doc_key."""
    index = postings(documents, "doc_key") if index is None else index
    return grep(documents.join(candidates(index, documents, "doc_key", query), "doc_key", "left_semi"), query, literal=True)


def admitted(documents: DataFrame, index: Index, plans: list[object], accept: DataFrame | None = None) -> DataFrame:
    """The documents (doc_key, text, text_sha256) whose text a search has to read, with `wanted`, which of the plans leave them.

    accept (doc_key) tells which candidates may be read at all. A candidate that documents lack, or whose text hasn't the
    recorded digest, is an error once it is read.
    """
    found = reduce(DataFrame.unionByName, [index.candidates(p).withColumn("_plan", F.lit(i)) for i, p in enumerate(plans)])
    found = found if accept is None else found.join(accept.select("doc_key"), "doc_key", "left_semi")
    found = found.groupBy("doc_key").agg(F.collect_set("_plan").alias("wanted"))
    rows = found.join(documents.withColumn("_there", F.lit(True)), "doc_key", "left")
    known = F.coalesce(F.col("_there"), F.lit(False)) & (F.sha2("text", 256) == F.col("text_sha256"))
    text = F.when(known, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a candidate is missing or has changed: "), F.col("doc_key"))))
    return rows.withColumn("text", text).select(*documents.columns, "wanted")


def indexed_searches(documents: DataFrame, index: Index, queries: list[str], literal: bool = False, ignore_case: bool = False, accept: DataFrame | None = None) -> DataFrame:
    """grep() of several patterns, told by `pattern`, in the documents that the index leaves for them: each is read and split once.

    The lines are those of a scan, as candidates are a superset of what matches.
    """
    regexes = [pattern(q, ignore_case, literal) for q in queries]
    rows = lines(admitted(documents, index, [plan(q, ignore_case, literal) for q in queries], accept).filter("text <> ''"), "doc_key", "path", "wanted")
    hits = F.array(*[F.when(F.array_contains("wanted", i) & F.col("line").rlike(r), F.struct(F.lit(i).alias("pattern"), byte_column(F.col("line"), r).alias("match_column"))) for i, r in enumerate(regexes)])
    found = rows.withColumn("_hit", F.explode(F.array_compact(hits))).select("*", "_hit.*").drop("_hit", "wanted")
    return found.withColumn("citation", citation(F.col("path"), F.col("line_no"), F.col("line_no")))


def lexical(documents: DataFrame, query: str, limit: int, anchored: bool = True, with_text: bool = True) -> DataFrame:
    """Each document's best window for a query: any term matches a line, the window around it is scored, the best stays.

    Columns: doc_key, path, match_line, first, last, text, score, literal_anchor. A document is one section here;
    windows end at its first and last line. Without text the documents are read once.
    """
    rows = with_lines(documents.filter(contains_any(F.col("text"), token_list(query))).select("doc_key", "path", "text"))
    found = best_windows(rows, query, whole=True)
    found = found if anchored else found.withColumn("literal_anchor", F.lit(False))
    top = strongest(found, "doc_key").orderBy(F.desc("score"), "path", "first").limit(limit)
    if not with_text:
        return top
    texts = rows.join(F.broadcast(top.drop("path")), "doc_key").withColumn("text", window_text(F.col("first"), F.col("last")))
    return texts.select("doc_key", "path", "match_line", "first", "last", "text", "score", "literal_anchor").orderBy(F.desc("score"), "path", "first")


def leaf_interleave(leaves: DataFrame, ranked: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """First leaves of all ranked documents, then second ones, and so on; nodes that were seen are skipped.

    leaves: doc, node, ord; ranked: doc, rank; seen: doc, node.
    """
    offset = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    rows = leaves.join(ranked, "doc").withColumn("offset", offset).join(seen, ["doc", "node"], "left_anti")
    return rows.orderBy("offset", "rank").limit(most)


def routed(scores: DataFrame, most: int = ROUTED) -> DataFrame:
    """doc, score and rank (from 1) of the best-scored documents."""
    top = scores.orderBy(F.desc("score"), "doc").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))


def floored(hits: DataFrame, min_score: float) -> DataFrame:
    """Hits with the least score, and those with a literal anchor whatever their score."""
    return hits.filter(F.col("literal_anchor") | (F.col("score") >= min_score))


def round_robin(views: DataFrame, most: int) -> DataFrame:
    """Union of ranked views, a span once: first of each view, then second of each. Adds the views that have the span.

    views: view, rank (from 0 in each view), span. A span is taken at its first place, so its least (rank, view) orders it.
    """
    spans = views.groupBy("span").agg(F.min(F.struct("rank", "view")).alias("_at"), F.array_join(F.array_sort(F.collect_set(F.col("view").cast("string"))), ",").alias("view_ids"))
    top = spans.orderBy("_at.rank", "_at.view").limit(most)
    place = F.row_number().over(Window.orderBy("_at.rank", "_at.view"))
    return top.select("span", "view_ids", F.col("_at.rank").alias("rank"), F.col("_at.view").alias("view"), place.alias("place"))


def view_coverage(views: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per view, how many of its spans the union has and how many it omits."""
    marked = views.join(chosen.select("span", F.lit(1).alias("_in")), "span", "left")
    return marked.groupBy("view").agg(F.count("_in").alias("selected"), F.count(F.when(F.col("_in").isNull(), 1)).alias("omitted"))


#: Roles of evidence, strongest first.
ROLES = ("direct_support", "source_local_incomplete", "background", "no_support")


def role_rank(role: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    return F.when(rank > 0, rank.cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), role)))


def role_order(rows: DataFrame) -> DataFrame:
    """Add place, by literal anchor, role, score, path and bytes."""
    order = Window.orderBy(F.desc("literal_anchor"), role_rank(F.col("role")), F.desc("score"), "path", "byte_start", "byte_end")
    return rows.withColumn("place", F.row_number().over(order))
