"""The engine's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.patterns import plan
from folioscan.functions.text import byte_clip, generic_title, lexical_score, literal_anchor, normalized, pattern, token_list, tokens
from folioscan.operators import accounting, decisions, evaluation, hits, lines, outline, results, rules, search, tree, trigram
from folioscan.plans.search import TermOverlap, descriptions
from folioscan.plans.search import search as whole_search
from folioscan.sources import chain
from folioscan.sources.corpus import corpus_rows, fresh, scoped, table_documents, table_pages
from folioscan.sources.storage import new_folder, remove, settle
from folioscan.streaming import calls, publication
from folioscan.streaming.ledger import file_stream, folded

LITERAL, REGEX, QUERY = "tion of", "[Tt]h[a-z]{2,}ing[.,]", "ontion threa of"
VIEWS = ("ontion threa of", "thanedble there", "enonth ing")
#: Alternatives, repeats, classes of all kinds, groups and flags; the last two leave no trigram to the index.
PATTERNS = (
    "[Tt]h[a-z]{2,}ing[.,]", r"\p{Lu}\p{Ll}*tion of", "(?i)licensed under (the|cc)", r"(?P<name>MIT|Apache) License", "[[:alpha:]]+ción(es)? (de|que)",
    "(on|er)(tion|thing)+[^a-z]", r"^\p{Lu}[\p{Ll}&&[a-zñ]--[a-y]]", r"\d{4}",
)
LEVELS = {"system": 1, "user": 2, "assistant": 3}

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])

    CATALOG[f.__name__] = run
    return f


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in microseconds and the number in their properties."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("long"), "cents": F.round(F.col("value") * 100).cast("long")})


def doc_lines(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return lines.lines(table_documents(spark, d), *(keys or ("doc_id",)))


@query
def corpus_catalog(spark, d):
    n = F.size(lines.raw_lines(F.col("text")))
    return table_documents(spark, d).select("doc_id", "path", "doc_key", "text_sha256", "source_bytes", n.alias("n_lines"))


@query
def line_index(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", "byte_start", "byte_end")


@query
def literal_search(spark, d):
    found = search.grep(table_documents(spark, d), LITERAL, literal=True)
    return search.budgeted(found, 200, "doc_key", "line_no")[0].select("doc_key", "path", "line_no", "match_column", "byte_start", "citation")


@query
def regex_search(spark, d):
    return search.budgeted(search.grep(table_documents(spark, d), REGEX), 200, "doc_key", "line_no")[0].select("doc_key", "line_no", "match_column", "citation")


@query
def regex_truncated(spark, d):
    return search.budgeted(search.grep(table_documents(spark, d), REGEX), 200, "doc_key", "line_no")[1]


@query
def regex_search_casefold(spark, d):
    return search.grep(table_documents(spark, d), "ÊTRE|über|ñas", ignore_case=True).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@query
def grep_context(spark, d):
    rows = lines.context(doc_lines(spark, d), 2, "doc_id").filter(F.contains("line", F.lit(LITERAL)))
    return rows.select("doc_id", "line_no", F.sha2("context", 256).alias("context_sha256"))


@query
def scoped_search(spark, d):
    """Matches in one document, the last by path that has any."""
    docs = table_documents(spark, d)
    path = docs.filter(F.contains("text", F.lit(LITERAL))).agg(F.max("path")).first()[0]
    return search.budgeted(search.grep(scoped(docs, path), LITERAL, literal=True), 50, "doc_key", "line_no")[0].select("path", "line_no", "match_column")


@query
def trigram_postings_stats(spark, d):
    index = trigram.postings(table_documents(spark, d), "doc_id")
    return index.groupBy("tri").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def with_index(spark: SparkSession, docs: DataFrame, key: str, use: Callable[[trigram.Index], DataFrame]) -> DataFrame:
    """What use makes of a stored index of docs. The result is kept, the index removed."""
    path = new_folder(spark, "index")
    trigram.write_index(docs, key, path)
    found = settle(use(trigram.open_index(spark, path)))
    remove(spark, path)
    return found


@query
def trigram_candidates_vs_scan(spark, d):
    docs = table_documents(spark, d)
    found = with_index(spark, docs, "doc_id", lambda index: index.candidates(plan(LITERAL, literal=True)))
    verified = docs.join(found, "doc_id", "left_semi").withColumn("verified", F.contains("text", F.lit(LITERAL)))
    return verified.select("doc_id", "verified")


@query
def search_coverage_report(spark, d):
    docs = table_documents(spark, d)
    found = with_index(spark, docs, "doc_id", lambda index: index.candidates(plan(LITERAL, literal=True))).withColumn("c", F.lit(1))
    hit = F.contains("text", F.lit(LITERAL))
    rows = docs.join(found, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count("c").alias("candidates"), F.count(F.when(hit & F.col("c").isNotNull(), 1)).alias("verified"), F.count(F.when(hit & F.col("c").isNull(), 1)).alias("lost"))


@query
def regex_index_search(spark, d):
    """Lines that match each of some patterns, read from the documents that one stored index leaves for it."""
    docs = table_documents(spark, d)

    found = with_index(spark, docs, "doc_key", lambda index: search.indexed_searches(docs, index, list(PATTERNS)))
    return found.select("pattern", "doc_key", "line_no", "byte_start", "match_column")


@query
def regex_index_coverage(spark, d):
    """For each pattern, how many documents the index leaves, how many of them match, and how many match that it doesn't leave."""
    docs = table_documents(spark, d)

    every = docs.select("doc_key", F.explode(F.sequence(F.lit(0), F.lit(len(PATTERNS) - 1))).alias("pattern"))

    def left(index: trigram.Index) -> DataFrame:
        return reduce(DataFrame.unionByName, [index.candidates(plan(p)).withColumn("pattern", F.lit(i)) for i, p in enumerate(PATTERNS)])

    left = with_index(spark, docs, "doc_key", left).withColumn("_left", F.lit(1))
    rows = lines.lines(docs, "doc_key")
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(pattern(p)), F.lit(i)) for i, p in enumerate(PATTERNS)]))
    hits = rows.select("doc_key", F.explode(hits).alias("pattern")).distinct().withColumn("_hit", F.lit(1))
    rows = every.join(left, ["doc_key", "pattern"], "left").join(hits, ["doc_key", "pattern"], "left")
    return rows.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("documents"), F.count("_left").alias("candidates"), F.count(F.when(F.col("_left") == 1, F.col("_hit"))).alias("verified"), F.count(F.when(F.col("_left").isNull(), F.col("_hit"))).alias("lost")
    )


@query
def query_tokens(spark, d):
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", tokens(F.col("text")).alias("t"))
    return rows.select("item_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def lexical_line_score(spark, d):
    rows = doc_lines(spark, d).withColumn("score", lexical_score(F.col("line"), token_list(QUERY)))
    return rows.filter("score > 0").select("doc_id", "line_no", "score")


@query
def lexical_best_window_topk(spark, d):
    top = search.lexical(table_documents(spark, d), QUERY, 20)
    return top.select("path", "match_line", "first", "last", "score", F.sha2("text", 256).alias("text_sha256"))


HIT = "path node_id match_line match_column line_start line_end page_start page_end byte_start byte_end column_start node_offset next_offset complete unread_before unread_after text_truncated score literal_anchor citation".split()


def conversation_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as paginated documents with a path, and their pages' lines."""
    pages = table_pages(spark, d)
    texts = tree.assembled(pages).select(F.col("doc").alias("doc_key"), F.concat(F.lit("conv/"), F.col("doc").cast("string")).alias("path"), "text")
    return texts, tree.page_spans(pages).select("doc", "number", "line_start", "line_end")


@query
def node_search_hits(spark, d):
    """The best window of each section of paginated documents, as hits; sections come from bookmarks and layout headings."""
    texts, spans = conversation_texts(spark, d)
    found = hits.lexical_hits(texts, QUERY, 200, CATALOG["bookmark_tree"](spark, d), spans)
    return found.select(*HIT, F.sha2("text", 256).alias("text_sha256"))


@query
def regex_snippets(spark, d):
    """Matches of a pattern with two lines around them, in snippets of 160 bytes."""
    found = hits.regex_hits(table_documents(spark, d), REGEX, 500, 2, most=160)
    return found.select("doc_key", *HIT, F.sha2("text", 256).alias("text_sha256"))


@query
def lines_of_bytes(spark, d):
    """The line of every 997th byte of every document."""
    docs = table_documents(spark, d)
    places = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long"), F.lit(997).cast("long"))).alias("byte"))
    return hits.lines_of_bytes(places, lines.lines(docs, "doc_id").select("doc_id", "line_no", "byte_start"), "doc_id")


@query
def fitted_windows(spark, d):
    """Windows of at most 600 bytes that fit in 610 as JSON: lines and quotes take more, so that windows with many of them are cut smaller."""
    return lines.fitted_windows(table_documents(spark, d), 600, 610, "doc_id")


@query
def literal_anchor_flags(spark, d):
    rows = doc_lines(spark, d).filter(F.contains(F.lower("line"), F.lit("tion")))
    return rows.select("doc_id", "line_no", literal_anchor(F.col("line"), "ontion").alias("anchor"))


@query
def paginated_document_assembly(spark, d):
    rows = tree.assembled(table_pages(spark, d))
    return rows.select("doc", "n_pages", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


@query
def page_spans(spark, d):
    return tree.page_spans(table_pages(spark, d)).select("doc", "number", "line_start", "line_end")


@query
def page_completeness_check(spark, d):
    pages = table_pages(spark, d)
    broken = pages.filter(~((F.col("doc") % 10 == 3) & (F.col("number") == 1)))
    return tree.incomplete(broken)


@query
def node_byte_ranges(spark, d):
    """Bytes of each page in its assembled document, closing line feeds included."""
    pages = table_pages(spark, d)
    rows = lines.lines(tree.assembled(pages), "doc").withColumn("line_no", F.col("line_no"))
    spans = tree.pages_of_lines(rows, tree.page_spans(pages))
    return spans.groupBy("doc", "page").agg(F.min("byte_start").alias("byte_start"), (F.max("byte_end") + 1).alias("byte_end"))


@query
def line_to_page(spark, d):
    pages = table_pages(spark, d)
    hits = lines.lines(tree.assembled(pages), "doc").filter(F.contains("line", F.lit("tion")))
    return tree.pages_of_lines(hits, tree.page_spans(pages)).select("doc", "line_no", "page")


def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown: a turn has a heading by its role, some in the underlined form, with marks; some bring headings in code, quotes and lists, which are none."""
    n, k = F.col("number").cast("string"), F.col("number")
    head = F.when(F.col("role") == "system", F.concat(F.lit("System *"), n, F.lit("*\n===\n"))).when(F.col("role") == "user", F.concat(F.lit("## User **"), n, F.lit("** `a_b` ##\n")))
    head = head.otherwise(F.concat(F.lit("### [Reply "), n, F.lit("](x) &amp; <b>more</b>\n")))
    odd = F.when(k % 5 == 4, "```\n# code\n```\n").when(k % 5 == 3, "> # quoted\n\n").when(k % 5 == 2, "- # item\n\n  # of it\n\n").otherwise("")
    body = F.concat(F.lit("x "), F.regexp_replace("text", "\n", "\nx "), F.lit("\n\n"))
    parts = table_pages(spark, d).select("doc", "number", F.concat(F.when(k > 1, head).otherwise(""), F.lit("\n"), odd, body).alias("part"))
    rows = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("number", "part"))).alias("p"))
    return rows.select("doc", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("text"), F.concat(F.lit("c"), F.col("doc").cast("string")).alias("title"))


@query
def markdown_tree(spark, d):
    docs = markdown_documents(spark, d)
    return outline.built(docs, outline.whole_pages(docs), outline.document_headings(docs))


@query
def nested_trees(spark, d):
    """Each Markdown document's sections as one nested JSON."""
    docs = markdown_documents(spark, d)
    found = outline.nested(outline.built(docs, outline.whole_pages(docs), outline.document_headings(docs)))
    return found.select("doc", "nodes", "depth", F.octet_length("tree").alias("bytes"), F.sha2("tree", 256).alias("tree_sha256"))


def page_bookmarks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of conversations, bookmarks and layout headings of them. Every ninth conversation has neither.

    Titles are a page's first two lines, or stand on no page, or only number it; some go back, to no page or have no level.
    """
    pages = tree.page_spans(table_pages(spark, d)).withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    rows = pages.filter("doc % 9 <> 0").withColumn("ls", F.split("text", "\n"))
    n = F.col("number")
    first = F.trim(F.array_join(F.slice("ls", 1, 2), " "))
    title = F.when(n % 4 == 0, F.concat(F.lit("Absent "), n.cast("string"))).when(n % 4 == 3, F.concat(F.lit("Page "), n.cast("string"))).otherwise(first)
    own = rows.select("doc", (2 * n).alias("ord"), title.alias("title"), F.expr("1 + number * 7 % 3").cast("int").alias("level"), n.alias("page"))
    wrong = rows.filter("number % 3 = 0").select(
        "doc", (2 * n + 1).alias("ord"), F.concat(F.lit("Odd "), n.cast("string")).alias("title"), F.when(n % 2 == 0, 0).otherwise(1).alias("level"), F.when(n % 5 == 0, 0).when(n % 5 == 1, n + 1000).otherwise(n - 1).alias("page")
    )
    top = rows.select("doc", (2 * n).alias("ord"), F.trim(F.element_at("ls", 1)).alias("title"), F.expr("1 + number % 2").cast("int").alias("level"), n.alias("page"), F.lit(1).alias("line"))
    low = rows.select("doc", (2 * n + 1).alias("ord"), F.trim(F.element_at("ls", -1)).alias("title"), F.lit(2).alias("level"), n.alias("page"), F.size("ls").alias("line"))
    return pages, own.unionByName(wrong), top.unionByName(low)


@query
def bookmark_admission(spark, d):
    pages, bookmarks, _ = page_bookmarks(spark, d)
    return outline.admitted(bookmarks, pages).select("doc", "ord", "page", "level", "accepted")


@query
def bookmark_places(spark, d):
    pages, bookmarks, _ = page_bookmarks(spark, d)
    return outline.framed(outline.admitted(bookmarks, pages), pages).select("doc", "ord", "page", "line", "page_boundary")


@query
def bookmark_tree(spark, d):
    """Sections of paginated documents: bookmarks as a frame, layout headings within it, pages where there are neither."""
    pages, bookmarks, layout = page_bookmarks(spark, d)
    headings = outline.merged(outline.layout_lines(layout, pages), outline.framed(outline.admitted(bookmarks, pages), pages))
    docs = pages.select("doc", F.concat(F.lit("c"), F.col("doc").cast("string")).alias("title")).distinct()
    return outline.built(docs, pages, headings).withColumn("title", F.sha2("title", 256))


def conversation_nodes(spark: SparkSession, d: str) -> DataFrame:
    spans = tree.page_spans(table_pages(spark, d))
    level = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("role"))
    heads = spans.select("doc", F.col("line_start").alias("line"), level.alias("level"), F.concat_ws(" ", "role", F.col("number").cast("string")).alias("title"))
    return tree.sections(heads, spans.groupBy("doc").agg(F.max("line_end").alias("last_line")))


@query
def tree_from_headings(spark, d):
    return conversation_nodes(spark, d)


@query
def leaf_nodes(spark, d):
    return tree.leaves(conversation_nodes(spark, d)).select("doc", "node_id", "title")


@query
def deepest_node_for_line(spark, d):
    rows = lines.lines(tree.assembled(table_pages(spark, d)), "doc")
    return tree.deepest(conversation_nodes(spark, d), rows)


@query
def manifest_violations(spark, d):
    nodes, spans = conversation_nodes(spark, d), tree.page_spans(table_pages(spark, d))
    bad = nodes.withColumn("line_end", F.when(F.col("parent_id").isNotNull() & (F.col("doc") % 7 == 0), F.col("line_end") + 100_000).otherwise(F.col("line_end")))
    twice = bad.unionByName(bad.filter("doc % 11 = 0 AND ord = 0"))
    return tree.violations(twice, spans)


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The sections of conversations with their pages."""
    nodes = conversation_nodes(spark, d)
    spans = tree.page_spans(table_pages(spark, d)).select("doc", "number", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    joined = nodes.join(spans, "doc").filter("s <= line_end AND e >= line_start")
    pages = joined.groupBy(*nodes.columns).agg(F.min("number").alias("page_start"), F.max("number").alias("page_end"))
    return pages.withColumn("key_items", F.array().cast("array<string>"))


@query
def merge_cost_frontier(spark, d):
    return tree.costs(page_nodes(spark, d))


@query
def merge_fixpoint(spark, d):
    return tree.merged(page_nodes(spark, d)).withColumn("key_items", F.array_join("key_items", "|"))


@query
def heading_locate(spark, d):
    """Lines at which each page's first words stand."""
    pages = table_pages(spark, d)
    heads = pages.select("doc", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " ").alias("title"))
    return tree.located(heads, lines.lines(tree.assembled(pages), "doc"))


@query
def generic_bookmark_filter(spark, d):
    """Titles of bookmarks, and numbered in several manners, that only tell a page."""
    marks = page_bookmarks(spark, d)[1].select("doc", "ord", F.explode(F.array("title", F.concat(F.lit("Slide "), F.col("page").cast("string")), F.concat(F.lit("Folie "), F.col("title")), F.col("ord").cast("string"))).alias("title"))
    return marks.select("doc", "ord", normalized(F.col("title")).alias("normalized"), generic_title(F.col("title")).alias("generic"))


@query
def html_heading_tree(spark, d):
    return tree.html_headings(spark.read.parquet(f"{d}/pages.parquet"))


@query
def routing_descriptions(spark, d):
    rows = descriptions(table_documents(spark, d), 32)
    return rows.select("doc_key", "path", F.octet_length("description").alias("n_bytes"), F.sha2("description", 256).alias("description_sha256"))


@query
def semantic_round_robin(spark, d):
    """Pages of the conversations that routing ranks first, interleaved, without those that have a term of the query."""
    pages = table_pages(spark, d)
    scores = pages.groupBy("doc").agg((F.count(F.when(F.contains("text", F.lit("tion")), 1)) / F.count(F.lit(1))).alias("score"))
    leaves = pages.select("doc", F.col("number").alias("node"), F.col("number").alias("ord"))
    seen = pages.filter(F.contains("text", F.lit("hand"))).select("doc", F.col("number").alias("node"))
    return search.leaf_interleave(leaves, search.routed(scores), seen, 24).select("doc", "node", "offset", "rank")


@query
def hybrid_search(spark, d):
    hits = whole_search(table_documents(spark, d), QUERY, search.Options(min_score=0.3), TermOverlap())
    return hits.select("path", "first", "score", "literal_anchor")


def ranked_views(spark: SparkSession, d: str) -> DataFrame:
    docs, out = table_documents(spark, d), None
    for view, text in enumerate(VIEWS):
        top = search.lexical(docs, text, 24, anchored=view == 0, with_text=False)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "path", "first")) - 1
        rows = top.select(F.lit(view).alias("view"), rank.alias("rank"), F.concat_ws(":", "path", "first", "last").alias("span"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def planned_union_round_robin(spark, d):
    return search.round_robin(ranked_views(spark, d), 24)


@query
def planned_view_coverage(spark, d):
    views = ranked_views(spark, d)
    return search.view_coverage(views, search.round_robin(views, 24))


@query
def role_policy_order(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = table_documents(spark, d).join(labels, "doc_id")
    role = F.element_at(F.array(*[F.lit(r) for r in search.ROLES]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = rows.select("path", role.alias("role"), (F.col("doc_id") % 5 == 0).alias("literal_anchor"), (F.col("quality") / 2 + F.col("toxic") / 4).alias("score"), F.lit(0).alias("byte_start"), F.col("source_bytes").alias("byte_end"))
    return search.role_order(rows).filter("place <= 24").select("path", "role", "literal_anchor", "score", "place")


@query
def decision_distribution_check(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("k") / 100, 1 - F.col("cents") / 10000)).alias("probabilities"), F.when(F.col("k") > 50, "a").when(F.col("k") > 5, "b").otherwise("c").alias("choice"))
    return evaluation.distribution_errors(rows)


@query
def duplicate_json_guard(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":1,'), F.expr("substring(props, 2)"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return evaluation.json_faults(events(spark, d).select("event_id", body.alias("payload"))).select("event_id", "valid")


@query
def citation_validation(spark, d):
    rows = lines.lines(table_documents(spark, d).filter(F.contains("text", F.lit(LITERAL))), "doc_key").filter(F.contains("line", F.lit(LITERAL)))
    issued = rows.select(F.col("doc_key").alias("node"), "byte_start", "byte_end", F.sha2("line", 256).alias("sha256"))
    cited = issued.withColumn("byte_end", F.when(F.col("byte_start") % 3 == 0, F.col("byte_end") + 1).otherwise(F.col("byte_end")))
    return evaluation.uncited(cited, issued)


@query
def node_window_cursor(spark, d):
    """The first 4096 bytes of each document, where the next window begins, and what stays unread."""
    clip = byte_clip(F.col("text"), 4096)
    rows = table_documents(spark, d).select("doc_id", "source_bytes", F.octet_length(clip).cast("long").alias("read"))
    return rows.select("doc_id", "read", F.when(F.col("read") < F.col("source_bytes"), F.col("read")).alias("next_offset"), (F.col("source_bytes") - F.col("read")).alias("unread_after"))


@query
def document_windows(spark, d):
    return lines.byte_windows(table_documents(spark, d), 8192, "doc_id")


@query
def window_coverage_union(spark, d):
    rows = events(spark, d).select("user_id", F.col("at").alias("a"), (F.col("at") + F.col("k") * 60_000_000).alias("b"))
    return accounting.interval_union(rows, "user_id", "a", "b")


@query
def hint_dedup_rank(spark, d):
    """First lines of documents as hints, equal ones once, by score and digest."""
    hint = F.element_at(lines.raw_lines(F.col("text")), 1)
    rows = table_documents(spark, d).select(F.sha2(hint, 256).alias("hint_id"), lexical_score(hint, token_list(QUERY)).alias("score"))
    unique = rows.groupBy("hint_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).filter("score > 0")
    return unique.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "hint_id"))).filter("place <= 8")


@query
def batch_packing(spark, d):
    """Benchmark items of each length class in batches of at most 8 items and 2048 bytes, in order."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.octet_length("text").alias("n"), (F.col("item_id") % 16).alias("lane"))

    def pack(group):
        group = group.sort_values("item_id")
        return group.assign(batch=evaluation.packed_batches(group["n"].tolist(), 8, 2048))[["lane", "item_id", "batch"]]

    return rows.groupBy("lane").applyInPandas(pack, "lane long, item_id long, batch long")


@query
def stale_documents_status(spark, d):
    docs = table_documents(spark, d)
    recorded = docs.select("path", F.col("text_sha256").alias("source_sha256"))
    now = docs.filter("doc_id % 17 <> 4").select("path", F.when(F.col("doc_id") % 13 == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("text_sha256")).alias("source_sha256"))
    return fresh(recorded, now).filter("NOT source_fresh").select("path")


@query
def exact_duplicate_sources(spark, d):
    return table_documents(spark, d).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


@query
def ledger_latest_state(spark, d):
    return accounting.latest(events(spark, d), "user_id", "event_id", "event_type", "cents")


@query
def ledger_chain_gaps(spark, d):
    return accounting.gaps(events(spark, d), "user_id", "at")


@query
def ledger_chain_breaks(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, d).withColumns({"sequence": F.row_number().over(order) - 1, "sha256": F.sha2("props", 256)})
    rows = rows.withColumn("previous_sha256", F.lag("sha256").over(order)).withColumn("sha256", F.when(F.col("event_id") % 101 == 7, F.lit("lost")).otherwise(F.col("sha256")))
    return accounting.chain_breaks(rows.withColumnRenamed("user_id", "ledger")).select("ledger", "sequence", "event_id")


@query
def call_summary_nullstrict(spark, d):
    rows = events(spark, d).withColumn("cents", F.when(F.col("event_type").isin("error", "signup") & (F.col("k") > 40), None).otherwise(F.col("cents")))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), *accounting.strict("cents"))


@query
def token_usage_dedup(spark, d):
    rows = events(spark, d).withColumn("turn", F.col("k"))
    return accounting.usage_totals(rows, "event_type", "user_id", "turn", "cents")


@query
def retry_resolution(spark, d):
    rows = events(spark, d).withColumns({"ok": F.col("event_type") != "error", "request": F.col("k") % 10})
    return accounting.retried(rows, "user_id", "request", "event_id").select("event_id", "user_id", "request", "resolved_by")


@query
def concurrency_sweep(spark, d):
    rows = events(spark, d).select("user_id", F.col("at").alias("a"), (F.col("at") + (F.col("k") + 1) * 600_000_000).alias("b"))
    return accounting.concurrency(rows, "user_id", "a", "b")


@query
def price_band_cost(spark, d):
    card = [("large", 1, 50, "2.50", "0.25", "10"), ("large", 2, None, "5", "0.5", "15"), ("small", 1, None, "0.40", "0.04", "1.6")]
    bands = spark.createDataFrame(card, "model string, band long, max_input long, i string, c string, o string")
    bands = bands.select("model", "band", "max_input", *[F.col(a).cast("decimal(10,4)").alias(b) for a, b in (("i", "input_rate"), ("c", "cached_rate"), ("o", "output_rate"))])
    turns = events(spark, d).select(F.col("event_id").alias("_id"), F.when(F.col("event_type") == "view", "large").otherwise("small").alias("model"), F.col("k").alias("input"), F.expr("k div 4").alias("cached"), "cents")
    rows = accounting.priced(turns.withColumnRenamed("cents", "output"), bands)
    return rows.groupBy("model", "band").agg(F.count(F.lit(1)).alias("turns"), F.sum("cost").cast("double").alias("cost"))


def with_words(spark: SparkSession, d: str, use: Callable[[DataFrame, DataFrame, DataFrame], list[DataFrame]]) -> list[DataFrame]:
    """What use makes of documents, benchmark items and the items' words that documents have. The results are kept, the words removed."""
    docs, items, path = table_documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text"), new_folder(spark, "words")
    evaluation.words_of(docs, items).write.parquet(path)
    found = [settle(f) for f in use(docs, items, spark.read.parquet(path))]
    remove(spark, path)
    return found


def judgements(spark: SparkSession, d: str) -> list[DataFrame]:
    """Benchmark items as queries: hits are the documents retrieved for it; relevant are the documents that contain the whole item."""
    names = (F.col("item_id").alias("query"), F.col("doc_id").alias("item"))
    return with_words(spark, d, lambda docs, items, held: [evaluation.retrieved(items, held, 10).select(*names, "rank"), evaluation.containing(docs, items, held).select(*names)])


@query
def item_retrieval(spark, d):
    return with_words(spark, d, lambda docs, items, held: [evaluation.retrieved(items, held, 10)])[0]


@query
def eval_recall_mrr(spark, d):
    hits, relevant = judgements(spark, d)
    return evaluation.recall_mrr(hits, relevant, 5).withColumnRenamed("query", "item_id")


@query
def page_recall(spark, d):
    """Pages with a term as gold, lines with another as hits ranked by length."""
    pages = table_pages(spark, d)
    gold = pages.filter(F.contains("text", F.lit("tion"))).select(F.col("doc").alias("query"), F.col("number").alias("item"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.octet_length("text")), "number"))
    hits = pages.withColumn("rank", rank).select(F.col("doc").alias("query"), F.col("number").alias("item"), "rank")
    return evaluation.recall_mrr(hits, gold, 3).withColumnRenamed("query", "doc")


@query
def latency_percentiles(spark, d):
    return evaluation.percentiles(events(spark, d), "event_type", "value")


@query
def cohort_summary(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(table_documents(spark, d).select("doc_id", "source"), "doc_id")
    rows = rows.select("source", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 0).alias("fit"))
    return evaluation.cohorts(rows, "source", "ok", "fit")


@query
def paired_comparison(spark, d):
    rows = events(spark, d)
    a = rows.select("event_id", (F.col("k") > 30).alias("ok"))
    b = rows.filter("event_type <> 'signup'").select("event_id", (F.col("cents") > 1000).alias("ok"))
    return evaluation.paired(a, b, "event_id", "ok")


@query
def replay_rank_join(spark, d):
    docs = table_documents(spark, d).select("doc_id", "text_sha256")
    return accounting.replayed(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "text_sha256", "doc_id")


@query
def first_valid_outcome(spark, d):
    rows = events(spark, d).withColumns({"ok": F.col("event_type").isin("purchase", "click"), "origin": F.concat_ws("/", F.col("user_id").cast("string"), (F.col("k") % 5).cast("string"))})
    return accounting.first_valid(rows, "origin", "event_id", "ok", "event_type")


@query
def ledger_transition_violations(spark, d):
    rows = accounting.transition_violations(events(spark, d), "user_id", "event_id", "event_type", ["purchase"], ["view", "click", "error", "purchase"])
    return rows.groupBy("user_id", "violation").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query
def streaming_ledger_fold(spark, d):
    return folded(spark, f"{d}/events.parquet", new_folder(spark, "ledger"), {"operation": "user_id", "sequence": "event_id", "status": "event_type"})


def call_events(rows: DataFrame) -> DataFrame:
    """Ledgers of 25 events each: a regular course of calls and windows, with breaches of each rule where an event's number tells so."""
    i, k = F.col("event_id") % 25, F.get_json_object("props", "$.k").cast("long")
    step, cycle = (i - 1) % 5, F.floor((i - 1) / 5)
    kind = F.when(i == 0, "bound").when(k % 31 == 30, "checkpoint").when(k % 37 == 36, "failed").when(k % 41 == 40, "rebuilt").when(i == 23, "prepared").when(i == 24, "published")
    kind = kind.otherwise(F.element_at(F.array(*[F.lit(x) for x in ("reserved", "received", "reserved", "received", "window")]), (step + 1).cast("int")))
    ledger, at = F.floor(F.col("event_id") / 25).cast("string"), F.col("ts").cast("timestamp")
    return rows.select(
        ledger.alias("ledger"), "event_id", F.when(k % 29 == 28, i - 3).otherwise(i).alias("sequence"), kind.alias("kind"), (cycle * 2 + (step >= 2).cast("int") + (k % 23 == 22).cast("int")).cast("long").alias("call_id"),
        F.when(step < 2, "builder").otherwise("judge").alias("call_kind"), (k % 43).alias("size"), (k % 19 != 18).alias("ok"), F.sha2(F.concat(ledger, F.when((i == 24) & (k % 5 == 0), "!").otherwise("")), 256).alias("sha256"), at.alias("at"), F.unix_millis(at).alias("ms"),
    )


@query
def call_ledger_verdicts(spark, d):
    """What a stateful stream says on each event of ledgers of calls, and the ledgers whose open call ran out of time."""
    folder = new_folder(spark, "calls")
    return calls.run(call_events(file_stream(spark, f"{d}/events.parquet")), folder, {"builder": 4, "judge": 4}, 3 * 86_400_000)


QUESTIONS = '{"a":{"type":"noul","instructions":"i"},"b":{"type":"choice","instructions":["x"],"criteria":{"yes":"y","no":null}},"c":{"type":"score","instructions":{"t":1},"criteria":["low","mid","high"]}}'
ANSWERS = (
    '{"model":"m","id":"r","answers":{"a":{"type":"noul","noul":0.5},"b":{"type":"choice","choice":"yes","confidence":0.9,"probabilities":{"yes":0.7,"no":0.3}},'
    '"c":{"type":"score","score":1.2,"probabilities":{"0":0.1,"1":0.6,"2":0.3},"legend":{"0":"low","1":"mid","2":"high"}}},"usage":{"input_tokens":5,"output_tokens":null,"cost":0.25}}'
)
#: What is changed in the questions or the answers, the question at fault and the fault's name.
REQUEST_FAULTS = (
    ('{"a":', '[{"a":', None, "questions"), ('"a":', '"b":1,"a":', None, "questions"), ('"a":', '"":', "", "id"), ('{"type":"noul","instructions":"i"}', '"ask"', "a", "question"), ('"i"}', '"i","more":1}', "a", "field"),
    ('"instructions":"i"', '"instructions":7', "a", "instructions"), ('"noul"', '"nul"', "a", "type"), ('"i"}', '"i","criteria":{"true":"t"}}', "a", "criteria"), (',"no":null', "", "b", "criteria"), ('"no":null', '"no":3', "b", "criteria"),
    ('"low","mid","high"', '"low"', "c", "criteria"), ('["low","mid","high"]', '{"0":"low"}', "c", "criteria"),
)
ANSWER_FAULTS = (
    ('{"model"', '{"model":"n","model"', None, "json"), ('"answers":{', '"replies":{', None, "schema"), ('"m"', '" "', None, "model"), ('"id":"r"', '"id":""', None, "metadata"), ('"input_tokens":5', '"input_tokens":-5', None, "usage"),
    ('"cost":0.25', '"cost":"low"', None, "usage"), ('"a":{', '"d":{', "a", "answer_ids"), ('"type":"noul"', '"type":"score"', "a", "answer_type"), ('"noul":0.5', '"noul":1.5', "a", "probability"), ('"noul":0.5', '"noul":"0.5"', "a", "probability"),
    ('"choice":"yes"', '"choice":"maybe"', "b", "option"), ("0.9", "-0.9", "b", "confidence"), ('"yes":0.7', '"yes":0.5', "b", "distribution"), ('"no":0.3', '"none":0.3', "b", "distribution"), ('"choice":"yes"', '"choice":"no"', "b", "disagrees"),
    ('"score":1.2', '"score":2.5', "c", "range"), ('"2":0.3', '"3":0.3', "c", "distribution"), ('"score":1.2', '"score":1.3', "c", "disagrees"), ('"2":"high"', '"2":"top"', "c", "legend"),
)


def decision_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A request and its response for each event; one in some has a fault, of each kind in turn."""
    n = F.col("event_id") % 50
    state = F.when(n == 12, F.col("k").cast("string")).otherwise(F.to_json(F.struct("k", "event_type")))
    changed = lambda whole, faults, at: F.try_element_at(F.array(*[F.lit(whole.replace(old, new, 1)) for old, new, *_ in faults]), at.cast("int"))
    asked = F.when(n == 13, "{}").otherwise(F.coalesce(changed(QUESTIONS, REQUEST_FAULTS, n + 1), F.lit(QUESTIONS)))
    sound = F.replace(F.lit(ANSWERS), F.lit("0.25"), F.concat(F.lit("0."), F.col("k").cast("string")))
    told = F.coalesce(F.when(n >= 20, changed(ANSWERS, ANSWER_FAULTS, n - 19)), sound)
    # Dealt by their ids while they are narrow: texts are made and judged by as many tasks as there are, however few row groups the file has.
    rows = events(spark, d).select("event_id", "event_type", "k").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return rows.select(F.col("event_id").alias("request_id"), state.alias("state"), asked.alias("questions")), rows.filter(n >= 14).select(F.col("event_id").alias("request_id"), told.alias("body"))


@query
def decision_request_faults(spark, d):
    return decisions.request_faults(decision_rows(spark, d)[0])


@query
def decision_response_faults(spark, d):
    return decisions.response_faults(*decision_rows(spark, d))


def appended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All lines after three appends of the users' events to their ledgers, and what became of the last one; a ledger holds 70 lines."""
    root = new_folder(spark, "chains")
    payload = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("ledger"), F.col("event_id").alias("ord"), payload.alias("payload"))
    for part in range(3):
        told = chain.append(rows.filter(F.col("ord") % 3 == part), root, chain.Budget(lines=70))
    return chain.read(spark, root), told


@query
def appended_chains(spark, d):
    return appended(spark, d)[0].select("ledger", "sequence", "previous_sha256", "sha256", "append")


@query
def appended_chain_report(spark, d):
    """Per ledger: its lines, whether the last append was taken, and breaks of its chain."""
    lines, told = appended(spark, d)
    found = lines.groupBy("ledger").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"))
    broken = chain.breaks(lines).groupBy("ledger").agg(F.count(F.lit(1)).alias("breaks"))
    rows = told.select("ledger", "accepted").join(found, "ledger", "left").join(broken, "ledger", "left")
    return rows.select("ledger", "lines", "bytes", "accepted", F.coalesce("breaks", F.lit(0)).alias("breaks"))


@query
def published_generation(spark, d):
    """Documents published from a stream of their files, then a batch that changes every fifth; both batches are sent again, as after a crash."""
    root, last = new_folder(spark, "generations"), 1_000_000
    stream = file_stream(spark, f"{d}/documents.parquet")
    publication.follow(corpus_rows(stream).select("path", "text", F.col("doc_id").alias("at")), root).awaitTermination()
    docs = table_documents(spark, d)
    changed = docs.filter("doc_id % 5 = 0").select("path", F.concat("text", F.lit("!")).alias("text"), F.col("doc_id").alias("at"))
    for number in (last, last, 0):
        name = publication.publish(changed, number, root)
    return publication.documents_of(spark, root, name).select("path", "text_sha256", "source_bytes", (F.col("batch") == last).alias("replaced"))


@query
def node_search_windows(spark, d):
    """Windows of matches in conversations, ended at the section of the matched line."""
    pages = table_pages(spark, d)
    rows = lines.lines(tree.assembled(pages), "doc")
    nodes = conversation_nodes(spark, d)
    matches = rows.filter(F.contains("line", F.lit("tion"))).select("doc", "line_no")
    found = results.node_windows(tree.deepest(nodes, matches), nodes, rows, search.BEFORE, search.AFTER)
    return found.select("doc", "node_id", "match_line", "first", "last", "byte_start", "byte_end", "column_start", F.sha2("text", 256).alias("text_sha256"))


def stale_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a build recorded and what is there now: some documents are gone, some have changed."""
    recorded = docs.select("path", F.col("text_sha256").alias("source_sha256"))
    return recorded, docs.filter("doc_id % 17 <> 4").select("path", F.when(F.col("doc_id") % 13 == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("text_sha256")).alias("source_sha256"))


@query
def stale_budget(spark, d):
    docs = table_documents(spark, d)
    found, _ = results.fresh_matches(search.grep(docs, LITERAL, literal=True), *stale_sources(docs), 60, "doc_key", "line_no")
    return found.select("path", "line_no")


@query
def visited_stale_paths(spark, d):
    docs = table_documents(spark, d)
    return results.fresh_matches(search.grep(docs, LITERAL, literal=True), *stale_sources(docs), 60, "doc_key", "line_no")[1]


@query
def catalog_page(spark, d):
    return results.paginated(table_documents(spark, d).select("path", "source_bytes"), ["path"], 40, 20)


@query
def payload_prefix(spark, d):
    rows = table_documents(spark, d).select("source", "path", F.least(F.col("source_bytes"), F.lit(4096)).alias("size"))
    return results.payload(rows, "source", ["path"], "size", 16384)


@query
def hint_packet(spark, d):
    """Items of each lane in order of id, at most 8 and 1,200 bytes; one that is too large is passed over."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") % 16).alias("lane"), "item_id", F.octet_length("text").cast("long").alias("n"))
    lists = rows.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("item_id", "n"))).alias("l"))
    taken = lists.withColumn("t", results.packet(F.transform("l", lambda x: x["n"]), 8, 1200))
    return taken.select("lane", F.explode(F.arrays_zip(F.col("l.item_id").alias("item_id"), F.col("t").alias("taken"))).alias("e")).select("lane", "e.item_id", "e.taken")


@query
def frame_headings(spark, d):
    """Turns of assistants as headings under the frames that users' turns are."""
    spans = tree.page_spans(table_pages(spark, d))
    heads = spans.select("doc", "role", F.col("line_start").alias("line"), F.concat_ws(" ", "role", F.col("number").cast("string")).alias("title"))
    frames = heads.filter("role = 'user'").select("doc", "line", F.lit(1).alias("level"), "title")
    return results.under_frames(heads.filter("role <> 'system'").select("doc", "line", F.lit(2).alias("level"), "title"), frames)


@query
def reservation_receipts(spark, d):
    rows = events(spark, d)
    outcomes = rows.filter("k % 7 <> 0").select("event_id", F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("cents")).alias("cents"))
    return rules.receipts(rows.select("event_id", "user_id"), outcomes, "event_id", "user_id", "cents")


@query
def attempt_rule_violations(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("run"), F.concat_ws("/", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("attempt"), "event_type", "event_id", "k")
    return rules.attempt_violations(rows, rows.filter("k % 11 <> 3"), "attempt", "event_type", 12, "run")


@query
def counter_regressions(spark, d):
    return rules.regressions(events(spark, d), "user_id", "event_id", "k").select("user_id", "event_id", "k", "reached")


@query
def page_specifications(spark, d):
    """Pages of specifications made from events: a range, a page and a range that may overlap it."""
    a, z = (F.col("k") % 40 + 1), F.col("event_id") % 9
    part = lambda c: c.cast("string")
    spec = F.concat(part(a), F.lit("-"), part(a + z), F.lit(", "), part(z + 1), F.lit(","), part(a + 2), F.lit("-"), part(a + z + 3))
    return events(spark, d).select("event_id", F.explode(rules.pages_of(spec)).alias("page"))


@query
def tier_agreement(spark, d):
    """Tiers that events asked for and got."""
    names = [F.lit(t) for t in ("fast", "standard", " Priority", "flex", "FAST")]
    rows = events(spark, d).select("event_id", F.element_at(F.array(*names), (F.col("k") % 5 + 1).cast("int")).alias("asked"), F.try_element_at(F.array(*names), (F.col("event_id") % 7 + 1).cast("int")).alias("observed"))
    return rows.select("event_id", "asked", "observed", rules.tier_agrees(F.col("asked"), F.col("observed")).alias("agrees"))


@query
def repeated_views(spark, d):
    """Items, and some again with other white space, as views of one request."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") % 8).alias("request"), "item_id", "text")
    other = items.select("request", (F.col("item_id") + 1_000_000).alias("item_id"), F.concat(F.lit(" "), F.regexp_replace("text", " ", "  ")).alias("text")).filter("item_id % 3 = 0")
    return rules.distinct_views(items.unionByName(other).withColumnRenamed("item_id", "view"), "text").select("request", "view", "repeats")


@query
def anchor_windows(spark, d):
    """First lines as windows, named; hints that name each window, and some that none has."""
    first = lines.lines(table_documents(spark, d), "doc_id", "doc_key").filter("line_no = 1").select("doc_id", "doc_key", "byte_start", "byte_end", F.sha2("line", 256).alias("sha256"))
    windows = rules.anchors(first, "g1")
    hints = windows.select(F.col("doc_id").alias("hint_id"), F.array("anchor_id", F.when(F.col("doc_id") % 9 == 0, F.lit("nav_unknown")).otherwise(F.col("anchor_id"))).alias("anchor_ids"))
    known, unknown = rules.anchored(hints.withColumn("anchor_ids", F.array_distinct("anchor_ids")), windows.select("anchor_id", "byte_end"))
    return known.select("hint_id", "anchor_id", "byte_end").unionByName(unknown.select("hint_id", "anchor_id", F.lit(None).cast("long").alias("byte_end")))


@query
def cost_gate(spark, d):
    rows = events(spark, d).select((F.col("event_type") != "error").alias("ok"), (F.col("cents").cast("decimal(20,6)") / 100_000).alias("model"), (F.col("k").cast("decimal(20,6)") / 100_000).alias("decisions"))
    return rules.gate(rows, "ok", ["model", "decisions"], 61, "0.003607")


@query
def eval_macro_means(spark, d):
    """Pages with a term as gold, longest pages as hits of the conversations that have a second term; by parity of the conversation."""
    pages = table_pages(spark, d)
    gold = pages.filter(F.contains("text", F.lit("tion"))).select(F.col("doc").alias("query"), F.col("number").alias("item"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.octet_length("text")), "number"))
    hits = pages.filter("doc % 5 <> 2").withColumn("rank", rank).select(F.col("doc").alias("query"), F.col("number").alias("item"), "rank")
    queries = pages.select(F.col("doc").alias("query"), F.when(F.col("doc") % 2 == 0, "even").otherwise("odd").alias("mode")).distinct()
    return rules.macro(rules.quality(hits, gold, queries, 3))
