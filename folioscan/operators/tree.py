"""Document trees: pages to text, headings to sections, sections to spans, and the merging of sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.text import normalized
from folioscan.operators.outline import markdown_headings, section_rows  # noqa: F401


def page_spans(pages: DataFrame) -> DataFrame:
    """Add line_start and line_end, the lines of each page in its document's text; a blank page has one line. pages: doc, number, text."""
    lines = F.size(F.split(F.regexp_replace(F.col("text"), "\r\n?", "\n"), "\n"))
    before = Window.partitionBy("doc").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("_lines", lines).withColumn("line_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) + 1).cast("long"))
    return rows.withColumn("line_end", (F.col("line_start") + F.col("_lines") - 1).cast("long")).drop("_lines")


def assembled(pages: DataFrame) -> DataFrame:
    """doc, text and n_pages: the pages' texts in order, each closed by a line feed."""
    text = F.regexp_replace(F.col("text"), "\r\n?", "\n")
    parts = F.array_sort(F.collect_list(F.struct("number", text.alias("text"))))
    return pages.groupBy("doc").agg(F.concat(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.lit("\n")).alias("text"), F.count(F.lit(1)).alias("n_pages"))


def incomplete(pages: DataFrame) -> DataFrame:
    """Documents whose pages aren't 1 to n, each once."""
    found = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("different"), F.min("number").alias("low"), F.max("number").alias("high"))
    return found.filter("low <> 1 OR high <> n OR different <> n")


def pages_of_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Add page to lines (doc, line_no, ...): the span that has the line. A page is sent to each of its lines, so the join is an equi-join."""
    numbered = spans.select("doc", F.col("number").alias("page"), F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    return lines.join(numbered, ["doc", "line_no"])


def sections(headings: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of a document's headings (doc, line, level, title), given each document's last line (doc, last_line).

    A node's parent is the latest earlier heading with a lower level; it ends before the next one that isn't below it.
    Both come from one pass with a stack over the headings of a document.
    """
    return section_rows(headings, ends)


def node_id(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%04d", number.cast("int")))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select("doc", F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    return nodes.join(parents, ["doc", "node_id"], "left_anti")


def deepest(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The deepest node of each line (doc, line_no); of equally deep ones the shortest, then the last."""
    spread = nodes.select("doc", "node_id", "level", "ord", (F.col("line_end") - F.col("line_start")).alias("_span"), F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    best = F.max_by("node_id", F.struct("level", (-F.col("_span")).alias("s"), "ord")).alias("node_id")
    return spread.join(lines.select("doc", "line_no"), ["doc", "line_no"], "left_semi").groupBy("doc", "line_no").agg(best)


def violations(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, kind and n: breaches of the rules that hold in a generation."""
    twice = nodes.groupBy("doc", "node_id").count().filter("count > 1").select("doc", F.lit("duplicate_node").alias("kind"))
    parent = nodes.select("doc", F.col("node_id").alias("parent_id"), F.col("line_start").alias("ps"), F.col("line_end").alias("pe"), F.col("level").alias("pl"))
    pairs = nodes.join(parent, ["doc", "parent_id"])
    outside = pairs.filter("line_start < ps OR line_end > pe").select("doc", F.lit("child_outside_parent").alias("kind"))
    level = pairs.filter("pl >= level").select("doc", F.lit("level_not_below_parent").alias("kind"))
    before = Window.partitionBy("doc").orderBy("number")
    order = spans.withColumns({"_n": F.lag("number").over(before), "_e": F.lag("line_end").over(before)}).filter("number <> coalesce(_n, 0) + 1 OR line_start <= coalesce(_e, 0) OR line_end < line_start").select("doc", F.lit("page_order").alias("kind"))
    return twice.unionByName(outside).unionByName(level).unionByName(order).groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"))


def located(headings: DataFrame, lines: DataFrame, most: int = 8) -> DataFrame:
    """First line at which a heading's title stands, perhaps broken over lines. headings: doc, title; lines: doc, line_no, line.

    Letters and digits are compared, in lower case. Lines are put together while they are a beginning of the title.
    """
    window = Window.partitionBy("doc").orderBy("line_no").rowsBetween(0, most - 1)
    runs = lines.withColumn("_next", F.collect_list(normalized(F.col("line"))).over(window))
    joined = F.transform(F.sequence(F.lit(1), F.size("_next")), lambda k: F.array_join(F.slice(F.col("_next"), F.lit(1), k), ""))
    starts = runs.select("doc", "line_no", F.element_at("_next", 1).alias("_first"), joined.alias("_joined")).filter("_first <> ''")
    wanted = headings.withColumn("_title", normalized(F.col("title"))).filter("_title <> ''").select("doc", "title", "_title").distinct()
    return starts.join(wanted, "doc").filter(F.array_contains("_joined", F.col("_title"))).groupBy("doc", "title").agg(F.min("line_no").alias("line_no"))


def node_costs(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs of one document's nodes, by two ways: cost from the leaves up, frontier from each node to those above it."""
    parent = {r.node_id: r.parent_id if isinstance(r.parent_id, str) else None for r in rows.itertuples()}
    pages = {r.node_id: (r.page_start, r.page_end) for r in rows.itertuples()}
    below: dict[str, list[str]] = {node: [] for node in parent}
    for node, up in parent.items():
        if up is not None:
            below[up].append(node)
    span = {node: end - start + 1 for node, (start, end) in pages.items()}
    residual = {}
    for node, children in below.items():
        left, reached = span[node], pages[node][0] - 1
        for start, end in sorted(pages[c] for c in children):
            left -= max(0, end - max(start - 1, reached))
            reached = max(reached, end)
        residual[node] = left
    order = [node for node, up in parent.items() if up is None]
    for node in order:  # grows while it is read: nodes come after those above them
        order += below[node]
    if len(order) < len(parent):
        raise ValueError("sections are their own parents")
    cost = {}
    for node in reversed(order):
        cost[node] = 1 + max(residual[node], *(cost[c] for c in below[node])) if below[node] else span[node]
    frontier = dict.fromkeys(parent, 0)
    for node in order:
        steps, at, own = 0, node, residual[node] + 1 if below[node] else span[node]
        while at is not None:
            frontier[at] = max(frontier[at], steps + own)
            steps, at = steps + 1, parent[at]
    return pd.DataFrame({"doc": rows["doc"].iloc[0], "node_id": order, **{name: [found[n] for n in order] for name, found in (("span", span), ("residual", residual), ("cost", cost), ("frontier", frontier))}})


def costs(nodes: DataFrame) -> DataFrame:
    """doc, node_id, span, residual, cost and frontier of each node (doc, node_id, parent_id, page_start, page_end).

    The span is the node's pages. The residual is the pages that no child covers. A leaf costs its span; another node
    costs one step plus the larger of its residual and its children's costs. The frontier checks that: it is the most
    over the nodes of a subtree of their depth plus their span, if leaves, or plus one and their residual. One fold for
    each document, of any depth.
    """
    return nodes.select("doc", "node_id", "parent_id", "page_start", "page_end").groupBy("doc").applyInPandas(node_costs, "doc long, node_id string, span long, residual long, cost long, frontier long")


MERGED = "doc long, node_id string, parent_id string, title string, page_start int, page_end int, line_start long, line_end long, key_items array<string>"


class _Node:
    def __init__(self, row):
        self.title, self.pages, self.lines, self.keys, self.below = row.title, (row.page_start, row.page_end), [row.line_start, row.line_end], list(row.key_items if row.key_items is not None else []), []


def _preorder(nodes: list[_Node]) -> list[_Node]:
    """The nodes and all below them, each before its own, by a stack: trees may be deep."""
    out, left = [], nodes[::-1]
    while left:
        out.append(left.pop())
        left += out[-1].below[::-1]
    return out


def _label(titles: list[str], pages: tuple[int, int], most: int = 200) -> str:
    joined = "; ".join(t for t in titles if t)
    if joined and len(joined) <= most:
        return joined
    return f"p.{pages[0]}" if pages[0] == pages[1] else f"p.{pages[0]}-{pages[1]}"


def _join_equal(siblings: list[_Node]) -> list[_Node]:
    """Sibling leaves with the same pages become the first of them."""
    groups: dict[tuple[int, int], list[_Node]] = {}
    for node in siblings:
        if not node.below:
            groups.setdefault(node.pages, []).append(node)
    gone = set()
    for pages, group in groups.items():
        if len(group) > 1:
            titles = [t for node in group for t in (node.title, *node.keys)]
            first = group[0]
            first.title, first.keys = _label(titles, pages), titles
            first.lines = [min(n.lines[0] for n in group), max(n.lines[1] for n in group)]
            gone.update(map(id, group[1:]))
    return [n for n in siblings if id(n) not in gone]


def _collapse(roots: list[_Node]) -> None:
    """Fold each subtree that isn't cheaper to walk than to scan, bottom-up."""
    costs: dict[int, int] = {}
    for node in reversed(_preorder(roots)):
        span = costs[id(node)] = node.pages[1] - node.pages[0] + 1
        if not node.below:
            continue
        left, end = span, node.pages[0] - 1
        for start, stop in sorted(n.pages for n in node.below):
            left -= max(0, min(stop, node.pages[1]) - max(start, end + 1) + 1)
            end = max(end, stop)
        cost = 1 + max(left, *(costs[id(n)] for n in node.below))
        if span <= cost:
            node.keys += [t for n in _preorder(node.below) for t in (n.title, *n.keys)]
            node.below = []
        else:
            costs[id(node)] = cost


def merge_document(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the sections of one document until nothing changes."""
    made = {r.node_id: (_Node(r), r.parent_id) for r in rows.sort_values("node_id").itertuples()}
    roots = []
    for node, parent in made.values():
        (made[parent][0].below if parent in made else roots).append(node)
    while True:
        before = _preorder(roots)
        roots = _join_equal(roots)
        for node in before:
            node.below = _join_equal(node.below)
        _collapse(roots)
        if len(_preorder(roots)) == len(before):
            break
    out: list[tuple] = []
    left: list[tuple[_Node, str | None]] = [(node, None) for node in reversed(roots)]
    while left:
        node, parent = left.pop()
        name = f"{len(out):04d}"
        out.append((rows["doc"].iloc[0], name, parent, node.title, *node.pages, *node.lines, node.keys))
        left += [(n, name) for n in reversed(node.below)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])


def merged(nodes: DataFrame) -> DataFrame:
    """Documents' sections after merging; documents are independent of each other."""
    wanted = [c.split()[0] for c in MERGED.split(", ")]
    return nodes.select(*wanted).groupBy("doc").applyInPandas(merge_document, MERGED)


def html_headings(pages: DataFrame) -> DataFrame:
    """page_id, ord, level and title of the h1 to h6 elements of pages, with tags and entities of the title resolved."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<h([1-6])[^>]*>.*?</h\2>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "_h"))
    title = F.regexp_replace(F.regexp_replace("_h", "<[^>]*>", ""), r"\s+", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return rows.select("page_id", "ord", F.regexp_extract("_h", r"(?i)<h([1-6])", 1).cast("int").alias("level"), F.trim(title).alias("title"))
