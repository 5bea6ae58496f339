"""Outlines of documents: bookmarks and headings become sections by one pass with a stack over each document.

A document's pages, bookmarks and headings are gathered to one row each; a document's outline is bounded by the document.
What needs the pages' texts, finding a title on its page, is done page by page before that.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import normalized

#: Lines over which a title may be broken, words that with a number only tell a page.
BROKEN, PAGE_WORDS = 8, ("page", "slide", "folie", "documentpage")

_SIGNS = regex.compile(r"[^\p{Alphabetic}\p{N}]")
_GENERIC = regex.compile(rf"(?:(?:{'|'.join(PAGE_WORDS)})\p{{N}}+|\p{{N}}*)")

NODE = "ord int, node_id string, parent_id string, title string, level int, line_start long, line_end long, page_start int, page_end int"


def plain(title: str) -> str:
    """normalized() of a constant."""
    return _SIGNS.sub("", title).lower()


def generic(title: str) -> bool:
    """Whether a bookmark's title only numbers a page."""
    return _GENERIC.fullmatch(plain(title)) is not None


def by_document(rows: DataFrame, fold: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """doc and what fold makes of a document's row, a dict of its columns."""
    kind = rows.schema["doc"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]
    made = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    struct = pa.list_(pa.struct([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(names, row, strict=True)) for row in fold(document)] for document in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(out, struct)], ["doc", "_out"])

    found = rows.mapInArrow(run, f"doc {kind}, _out array<struct<{made.replace(': long', ': bigint')}>>")
    return found.select("doc", F.inline("_out"))


def gathered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """doc and an array of its rows, in order."""
    columns = [c for c in rows.columns if c != "doc"]
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))


def _admit(document: dict) -> list[tuple]:
    """Bookmarks in order: those that don't go back and whose page is there are accepted, and only these move the page and the stack of levels."""
    out, page, levels = [], 0, []
    for b in document["bookmarks"]:
        number, level, title = b["page"] or 0, b["level"] or 0, b["title"] or ""
        if not page <= number <= document["n_pages"] or number < 1 or level < 1 or not title.strip() or generic(title):
            out.append((b["ord"], title.strip(), None, number, False))
            continue
        page = number
        while levels and levels[-1] >= level:
            levels.pop()
        levels.append(level)
        out.append((b["ord"], title.strip(), len(levels), number, True))
    return out


def admitted(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, ord, title, level (from 1, without gaps), page and accepted of each bookmark (doc, ord, title, level, page)."""
    counts = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"))
    rows = gathered(bookmarks, "bookmarks", ["ord"]).join(counts, "doc", "left").fillna(0, ["n_pages"])
    return by_document(rows, _admit, "ord int, title string, level int, page int, accepted boolean")


def place_on_page(text: str, title: str) -> int | None:
    """The first line of a page at which a title stands, perhaps broken over some lines. Letters and digits are compared."""
    target = plain(title)
    lines = [plain(line) for line in text.split("\n")] if target else []
    for at, line in enumerate(lines):
        if line and target.startswith(line):
            joined = ""
            for part in lines[at : at + BROKEN]:
                joined += part
                if joined == target:
                    return at + 1
                if not target.startswith(joined):
                    break
    return None


def framed(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, ord, title, level, page, line and page_boundary of the accepted ones of admitted() bookmarks: at their title's line, else at the page's first.

    pages: doc, number, text, line_start.
    """

    @F.pandas_udf("int")
    def place(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([place_on_page(a, b) for a, b in zip(texts, titles, strict=True)], dtype="Int32")

    rows = bookmarks.filter("accepted").join(pages.select("doc", F.col("number").alias("page"), "text", "line_start"), ["doc", "page"])
    found = rows.withColumn("_at", place("text", "title"))
    return found.select("doc", "ord", "title", "level", "page", (F.col("line_start") + F.coalesce("_at", F.lit(1)) - 1).cast("long").alias("line"), F.col("_at").isNull().alias("page_boundary"))


def layout_lines(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, ord, title, level, page and line of headings that a layout tells (doc, ord, title, level, page, line on the page).

    Places outside of the pages are an error; blank titles are left out. pages: doc, number, line_start, line_end.
    """
    spans = pages.select("doc", F.col("number").alias("page"), "line_start", "line_end")
    rows = headings.join(spans, ["doc", "page"], "left")
    there = F.coalesce((F.col("level") > 0) & (F.col("line") > 0) & (F.col("line") <= F.col("line_end") - F.col("line_start") + 1), F.lit(False))
    line = F.when(there, F.col("line_start") + F.col("line") - 1).otherwise(F.raise_error(F.concat(F.lit("a heading's place isn't in its document, page "), F.col("page").cast("string"))).cast("long"))
    rows = rows.withColumn("line", line.cast("long"))
    return rows.withColumn("title", F.trim("title")).filter("title <> '' AND line IS NOT NULL").select("doc", "ord", "title", "level", "page", "line")


def _merge(document: dict) -> list[tuple]:
    """Layout headings that no bookmark of their page repeats go under the latest bookmark; adjacent repeats are dropped."""
    frames = sorted(document["frames"] or [], key=lambda f: (f["line"], f["level"]))
    titles, out, active = {(f["page"], f["_key"]) for f in frames}, [(f["line"], f["level"], f["title"], f["page"], f["page_boundary"], f["_key"]) for f in frames], -1
    for h in sorted(document["layout"] or [], key=lambda h: h["line"]):
        while active + 1 < len(frames) and frames[active + 1]["line"] <= h["line"]:
            active += 1
        if (h["page"], h["_key"]) not in titles:
            out.append((h["line"], h["level"] + (frames[active]["level"] if active >= 0 else 0), h["title"], h["page"], False, h["_key"]))
    out.sort(key=lambda c: c[:2])
    kept = [c for i, c in enumerate(out) if not i or (c[0], c[1], c[5]) != (out[i - 1][0], out[i - 1][1], out[i - 1][5])]
    return [(i, *c[:5]) for i, c in enumerate(kept)]


def merged(layout: DataFrame, frames: DataFrame) -> DataFrame:
    """doc, ord, line, level, title, page and page_boundary of all headings: layout_lines() within framed() bookmarks."""
    key = normalized(F.col("title")).alias("_key")
    a, b = (gathered(rows.select("*", key), name, ["ord"]) for rows, name in ((layout, "layout"), (frames, "frames")))
    return by_document(a.join(b, "doc", "full"), _merge, "ord int, line long, level int, title string, page int, page_boundary boolean")


def _build(document: dict) -> list[tuple]:
    """Sections of a document by one pass with a stack. Each heading closes those that aren't above it."""
    pages, headings = document["pages"] or [], document["headings"] or []
    if not pages:
        return []
    if not headings:
        alone = len(pages) == 1
        return [(i, f"{i:04d}", None, document["title"] if alone else f"Page {p['number']}", 1, p["line_start"], p["line_end"], p["number"], p["number"]) for i, p in enumerate(pages)]
    ends = {p["number"]: p["line_end"] for p in pages}
    level, start, end, parent, title, page = [], [], [], [], [], []

    def add(*row: object) -> None:
        for column, value in zip((level, start, end, parent, title, page), row, strict=True):
            column.append(value)

    if headings[0]["line"] > 1:
        add(1, 1, headings[0]["line"] - 1, None, "Preface", 1)
    stack: list[int] = []
    for h in headings:
        last = ends[h["page"]] if h["page_boundary"] else h["line"] - 1
        while stack and level[stack[-1]] >= h["level"]:
            at = stack.pop()
            end[at] = max(last, start[at])
        add(h["level"], h["line"], pages[-1]["line_end"], stack[-1] if stack else None, h["title"], h["page"])
        stack.append(len(level) - 1)
    out, at = [()] * len(level), len(pages) - 1
    for i in reversed(range(len(level))):
        if parent[i] is not None:  # a section spans all below it, shared boundary pages included
            end[parent[i]] = max(end[parent[i]], end[i])
    places = sorted(range(len(level)), key=lambda i: -end[i])
    for i in places:
        while at > 0 and pages[at]["line_start"] > end[i]:
            at -= 1
        out[i] = (i, f"{i:04d}", None if parent[i] is None else f"{parent[i]:04d}", title[i], level[i], start[i], end[i], page[i], pages[at]["number"])
    return out


def built(documents: DataFrame, pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Sections (doc and NODE) of documents (doc, title), from pages (doc, number, line_start, line_end) and headings (doc, ord, line, level, title, page, page_boundary).

    What comes before the first heading is a Preface. A document without headings has a section for each page, one
    without pages none. A heading that is only known to be on a page ends the sections before it with that page.
    """
    spans = gathered(pages.select("doc", "number", "line_start", "line_end"), "pages", ["number"])
    rows = documents.select("doc", "title").join(spans, "doc").join(gathered(headings, "headings", ["ord"]), "doc", "left")
    return by_document(rows, _build, NODE)


#: Inline marks of Markdown, in the order in which they are taken off.
_INLINE = (
    (re.compile(r"!?\[([^\]\[]*)\]\((?:[^()\\]|\\.|\([^()]*\))*\)"), r"\1"),
    (re.compile(r"<((?:https?|ftp|mailto):[^<>\s]*)>"), r"\1"),
    (re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->"), ""),
    (re.compile(r"(?<![\\*])(\*{1,3})(?=\S)(.+?)(?<=[^\s\\])\1(?!\*)"), r"\2"),
    (re.compile(r"(?<![\\\w])(_{1,3})(?=\S)(.+?)(?<=[^\s\\])\1(?!\w)"), r"\2"),
)
_CODE = re.compile(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def inline_text(title: str) -> str:
    """A title's text: emphasis, links, tags, code marks, escapes and entities resolved. What is in code stays as it is."""
    parts, at = [], 0
    for m in _CODE.finditer(title):
        parts += [(False, title[at : m.start()]), (True, m[2][1:-1] if m[2].startswith(" ") and m[2].endswith(" ") and m[2].strip() else m[2])]
        at = m.end()
    parts.append((False, title[at:]))
    held = [text for code, text in parts if code]
    # Code stands as one character from the private area, so that marks around it are found.
    text = "".join("\ue000" if code else part.replace("\ue000", "") for code, part in parts)
    for pattern, by in _INLINE:
        text, before = pattern.sub(by, text), None
        while pattern.groups and text != before:
            text, before = pattern.sub(by, text), text
    text = html.unescape(_ESCAPED.sub(r"\1", text))
    for code in held:
        text = text.replace("\ue000", code, 1)
    return text.strip()


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(?P<info>.*)")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])( {1,4}(?=\S)|[ \t]*$)")


def markdown_headings(text: str) -> list[tuple[int, int, str]]:
    """(line, level, title) of a text's headings at its top level: not in code, front matter, quotes or lists.

    Lines end at line feeds. A list lasts over blank lines as long as what follows is indented as its items are.
    """
    found, lines, first = [], text.replace("\r\n", "\n").split("\n"), 0
    if lines[0].rstrip() in ("---", "+++"):
        mark = lines[0].rstrip()
        first = next((i + 1 for i in range(1, len(lines)) if lines[i].rstrip() == mark), 0)
    fence, run, indent, blank, quoted = None, [], 0, False, False
    for i in range(first, len(lines)):
        line = lines[i].expandtabs(4)
        width = len(line) - len(line.lstrip(" "))
        if fence:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}} *", line):
                fence = None
            continue
        if not line.strip():
            run, blank, quoted = [], True, False
            continue
        if indent and width >= indent:  # inside a list's item
            run, blank = [], False
            continue
        if indent and not blank and not (_ATX.fullmatch(line) or _FENCE.match(line) or _RULE.fullmatch(line) or _ITEM.match(line) or line.lstrip().startswith(">")):
            continue  # a paragraph of an item goes on
        item = None if _RULE.fullmatch(line) or (run and _SETEXT.fullmatch(line)) else _ITEM.match(line)
        if item and not (run and (not line[item.end() :].strip() or item[2][:-1] not in ("", "1"))):
            indent, run, blank = item.end() if line[item.end() :].strip() else len(item[1]) + len(item[2]) + 1, [], False
            continue
        indent, blank = 0, False
        if width <= 3 and line.lstrip().startswith(">"):
            run, quoted = [], True
        elif (m := _FENCE.fullmatch(line)) and not (m[1][0] == "`" and "`" in m["info"]):
            fence, run, quoted = m[1], [], False
        elif m := _ATX.fullmatch(line):
            title = (m[2] or "").strip()
            if title := inline_text("" if set(title) == {"#"} else title):
                found.append((i + 1, len(m[1]), title))
            run, quoted = [], False
        elif run and _SETEXT.fullmatch(line):
            if title := inline_text(" ".join(t for _, t in run)):
                found.append((run[0][0], 1 if "=" in line else 2, title))
            run = []
        elif _RULE.fullmatch(line):
            run, quoted = [], False
        elif (width <= 3 or run) and not quoted:
            run.append((i + 1, line.strip()))
    return found


def document_headings(documents: DataFrame) -> DataFrame:
    """doc, ord, line, level, title, page and page_boundary of the headings of Markdown documents (doc, text), for built()."""

    @F.pandas_udf("array<struct<line: bigint, level: int, title: string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": a, "level": b, "title": c} for a, b, c in markdown_headings(t or "")])

    rows = documents.select("doc", F.posexplode(parse("text")).alias("ord", "h"))
    return rows.select("doc", "ord", "h.*", F.lit(1).alias("page"), F.lit(False).alias("page_boundary"))


def whole_pages(documents: DataFrame) -> DataFrame:
    """The one page of each plain-text document (doc, text) that isn't empty."""
    n = F.size(F.split("text", "\n")) - F.col("text").endswith("\n").cast("int")
    return documents.filter("text <> ''").select("doc", F.lit(1).alias("number"), F.lit(1).cast("long").alias("line_start"), F.greatest(n, F.lit(1)).cast("long").alias("line_end"))


def section_rows(headings: DataFrame, ends: DataFrame) -> DataFrame:
    """Sections of headings (doc, line, level, title) that need no pages, given each document's last line (doc, last_line)."""
    lists = gathered(headings.select("doc", "line", "level", "title"), "h", ["line", "level", "title"]).join(ends.select("doc", "last_line"), "doc")

    def fold(document: dict) -> list[tuple]:
        rows, last = document["h"], document["last_line"]
        pages = [{"number": 1, "line_start": 1, "line_end": last}]
        # Nothing comes before the first heading here: its line is where the document's text begins.
        found = _build({"pages": pages, "headings": [{"line": 1, "level": 0, "title": "", "page": 1, "page_boundary": False}, *({**r, "page": 1, "page_boundary": False} for r in rows)], "title": ""})
        up = [None if n[2] in (None, "0000") else f"{int(n[2]) - 1:04d}" for n in found]
        return [(n[0] - 1, f"{n[0] - 1:04d}", p, n[3], n[4], n[5], n[6]) for n, p in zip(found[1:], up[1:], strict=True)]

    return by_document(lists, fold, "ord int, node_id string, parent_id string, title string, level int, line_start long, line_end long")


def rejected(bookmarks: DataFrame) -> DataFrame:
    """doc and how many of its admitted() bookmarks were accepted, and rejected."""
    taken = F.col("accepted")
    return bookmarks.groupBy("doc").agg(F.count(F.when(taken, 1)).alias("accepted"), F.count(F.when(~taken, 1)).alias("rejected"))


def _nest(document: dict) -> list[tuple]:
    """A document's tree as JSON, from the last section up: each is written once, when all below it are."""
    below: dict[str | None, list[str]] = {}
    depth: dict[str | None, int] = {None: 0}
    for n in document["nodes"]:
        depth[n["node_id"]] = depth[n["parent_id"]] + 1
    for n in reversed(document["nodes"]):
        own = {"title": n["title"], "node_id": n["node_id"], "start_index": n["page_start"], "end_index": n["page_end"]}
        text = json.dumps(own, ensure_ascii=False, separators=(",", ":"))
        if nodes := below.pop(n["node_id"], None):
            text = f'{text[:-1]},"nodes":[{",".join(reversed(nodes))}]}}'
        below.setdefault(n["parent_id"], []).append(text)
    return [(f'[{",".join(reversed(below.get(None, [])))}]', len(document["nodes"]), max(depth.values()))]


def nested(nodes: DataFrame) -> DataFrame:
    """doc, tree (JSON: each section with those below it), nodes and depth of sections in preorder (doc, ord, node_id, parent_id, title, page_start, page_end)."""
    rows = gathered(nodes.select("doc", "ord", "node_id", "parent_id", "title", "page_start", "page_end"), "nodes", ["ord"])
    return by_document(rows, _nest, "tree string, nodes int, depth int")
