"""Search hits with exact coordinates: matches, the windows around them, snippets in a byte budget, sections and pages.

A document is one row with its lines as an array. Matches are places in it, windows are slices of it, and a window is
scored where it is cut: no line becomes a row, and nothing is shuffled until a section's best window is chosen, by a
narrow row for each match. Texts are cut again for the hits that stay, a bounded number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import patterns
from folioscan.functions.text import byte_clip, byte_column, citation, lexical_score, literal_anchor, pattern, token_list
from folioscan.operators.lines import line_starts, raw_lines

#: The window of a lexical match, bytes of a hit's text, and room that a match needs before the text ends.
BEFORE, AFTER, MOST_BYTES, MODEL_BYTES, ROOM = 4, 12, 4096, 1400, 64


def contains_any(line: Column, terms: list[str]) -> Column:
    low, found = F.lower(line), F.lit(False)
    for term in terms:
        found = found | F.contains(low, F.lit(term))
    return found


def with_lines(documents: DataFrame) -> DataFrame:
    """Add _lines (without line feeds), _starts (their first bytes), _bytes and _closed (whether the text ends with a line feed)."""
    return documents.withColumns({"_lines": raw_lines(F.col("text")), "_starts": line_starts("text"), "_bytes": F.octet_length("text").cast("long"), "_closed": F.col("text").endswith("\n")})


def content(line: Column, ended: Column) -> Column:
    """A line without the carriage return of its end, if it has one."""
    return F.when(ended & F.endswith(line, F.lit("\r")), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def line_at(number: Column) -> Column:
    return content(F.element_at("_lines", number), (number < F.size("_lines")) | F.col("_closed"))


def window_text(first: Column, last: Column) -> Column:
    """The text from a line's first byte to another's last."""
    return content(F.array_join(F.slice("_lines", first, last - first + 1), "\n"), (last < F.size("_lines")) | F.col("_closed"))


def bounded(window: Column, line: Column, match: Column, most: int) -> tuple[Column, Column]:
    """How many bytes of a window are left out before its snippet, and the snippet: at most `most` bytes, whole characters, no closing line ends.

    line and match are the bytes in the window at which the matched line and the match begin. A snippet begins with the
    window unless the match would then be at its end or beyond; it then begins a quarter of its size before the match,
    and not before the line.
    """
    raw = F.encode(window, "utf-8")
    start = F.when(match >= max(most - ROOM, 0), F.greatest(match - most // 4, line)).otherwise(F.lit(0)).cast("int")
    inside = [F.hex(F.substr(raw, start + 1 + k, F.lit(1))).rlike("^[89AB]") for k in range(3)]  # bytes that continue a character
    skip = start + F.when(~inside[0], 0).when(~inside[1], 1).when(~inside[2], 2).otherwise(3)
    cut = F.when((start == 0) & (F.octet_length(raw) <= most), window).otherwise(byte_clip(F.substr(raw, skip + 1, F.lit(2**31 - 1)).cast("string"), most))
    return F.when(start == 0, F.lit(0)).otherwise(skip), F.regexp_replace(cut, r"(\r?\n)+\z", "")


def owners(nodes: DataFrame) -> DataFrame:
    """doc, _nodes (its sections in order) and _owner (for each line the number of its deepest section, of equally deep ones the shortest, then the last)."""

    @F.pandas_udf("array<int>")
    def paint(sections: pd.Series) -> pd.Series:
        def one(rows: list) -> np.ndarray:
            out = np.zeros(max(r["line_end"] for r in rows), np.int32)
            for i in sorted(range(len(rows)), key=lambda i: (rows[i]["level"], rows[i]["line_start"] - rows[i]["line_end"], i)):
                out[rows[i]["line_start"] - 1 : rows[i]["line_end"]] = i + 1
            return out

        return sections.map(one)

    columns = ["ord", "node_id", "title", "level", "line_start", "line_end", "page_start", "page_end"]
    lists = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_nodes"))
    return lists.withColumn("_owner", paint("_nodes"))


def section_of(line: Column) -> Column:
    """The section of a line; one that no section has is an error."""
    number = F.try_element_at("_owner", line.cast("int"))
    return F.when(number > 0, F.element_at("_nodes", number)).otherwise(F.raise_error(F.lit("the sections don't cover a matched line")))


def _matches(rows: DataFrame, regex: str, hit: Column | None, terms: list[str]) -> Column:
    """Numbers of the lines that match."""
    ended = lambda i: (i + 1 < F.size("_lines")) | F.col("_closed")
    test = (lambda x, i: contains_any(x, terms)) if terms else (lambda x, i: content(x, ended(i)).rlike(regex))
    return F.array_compact(F.transform("_lines", lambda x, i: F.when(test(x, i), i + 1)))


def best_windows(rows: DataFrame, query: str, most: int | None = None, whole: bool = False) -> DataFrame:
    """doc_key, path, match_line, first, last, score and literal_anchor of each line that has one of the query's terms, with its section as `node`.

    rows have with_lines() and owners(); `whole`: a document is one section, and these aren't needed. The window ends at
    the section's bounds. It is scored as it will be shown: in `most` bytes, or whole.
    """
    terms = token_list(query)
    regex = patterns.java("|".join(map(patterns.escape, terms)), True)
    found = F.transform(_matches(rows, "", None, terms), lambda m: F.struct(m.alias("m"), *([] if whole else [section_of(m).alias("n")])))
    low = lambda s: F.greatest(s["m"] - BEFORE, F.lit(1) if whole else s["n"]["line_start"]).cast("int")
    high = lambda s: F.least(s["m"] + AFTER, F.size("_lines") if whole else s["n"]["line_end"]).cast("int")
    keep = lambda s: [s["m"].alias("m"), *([] if whole else [s["n"].alias("n")])]
    found = F.transform(found, lambda s: F.struct(*keep(s), low(s).alias("a"), high(s).alias("z")))
    found = F.transform(found, lambda s: F.struct(*keep(s), s["a"].alias("a"), s["z"].alias("z"), window_text(s["a"], s["z"]).alias("t")))
    if most is not None:
        at = lambda s: (F.element_at("_starts", s["m"]) - F.element_at("_starts", s["a"])).alias("l")
        shown = lambda s: F.when(F.octet_length(s["t"]) <= most - ROOM, s["t"]).otherwise(bounded(s["t"], s["l"], s["l"] + byte_column(line_at(s["m"]), regex) - 1, most)[1])
        found = F.transform(found, lambda s: F.struct(*keep(s), s["a"].alias("a"), s["z"].alias("z"), s["t"].alias("t"), at(s)))
        found = F.transform(found, lambda s: F.struct(*keep(s), s["a"].alias("a"), s["z"].alias("z"), shown(s).alias("t")))
    found = F.transform(found, lambda s: F.struct(*keep(s), s["a"].alias("a"), s["z"].alias("z"), F.lower(s["t"]).alias("t")))
    found = F.transform(found, lambda s: F.struct(*keep(s), s["a"].alias("a"), s["z"].alias("z"), lexical_score(s["t"], terms).alias("score"), literal_anchor(line_at(s["m"]), query).alias("literal_anchor")))
    out = rows.select("doc_key", "path", F.explode(found).alias("h"))
    columns = [F.col("h.m").cast("int").alias("match_line"), F.col("h.a").alias("first"), F.col("h.z").alias("last"), F.col("h.score").alias("score"), F.col("h.literal_anchor").alias("literal_anchor")]
    return out.select("doc_key", "path", *columns, *([] if whole else [F.col("h.n").alias("node")]))


def strongest(windows: DataFrame, *section: str) -> DataFrame:
    """The best window of each section; of equal ones the first."""
    rest = [c for c in windows.columns if c not in section]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col("match_line")))
    return windows.groupBy(*section).agg(best.alias("_b")).select(*section, "_b.*")


def shown(chosen: DataFrame, rows: DataFrame, regex: str, most: int, spans: DataFrame | None = None) -> DataFrame:
    """Hits of chosen matches (doc_key, match_line, first, last, node, score, literal_anchor; few): snippet, bytes, lines, columns, pages and what of the section it leaves unread.

    rows have with_lines(); spans (doc, number, line_start, line_end) are the pages of paginated documents.
    """
    hits = rows.join(F.broadcast(chosen.drop("path")), "doc_key")  # at most a result's limit
    line = F.element_at("_starts", F.col("match_line"))
    hits = hits.withColumns({"_from": F.element_at("_starts", F.col("first")), "_column": byte_column(line_at(F.col("match_line")), regex)})
    hits = hits.withColumn("_window", window_text(F.col("first"), F.col("last")))
    skip, text = bounded(F.col("_window"), line - F.col("_from"), line - F.col("_from") + F.col("_column") - 1, most)
    hits = hits.withColumns({"text": text, "byte_start": (F.col("_from") + skip).cast("long")}).withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))
    truncated = (F.col("byte_start") > F.col("_from")) | (F.col("byte_end") < F.col("_from") + F.octet_length("_window"))
    n_a = F.element_at("_starts", F.col("node.line_start").cast("int"))
    n_z = F.coalesce(F.try_element_at("_starts", (F.col("node.line_end") + 1).cast("int")), F.col("_bytes"))
    hits = hits.withColumns({"text_truncated": truncated, "_na": n_a, "_nz": n_z})
    at_end = (F.col("byte_start") == F.col("byte_end")) & (F.col("byte_end") == F.col("_nz"))
    first = F.greatest(F.size(F.filter("_starts", lambda s: s <= F.col("byte_start"))), F.lit(1))
    last = F.greatest(F.size(F.filter("_starts", lambda s: s < F.col("byte_end"))), first)
    hits = hits.withColumns({"line_start": F.when(at_end, F.col("node.line_end")).otherwise(first).cast("long"), "line_end": F.when(at_end, F.col("node.line_end")).otherwise(last).cast("long")})
    inside = (F.col("_na") <= F.col("byte_start")) & (F.col("byte_end") <= F.col("_nz"))
    hits = hits.withColumns({
        "node_id": F.col("node.node_id"), "match_column": F.col("_column"), "column_start": F.col("byte_start") - F.element_at("_starts", F.col("line_start").cast("int")) + 1,
        "node_offset": F.when(inside, F.col("byte_start") - F.col("_na")), "next_offset": F.when(inside & (F.col("byte_end") < F.col("_nz")), F.col("byte_end") - F.col("_na")),
        "unread_before": F.when(inside, F.col("byte_start") - F.col("_na")), "unread_after": F.when(inside, F.col("_nz") - F.col("byte_end")),
    })
    hits = hits.withColumn("complete", (F.col("unread_before") == 0) & (F.col("unread_after") == 0))
    if spans is None:
        hits = hits.withColumns({"page_start": F.lit(1), "page_end": F.lit(1), "citation": citation(F.col("path"), F.col("line_start"), F.col("line_end"))})
    else:
        pages = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "number"))).alias("_pages")).withColumnRenamed("doc", "_doc")
        hits = hits.join(pages, F.col("doc_key") == F.col("_doc"), "left")
        page = lambda at, other: F.coalesce(F.try_element_at(F.filter("_pages", lambda p: (p["line_start"] <= F.col(at)) & (F.col(at) <= p["line_end"])), F.lit(1))["number"], F.col(other))
        hits = hits.withColumns({"page_start": page("line_start", "node.page_start"), "page_end": page("line_end", "node.page_end")})
        hits = hits.withColumn("citation", citation(F.col("path"), F.col("page_start"), F.col("page_end"), "p"))
    columns = "doc_key path node_id match_line match_column line_start line_end page_start page_end byte_start byte_end column_start node_offset next_offset complete unread_before unread_after text text_truncated score literal_anchor citation"
    return hits.select(*columns.split())


def prepared(documents: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Documents (doc_key, path, text) with lines and sections; without nodes a document is one section."""
    rows = with_lines(documents.filter("text <> ''").select("doc_key", "path", "text"))
    if nodes is not None:
        return rows.join(owners(nodes).withColumnRenamed("doc", "doc_key"), "doc_key")
    n = F.size("_lines")
    one = F.struct(F.lit(0).alias("ord"), F.lit("0000").alias("node_id"), F.col("path").alias("title"), F.lit(1).alias("level"), F.lit(1).cast("long").alias("line_start"), n.cast("long").alias("line_end"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return rows.withColumns({"_nodes": F.array(one), "_owner": F.array_repeat(F.lit(1), n)})


def lexical_hits(documents: DataFrame, query: str, limit: int, nodes: DataFrame | None = None, spans: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """The best window of each section that has one of the query's terms, the highest scores first, as hits."""
    terms = token_list(query)
    if not terms:
        raise ValueError("a lexical query needs a word")
    rows = prepared(documents, nodes).filter(contains_any(F.col("text"), terms))
    windows = best_windows(rows, query, most).withColumn("node_id", F.col("node.node_id"))
    chosen = strongest(windows, "doc_key", "node_id").drop("node_id").orderBy(F.desc("score"), "path", "first").limit(limit)
    found = shown(chosen, rows, patterns.java("|".join(map(patterns.escape, terms)), True), most, spans)
    return found.orderBy(F.desc("score"), "path", "line_start", "match_line")


def regex_hits(documents: DataFrame, query: str, limit: int, context: int = 0, literal: bool = False, ignore_case: bool = False, nodes: DataFrame | None = None, spans: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """The first lines that match, by document and line, with `context` lines around them, as hits of score 1."""
    regex = pattern(query, ignore_case, literal)
    rows = prepared(documents, nodes)
    found = F.transform(_matches(rows, regex, None, []), lambda m: F.struct(m.alias("m"), section_of(m).alias("n")))
    out = rows.select("doc_key", "path", F.size("_lines").alias("_n"), F.explode(found).alias("h"))
    chosen = out.select("doc_key", "path", F.col("h.m").alias("match_line"), F.greatest(F.col("h.m") - context, F.lit(1)).alias("first"), F.least(F.col("h.m") + context, F.col("_n")).alias("last"), F.lit(1.0).alias("score"), F.lit(False).alias("literal_anchor"), F.col("h.n").alias("node"))
    return shown(chosen.orderBy("doc_key", "match_line").limit(limit), rows, regex, most, spans).orderBy("doc_key", "match_line")


def lines_of_bytes(places: DataFrame, starts: DataFrame, *keys: str) -> DataFrame:
    """Add line_no to places (keys, byte): the line that has the byte, by the table of lines' first bytes (keys, line_no, byte_start).

    An as-of join by a window over both tables, lines first at equal bytes.
    """
    rest = [c for c in places.columns if c not in (*keys, "byte")]
    lines = starts.select(*keys, F.col("byte_start").alias("byte"), F.col("line_no").alias("_line"), *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in rest])
    both = lines.unionByName(places.withColumn("_line", F.lit(None).cast("int")))
    upto = Window.partitionBy(*keys).orderBy("byte", F.col("_line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line_no", F.last("_line", ignorenulls=True).over(upto)).filter("_line IS NULL").drop("_line")
