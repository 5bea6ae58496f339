"""Outlines: Markdown headings, bookmarks and layout headings to sections."""

from __future__ import annotations

import random

import pytest

from folioscan.operators import outline, tree

MARKS = "doc long, ord int, title string, level int, page int"


def plain_sections(spark, texts):
    docs = spark.createDataFrame([(i, "doc", t) for i, t in enumerate(texts)], "doc long, title string, text string")
    rows = outline.built(docs, outline.whole_pages(docs), outline.document_headings(docs)).orderBy("doc", "ord").collect()
    return [[r for r in rows if r["doc"] == i] for i in range(len(texts))]


def paged(spark, texts, headings=(), bookmarks=(), title="doc"):
    pages = tree.page_spans(spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(texts)], "doc long, number int, text string"))
    layout = spark.createDataFrame([(0, i, t, level, page, line) for i, (t, level, page, line) in enumerate(headings)], MARKS + ", line int")
    marks = outline.admitted(spark.createDataFrame([(0, i, *b) for i, b in enumerate(bookmarks)], MARKS), pages)
    merged = outline.merged(outline.layout_lines(layout, pages), outline.framed(marks, pages))
    docs = spark.createDataFrame([(0, title)], "doc long, title string")
    return outline.built(docs, pages, merged).orderBy("ord").collect(), marks.orderBy("ord").collect()


def covered(nodes, total):
    by_id = {n["node_id"]: n for n in nodes}
    for line in range(1, total + 1):
        assert any(n["parent_id"] is None and n["line_start"] <= line <= n["line_end"] for n in nodes), line
    for n in nodes:
        assert 1 <= n["line_start"] <= n["line_end"] <= total
        if up := by_id.get(n["parent_id"]):
            assert up["line_start"] <= n["line_start"] and up["line_end"] >= n["line_end"] and up["level"] < n["level"]


def test_markdown_sections(spark):
    texts = [
        "intro\r\n# First\r\nbody\r\n## Child\r\nchild body\r\n# Last\r\nend\r\n",
        "---\nname: example\n# metadata\n---\n```md\n# code\n```\n> # quoted\n\n标题 **示例**\n======\nbody\n\n小节\n----\nend",
        "",
        "one\n二\n",
    ]
    first, second, empty, bare = plain_sections(spark, texts)
    assert [(n["node_id"], n["parent_id"], n["line_start"], n["line_end"]) for n in first] == [("0000", None, 1, 1), ("0001", None, 2, 5), ("0002", "0001", 4, 5), ("0003", None, 6, 7)]
    assert [(n["title"], n["line_start"]) for n in second] == [("Preface", 1), ("标题 示例", 10), ("小节", 14)] and second[2]["parent_id"] == "0001"
    assert not empty and [(n["title"], n["line_end"]) for n in bare] == [("doc", 2)]
    for nodes, text in zip((first, second, bare), (texts[0], texts[1], texts[3]), strict=True):
        covered(nodes, len(text.splitlines()))


def test_markdown_blocks():
    cases = {
        "# A\n- # item\n\n  # in the item\n\nafter\n# B": [(1, 1, "A"), (7, 1, "B")],
        "1. one\n   # in it\n# C": [(3, 1, "C")],
        "    # indented code\n# D #": [(2, 1, "D")],
        "para\n- - -\n# E\n***\ntext\n---": [(3, 1, "E"), (5, 2, "text")],
        "~~~\n# no\n```\n# no\n~~~\n# F": [(6, 1, "F")],
        "#no\n#\n## \n###### six\n####### seven": [(4, 6, "six")],
        "> quote\nlazy\n===\n# G": [(4, 1, "G")],
        "para\n2. not a list\n# H": [(3, 1, "H")],
    }
    for text, expected in cases.items():
        assert outline.markdown_headings(text) == expected, text


def test_titles_lose_their_marks():
    cases = {
        "a **b** _c_ `d*e*`": "a b c d*e*", "[link](http://x.y/(z)) ![alt](i.png)": "link alt", r"1\. \*x\*": "1. *x*", "AT&amp;T &lt;b&gt;": "AT&T <b>", "<i>x</i> <https://a.b>": "x https://a.b",
        "snake_case_name": "snake_case_name", "***both*** 2 * 3": "both 2 * 3", "`` a`b ``": "a`b",
    }
    for title, expected in cases.items():
        assert outline.inline_text(title) == expected


def test_blank_pages_and_sections_of_one_page(spark):
    nodes, _ = paged(spark, ["Overview\nbody\nDetail\nmore", "", "Conclusion\nfinal"], [("Overview", 1, 1, 1), ("Detail", 2, 1, 3), ("Conclusion", 1, 3, 1)])
    assert [(n["title"], n["line_start"], n["line_end"], n["page_start"], n["page_end"]) for n in nodes] == [("Overview", 1, 5, 1, 2), ("Detail", 3, 5, 1, 2), ("Conclusion", 6, 7, 3, 3)]
    covered(nodes, 7)


def test_bookmarks_without_a_line_share_their_page(spark):
    nodes, marks = paged(spark, ["body\ntext"] * 3, bookmarks=[("Introduction", 1, 1), ("Conclusion", 1, 3), ("Backward", 2, 2), ("Page 3", 1, 3)])
    assert [m["accepted"] for m in marks] == [True, True, False, False]
    assert [(n["title"], n["page_start"], n["page_end"], n["line_end"]) for n in nodes] == [("Introduction", 1, 3, 6), ("Conclusion", 3, 3, 6)]
    covered(nodes, 6)


def test_levels_of_bookmarks_have_no_gaps(spark):
    marks = [("A", 3, 1), ("B", 7, 1), ("", 1, 1), ("C", 9, 1), ("no level", 0, 1), ("D", 7, 2), ("beyond", 1, 3), ("E", 1, 2), ("12", 1, 2)]
    _, rows = paged(spark, ["x", "y"], bookmarks=marks)
    assert [r["level"] for r in rows] == [1, 2, None, 3, None, 2, None, 1, None]


def test_layout_headings_go_under_bookmarks(spark):
    nodes, _ = paged(spark, ["Part One\nbody", "Section\ntext\nSection\nmore"], [("part one", 1, 1, 1), ("Section", 1, 2, 1), ("Section", 1, 2, 1), ("Section", 1, 2, 3)], [("Part One", 1, 1)])
    assert [(n["title"], n["level"], n["parent_id"], n["line_start"]) for n in nodes] == [("Part One", 1, None, 1), ("Section", 2, "0000", 3), ("Section", 2, "0000", 5)]


def test_documents_without_headings_have_their_pages(spark):
    nodes, _ = paged(spark, ["a", "b\nc"])
    assert [(n["title"], n["line_start"], n["line_end"], n["page_end"]) for n in nodes] == [("Page 1", 1, 1, 1), ("Page 2", 2, 3, 2)]
    assert [n["title"] for n in paged(spark, ["a"], title="alone")[0]] == ["alone"]


def test_places_outside_of_pages_are_errors(spark):
    for heading in (("Oops", 1, 1, 2), ("Oops", 1, 2, 1), ("Oops", 0, 1, 1)):
        with pytest.raises(Exception, match="place"):
            paged(spark, ["text"], [heading])


def test_titles_on_pages():
    assert outline.place_on_page("body\n数据 处理\n流水线\nend", "数据处理流水线") == 2
    assert outline.place_on_page("unrelated body", "absent") is None and outline.place_on_page("x", "...") is None
    assert outline.place_on_page("before\nA *heading*\n", "A heading") == 2
    assert outline.place_on_page("A\nA\nB", "AB") == 2


def test_one_pass_equals_whole_sets(spark):
    """Against a definition without a stack: the latest lower level above, the next that isn't below."""
    rng = random.Random(8)
    rows = [(d, 2 * i + 1 + rng.randint(0, 1), rng.randint(1, 5), f"t{i}") for d in range(20) for i in range(rng.randint(1, 60))]
    heads = spark.createDataFrame(rows, "doc long, line long, level int, title string")
    ends = spark.createDataFrame([(d, 500) for d in range(20)], "doc long, last_line long")
    got = {(r["doc"], r["ord"]): (r["parent_id"], r["line_start"], r["line_end"]) for r in tree.sections(heads, ends).collect()}
    for d in range(20):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2], r[3]))
        for i, (_, line, level, _) in enumerate(own):
            up = next((j for j in reversed(range(i)) if own[j][2] < level), None)
            below = next((own[j][1] - 1 for j in range(i + 1, len(own)) if own[j][2] <= level), 500)
            assert got[d, i] == (None if up is None else f"{up:04d}", line, max(below, line))
