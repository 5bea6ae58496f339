"""Hits: snippets in a byte budget, exact bytes, lines, columns, sections and coverage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import hits, lines, outline
from folioscan.operators.search import Options
from folioscan.plans.search import located


def documents(spark, texts):
    return spark.createDataFrame([(f"k{i}", f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_key string, path string, text string")


def exact(hit, source):
    raw = source.encode()
    assert raw[hit["byte_start"] : hit["byte_end"]].decode() == hit["text"]
    before = raw[: hit["byte_start"]]
    assert hit["line_start"] == before.count(b"\n") + 1 and hit["column_start"] == len(before) - (before.rfind(b"\n") + 1) + 1


def test_snippets_keep_the_match(spark):
    source = "p" * 5000 + "\r\n" + "q" * 5000 + "\r\nneedle\r\n"
    hit = hits.regex_hits(documents(spark, [source]), "needle", 5, context=2).first()
    assert "needle" in hit["text"] and hit["line_start"] == hit["match_line"] == 3 and hit["text_truncated"]
    exact(hit, source)
    source = "文" * 5000 + "needle" + "后" * 1000 + "\n"
    hit = hits.regex_hits(documents(spark, [source]), "needle", 5).first()
    assert "needle" in hit["text"] and hit["column_start"] > 1 and hit["text_truncated"] and hit["match_column"] == 15001 and len(hit["text"].encode()) <= 4096
    exact(hit, source)
    source = "\r" * 5000
    hit = hits.regex_hits(documents(spark, [source]), r"\r{3}$", 5).first()
    assert hit["text"]
    exact(hit, source)


def snippet(raw, starts, ends, first, last, line, column, most):
    """The rule in plain Python: where a snippet begins and ends."""
    at, wanted = starts[first - 1], ends[last - 1]
    begin = at
    if starts[line - 1] + column >= at + max(most - 64, 0):
        begin = max(starts[line - 1] + column - most // 4, starts[line - 1])
        while begin < len(raw) and raw[begin] & 0xC0 == 0x80:
            begin += 1
    end = min(wanted, begin + most)
    while begin < end < wanted and raw[end] & 0xC0 == 0x80:
        end -= 1
    while raw[begin:end].endswith(b"\n"):
        end -= 2 if raw[begin:end].endswith(b"\r\n") else 1
    return begin, end, begin > at or end < wanted


def test_snippets_equal_a_plain_rule(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "é", "文", "🙂", "\n", "\r\n", "zq"], [8, 4, 4, 2, 3, 1, 1], k=rng.randint(0, 300))) for _ in range(40)]
    found = hits.regex_hits(documents(spark, texts), "zq", 1000, context=2, most=70).collect()
    assert len(found) > 50
    for hit in found:
        source = texts[int(hit["doc_key"][1:])]
        raw = source.encode()
        parts = raw.split(b"\n")
        closed = len(parts) > 1 and not parts[-1]
        parts = parts[:-1] if closed else parts
        starts = [sum(len(p) + 1 for p in parts[:i]) for i in range(len(parts))]
        ends = [s + len(p) - (p.endswith(b"\r") and (closed or i + 1 < len(parts))) for i, (s, p) in enumerate(zip(starts, parts, strict=True))]
        m = hit["match_line"]
        want = snippet(raw, starts, ends, max(m - 2, 1), min(m + 2, len(parts)), m, parts[m - 1].index(b"zq"), 70)
        assert (hit["byte_start"], hit["byte_end"], hit["text_truncated"]) == want
        exact(hit, source)


def test_sections_bound_windows(spark):
    text = "intro\n# A\nx\nalpha one\n" + "y\n" * 3 + "# B\nalpha\nbeta alpha\n"
    docs = documents(spark, [text])
    named = docs.select(F.col("doc_key").alias("doc"), F.col("path").alias("title"), "text")
    nodes = outline.built(named, outline.whole_pages(named), outline.document_headings(named))
    found = {h["node_id"]: h for h in hits.lexical_hits(docs, "alpha beta", 10, nodes).collect()}
    assert set(found) == {"0001", "0002"}
    assert found["0002"]["score"] == 1.0 and (found["0002"]["line_start"], found["0002"]["line_end"]) == (8, 10)
    assert (found["0001"]["line_start"], found["0001"]["line_end"], found["0001"]["score"]) == (2, 7, 0.5)
    for h in found.values():
        exact(h, text)
        assert h["node_offset"] == h["unread_before"] == 0 and h["unread_after"] == 1 and not h["complete"] and h["next_offset"] == h["byte_end"] - h["byte_start"]
    gap = nodes.filter("ord <> 1")
    with pytest.raises(Exception, match="cover"):
        hits.lexical_hits(docs, "alpha", 10, gap).collect()


def test_whole_sections_are_complete(spark):
    for ending in ("\n", "\r\n"):
        hit = hits.lexical_hits(documents(spark, [f"COPPER_OTTER stores 83 beads.{ending}"]), "COPPER_OTTER", 5).first()
        assert hit["complete"] is False and hit["unread_after"] == len(ending)
    hit = hits.lexical_hits(documents(spark, ["COPPER_OTTER stores 83 beads."]), "COPPER_OTTER", 5).first()
    assert hit["complete"] and hit["next_offset"] is None and hit["literal_anchor"] and hit["citation"] == "d/0.txt:L1-L1"


def test_lines_of_bytes(spark):
    docs = documents(spark, ["a\nbé\n\nc", ""])
    table = lines.lines(docs, "doc_key").select("doc_key", "line_no", "byte_start")
    places = docs.select("doc_key", F.explode(F.sequence(F.lit(0), F.octet_length("text"))).alias("byte")).withColumn("byte", F.col("byte").cast("long"))
    got = {(r["doc_key"], r["byte"]): r["line_no"] for r in hits.lines_of_bytes(places, table, "doc_key").collect()}
    for i, text in enumerate(("a\nbé\n\nc", "")):
        for b in range(len(text.encode()) + 1):
            assert got[f"k{i}", b] == text.encode()[:b].count(b"\n") + 1


def test_searches_leave_stale_documents_out(spark):
    docs = documents(spark, [f"line\nneedle {i}\n" for i in range(5)])
    recorded = docs.select("path", F.sha2("text", 256).alias("source_sha256"))
    calls = []

    def probe():
        """d/1 has changed before the search, d/3 is gone after it."""
        calls.append(1)
        now = recorded.withColumn("source_sha256", F.when(F.col("path") == "d/1.txt", "x").otherwise(F.col("source_sha256")))
        return now if len(calls) == 1 else now.filter("path <> 'd/3.txt'")

    for mode in ("regex", "lexical"):
        calls.clear()
        found = located(docs, "needle", Options(mode=mode, limit=3), recorded=recorded, probe=probe)
        assert [(h["path"], h["place"]) for h in found.hits.collect()] == [("d/0.txt", 1), ("d/2.txt", 2)]
        assert [r["path"] for r in found.stale.collect()] == ["d/1.txt", "d/3.txt"] and found.truncated
    found = located(docs, "needle 4", Options(mode="regex", limit=1))
    assert found.hits.count() == 1 and not found.truncated and found.stale.count() == 0
    with pytest.raises(ValueError):
        located(docs, "needle", Options(mode="hybrid"))
