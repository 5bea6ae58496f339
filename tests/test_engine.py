"""The evidence-search operators: coordinates, lanes, trees, accounting, generations and the streaming fold."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions.text import pattern, token_list, tokens
from folioscan.operators import accounting, evaluation, lines, results, rules, search, tree, trigram
from folioscan.plans.search import search as whole_search
from folioscan.sources import corpus, generations


def documents(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return corpus.described(rows, F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def test_lines_have_exact_bytes(spark):
    texts = ["a\nb\n", "", "é\r\nßü\rx", "\n\n", "one", "x\r", "\n".join(f"zeile ü {i}" for i in range(5000)) + "\n"]
    rows = lines.lines(documents(spark, texts), "doc_id").collect()
    for i, text in enumerate(texts):
        raw = text.encode()
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["line_no"])
        parts = text.split("\n")
        parts = parts[:-1] if len(parts) > 1 and not parts[-1] else parts
        assert len(own) == len(parts)
        for r in own:
            assert raw[r["byte_start"] : r["byte_end"]].decode() == r["line"]
            assert not raw[r["byte_end"] : r["byte_end"] + 2].startswith(b"\r\n") or not r["line"].endswith("\r")


def test_regex_dialect(spark):
    rows = spark.createDataFrame([("ÄBC",), ("a\r",), ("文",), ("K",), ("a+b",)], "line string")

    def hits(regex, **how):
        return {r["line"] for r in rows.filter(F.col("line").rlike(T.pattern(regex, **how))).collect()}

    assert hits("äbc", ignore_case=True) == {"ÄBC"}
    assert hits("^a$") == set() and hits("^a.$") == {"a\r"}
    assert hits(r"^\w$") == {"文", "K"} and hits("^k$", ignore_case=True) == {"K"}
    assert hits("a+b", literal=True) == {"a+b"}
    for bad in ("(?=a)", r"(a)\1", "(?<!a)b", "a++"):
        with pytest.raises(ValueError):
            T.pattern(bad)


def test_match_column_counts_bytes(spark):
    row = search.grep(documents(spark, ["xx\néé needle\n"]), "needle").first()
    assert (row["line_no"], row["match_column"], row["citation"]) == (2, 6, "d/0.txt:L2-L2")


def test_tokens_and_anchor(spark):
    row = spark.createDataFrame([("Naïve 杭州 ½ naïve_x API-api",)], "t string").select(T.tokens(F.col("t")).alias("k"), T.literal_anchor(F.col("t"), " api ").alias("a"), T.literal_anchor(F.col("t"), "ap").alias("b")).first()
    assert row["k"] == ["naïve", "杭州", "½", "naïve_x", "api"] and row["a"] and not row["b"]


def test_byte_clip(spark):
    rows = spark.createDataFrame([("文档x",), ("abcd",), ("",), ("é" * 9,)], "t string").select("t", T.byte_clip(F.col("t"), 4).alias("c")).collect()
    for r in rows:
        assert r["c"] == r["t"].encode()[:4].decode(errors="ignore")


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(2)
    docs = documents(spark, ["".join(rng.choices("abé\n", k=80)) for _ in range(60)] + [""])
    for literal in ("abéa", "aab", "ab", "ééé"):
        scan = search.grep(docs, literal, literal=True).select("doc_key", "line_no", "match_column")
        found = search.grep_indexed(docs, literal).select("doc_key", "line_no", "match_column")
        assert sorted(scan.collect()) == sorted(found.collect())


def test_index_on_disk(spark, tmp_path):
    docs = documents(spark, ["needle here", "nothing", "a needle"])
    trigram.write_index(docs, "doc_key", str(tmp_path / "index"))
    index = trigram.read_index(spark, str(tmp_path / "index"), "needle")
    assert trigram.candidates(index, docs, "doc_key", "needle").count() == 2


def test_best_window_wins_and_ties_take_the_first(spark):
    text = "\n".join(["alpha"] + ["-"] * 30 + ["alpha", "beta"] + ["-"] * 30 + ["alpha", "beta"])
    row = search.lexical(documents(spark, [text]), "alpha beta", 5).first()
    assert (row["match_line"], row["score"], row["first"], row["last"]) == (32, 1.0, 28, 44)


def test_modes_and_options(spark):
    docs = documents(spark, [f"alpha line {i}\nbeta {i}" for i in range(6)])
    assert whole_search(docs, "alpha", search.Options(mode="regex", limit=4)).count() == 4
    assert whole_search(docs, "alpha", search.Options(mode="lexical", path="d/3.txt")).count() == 1
    assert whole_search(docs, "alpha beta", search.Options(mode="hybrid")).count() == 6
    assert whole_search(docs, "zeta", search.Options(mode="semantic")).count() == 0
    for wrong in ({"mode": "x"}, {"limit": 0}, {"min_score": 2.0}, {"path": "../d"}, {"path": "d/99.txt"}):
        with pytest.raises(ValueError):
            whole_search(docs, "alpha", search.Options(**{"mode": "regex", **wrong}))


def test_round_robin_matches_a_loop(spark):
    rng = random.Random(7)
    views = [rng.sample(range(40), 20) for _ in range(3)]
    taken = []
    for rank in range(20):
        for view in views:
            if view[rank] not in taken:
                taken.append(view[rank])
    rows = spark.createDataFrame([(v, r, str(s)) for v, view in enumerate(views) for r, s in enumerate(view)], "view int, rank int, span string")
    got = [int(r["span"]) for r in search.round_robin(rows, 24).orderBy("place").collect()]
    assert got == taken[:24]


def test_roles(spark):
    rows = spark.createDataFrame([("a", "background", False, 0.9, 0, 1), ("b", "direct_support", False, 0.1, 0, 1), ("c", "no_support", True, 0.0, 0, 1)], "path string, role string, literal_anchor boolean, score double, byte_start int, byte_end int")
    assert [r["path"] for r in search.role_order(rows).orderBy("place").collect()] == ["c", "b", "a"]


def test_merge_joins_equal_leaves_and_folds_dear_subtrees():
    def rows(*nodes):
        return pd.DataFrame([(1, n, p, t, a, b, a, b, []) for n, p, t, a, b in nodes], columns=["doc", "node_id", "parent_id", "title", "page_start", "page_end", "line_start", "line_end", "key_items"])

    leaf = rows(("0000", None, "Leaf", 1, 4))
    assert tree.merge_document(leaf)["title"].tolist() == ["Leaf"]
    same = tree.merge_document(rows(("0000", None, "A", 1, 1), ("0001", None, "B", 1, 1), ("0002", None, "C", 2, 9)))
    assert same["title"].tolist() == ["A; B", "C"] and same["key_items"].tolist() == [["A", "B"], []]
    folded = tree.merge_document(rows(("0000", None, "R", 1, 2), ("0001", "0000", "x", 1, 1), ("0002", "0000", "y", 2, 2)))
    assert folded["title"].tolist() == ["R"] and folded["key_items"].tolist() == [["x", "y"]]
    kept = tree.merge_document(rows(("0000", None, "R", 1, 8), ("0001", "0000", "x", 1, 4), ("0002", "0000", "y", 5, 8)))
    assert kept["parent_id"].tolist() == [None, "0000", "0000"]


def test_costs(spark):
    nodes = spark.createDataFrame([(1, "0", None, 1, 8), (1, "1", "0", 1, 4), (1, "2", "0", 4, 6), (1, "3", "1", 1, 1)], "doc long, node_id string, parent_id string, page_start int, page_end int")
    got = {r["node_id"]: (r["span"], r["residual"], r["cost"]) for r in tree.costs(nodes).collect()}
    assert got == {"3": (1, 1, 1), "2": (3, 3, 3), "1": (4, 3, 4), "0": (8, 2, 5)}


def test_markdown_headings():
    text = "---\n# not\n---\n# One #\ntext\n\nTwo words\nmore\n---\n```\n# code\n```\n> # quote\n- # list\n### Three\n"
    assert tree.markdown_headings(text) == [(4, 1, "One"), (7, 2, "Two words more"), (15, 3, "Three")]


def test_null_strict_sums(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, v long")
    got = {r["g"]: (r["v_total"], r["v_known"], r["v_missing"]) for r in rows.groupBy("g").agg(*accounting.strict("v")).collect()}
    assert got == {"a": (None, 1, 1), "b": (2, 2, 0)}


def test_concurrency_and_unions_match_loops(spark):
    rng = random.Random(1)
    spans = [(a := rng.randint(0, 60), a + rng.randint(0, 15)) for _ in range(60)]
    rows = spark.createDataFrame([("p", a, b) for a, b in spans], "pool string, a long, b long")
    at = [sum(a <= t < b for a, b in spans) for t in range(80)]
    got = accounting.concurrency(rows, "pool", "a", "b").first()
    assert got["busy"] == sum(n > 0 for n in at) and got["summed"] == sum(at) and got["peak"] >= max(at)
    assert accounting.interval_union(rows, "pool", "a", "b").first()["covered"] == got["busy"]


def test_retry_is_resolved_by_the_next_success(spark):
    rows = spark.createDataFrame([(1, "r", 0, False), (1, "r", 1, False), (1, "r", 2, True), (1, "q", 3, False), (2, "r", 4, True)], "s int, request string, n long, ok boolean")
    assert {(r["n"], r["resolved_by"]) for r in accounting.retried(rows, "s", "request", "n").collect()} == {(0, 2), (1, 2), (3, None)}


def test_quality_of_no_answer_queries(spark):
    hits = spark.createDataFrame([("q", "x", 2), ("q", "y", 9)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "x"), ("q", "y"), ("r", "z")], "query string, item string")
    got = {r["query"]: (r["recall"], r["reciprocal_rank"]) for r in evaluation.recall_mrr(hits, relevant, 5).collect()}
    assert got == {"q": (0.5, 0.5), "r": (0.0, 0.0)}


def test_items_are_judged_by_words_split_once(spark):
    docs = spark.createDataFrame([(1, "So THE Red fox runs far"), (2, "the red fox"), (3, "undered foxes"), (4, ""), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "the Red fox"), ("b", "ed fox"), ("c", "none of these"), ("d", "THE Red fox runs")], "item_id string, text string")
    words = evaluation.words_of(docs, items)
    of_documents = words._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[0]
    assert of_documents.count("regexp_extract_all(") == 1
    held = words.localCheckpoint()
    assert sorted(map(tuple, evaluation.containing(docs, items, held).collect())) == [("b", 1), ("b", 2), ("b", 3), ("d", 1)]
    found = {(r["item_id"], r["doc_id"]): (round(r["score"], 3), r["rank"]) for r in evaluation.retrieved(items, held, 5).collect()}
    assert found == {("a", 1): (1.0, 1), ("a", 2): (1.0, 2), ("d", 1): (1.0, 1)}


def test_files_and_generations(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, body in {"a.md": "# A\nalpha\n", "sub/b.txt": "beta ü", "x.pem": "secret", ".env": "k=1", "node_modules/c.txt": "no", "img.png": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    docs = corpus.parsed(corpus.files(spark, str(root)))
    assert [r["path"] for r in docs.orderBy("path").collect()] == ["a.md", "sub/b.txt"]
    with pytest.raises(ValueError):
        corpus.files(spark, str(root), most_files=1)
    out = str(tmp_path / "index")
    first = generations.publish(docs.select("doc_key", "path", "text", "text_sha256", "source_sha256", "source_bytes"), out)
    assert generations.current(spark, out) == first
    second = generations.publish(docs.select("doc_key", "path", "text", "text_sha256", "source_sha256", "source_bytes").limit(1), out)
    tables = generations.opened(spark, out)
    assert generations.current(spark, out) == second and tables["documents"].count() == 1
    (root / "a.md").write_text("changed")
    recorded = docs.select("path", "source_sha256")
    assert {r["path"]: r["source_fresh"] for r in corpus.fresh(recorded, corpus.files(spark, str(root))).collect()}["a.md"]
    with pytest.raises(ValueError):
        generations.publish(docs.unionByName(docs).select("doc_key", "path", "text", "text_sha256", "source_bytes"), out)
    assert generations.current(spark, out) == second


def test_json_guard(spark):
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("[1]",), ('{"a":NaN}',), (None,)], "payload string")
    assert [r["valid"] for r in evaluation.json_faults(rows).collect()] == [True, False, False, False, False]


def test_catalog_agrees_with_sql(spark, data):
    import duckdb

    from folioscan.catalog import CATALOG
    from folioscan.oracle import ORACLE

    c = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "pages", "labels", "events"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")

    def plain(rows):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)

    for name, sql in ORACLE.items():
        ours = CATALOG[name](spark, data)
        names = sorted(ours.columns)
        listed = ", ".join(f'"{n}"' for n in names)
        assert plain(map(tuple, ours.select(*names).collect())) == plain(c.sql(f"SELECT {listed} FROM ({sql})").fetchall()), name


def test_patterns_with_escaped_signs_are_accepted():
    for source in (r"[*+]+", r"a\++b", r"\(?=x", r"[(?=]", r"\\d+"):
        pattern(source)
    for source in (r"a(?=b)", r"a(?<!b)", r"a*+", r"(a)\1", r"(?>a)", r"[a]++"):
        with pytest.raises(ValueError):
            pattern(source)


def test_tokens_of_constants_equal_those_of_columns(spark):
    texts = ["हिन्दी भाषा", "naïve ½ 杭州_x", "a-b c", "İstanbul"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("found")).collect()
    assert all(r["found"] == token_list(r["t"]) for r in rows)


def test_ids_of_any_length_and_null_sources_have_their_own_path(spark, tmp_path):
    spark.createDataFrame([(123456789, "s", "a"), (123456780, "s", "b"), (7, None, "c"), (7, "s", "d")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus.table_documents(spark, str(tmp_path)).collect()
    assert len({r["path"] for r in rows}) == 4 and None not in {r["doc_key"] for r in rows}


def test_pages_and_packets(spark):
    rows = spark.createDataFrame([("3-1",), ("0",), ("1,,2",), ("a",)], "s string")
    for r in rows.collect():
        with pytest.raises(Exception, match="page specification"):
            rows.filter(F.col("s") == r["s"]).select(rules.pages_of(F.col("s"))).collect()
    sizes = spark.createDataFrame([([5, 9, 4, 1, 1],)], "n array<long>")
    assert sizes.select(results.packet(F.col("n"), 3, 10).alias("t")).first()["t"] == [True, False, True, True, False]


def test_page_of_results_tells_where_the_next_begins(spark):
    rows = spark.range(25)
    last = results.paginated(rows, ["id"], 20, 10).collect()
    assert [r["id"] for r in last] == [20, 21, 22, 23, 24] and {r["next_offset"] for r in last} == {None}
    assert {r["next_offset"] for r in results.paginated(rows, ["id"], 0, 10).collect()} == {10}


def test_unequal_cost_parts_leave_the_gate_open(spark):
    rows = spark.createDataFrame([(True, 1.0, None), (True, 1.0, 2.0)], "ok boolean, a double, b double")
    r = rules.gate(rows, "ok", ["a", "b"], 1, "9").first()
    assert r["cost"] is None and r["cost_missing"] == 1 and not r["passes"]
