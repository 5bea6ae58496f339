"""Decision requests and answers, adaptive windows and nested trees."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscan.catalog import ANSWERS, QUESTIONS, decision_rows
from folioscan.operators import decisions, lines, outline


def faults(spark, asked, told):
    requests = spark.createDataFrame([(i, '"s"', q) for i, q in enumerate(asked)], "request_id long, state string, questions string")
    responses = spark.createDataFrame(list(enumerate(told)), "request_id long, body string")
    found = [sorted((r["request_id"], r["question"] or "", r["fault"]) for r in f.collect()) for f in (decisions.request_faults(requests), decisions.response_faults(requests, responses))]
    return found


def test_sound_pairs_have_no_fault(spark):
    short = json.dumps({"model": "m", "answers": {"a": {"type": "noul", "noul": 0}, "b": {"type": "choice", "choice": "no"}, "c": {"type": "score", "score": 2}}, "usage": None})
    assert faults(spark, [QUESTIONS, QUESTIONS], [ANSWERS, short]) == [[], []]


def test_rounded_shares_are_let_pass(spark):
    near, far = (ANSWERS.replace('"yes":0.7', f'"yes":{x}') for x in ("0.715", "0.73"))
    assert faults(spark, [QUESTIONS, QUESTIONS], [near, far]) == [[], [(1, "b", "distribution")]]


def test_several_questions_may_be_at_fault(spark):
    asked = QUESTIONS.replace('"noul"', '"none"').replace('"low",', "5,")
    told = ANSWERS.replace('"noul":0.5', '"noul":true').replace('"c":{', '"e":{')
    assert faults(spark, [asked, QUESTIONS], [ANSWERS, told])[0] == [(0, "a", "type"), (0, "c", "criteria")]
    assert faults(spark, [QUESTIONS], [told])[1] == [(0, "a", "probability"), (0, "c", "answer_ids"), (0, "e", "answer_ids")]
    assert faults(spark, [QUESTIONS] * 3, ["", "[]", '{"model":"m"}'])[1] == [(0, "", "json"), (1, "", "json"), (2, "", "schema")]


def parses(frame):
    """How many times a plan parses JSON."""
    return frame._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson(")


def test_requests_are_parsed_once_for_each_part_of_the_report(spark):
    requests = spark.createDataFrame([(1, '"s"', QUESTIONS)], "request_id long, state string, questions string")
    assert 1 <= parses(decisions.request_faults(requests)) <= 3


def test_responses_are_parsed_once_for_each_part_of_the_report(spark):
    requests = spark.createDataFrame([(1, '"s"', QUESTIONS), (2, '"s"', "[]")], "request_id long, state string, questions string")
    responses = spark.createDataFrame([(1, ANSWERS), (2, ANSWERS), (3, ANSWERS)], "request_id long, body string")
    found = decisions.response_faults(requests, responses)
    assert 1 <= parses(found) <= 2
    assert sorted(map(tuple, found.collect())) == [(i, q, "answer_ids") for i in (2, 3) for q in "abc"]


def test_windows_fit_and_tile(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", '"', "\\", "\n", "é", "🙂", "\x01"], [20, 2, 1, 2, 3, 1, 0.3], k=rng.randint(0, 900))) for _ in range(30)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lines.fitted_windows(docs, 64, 72, "doc_id").orderBy("doc_id", "ordinal").collect()
    for i, text in enumerate(texts):
        own, raw, at = [r for r in rows if r["doc_id"] == i], (text or "").encode(), 0
        for k, r in enumerate(own):
            part = raw[r["byte_start"] : r["byte_end"]].decode()
            assert (r["ordinal"], r["byte_start"]) == (k, at) and r["encoded"] == len(json.dumps(part, ensure_ascii=False).encode()) <= 72
            at = r["byte_end"]
        assert at == len(raw)
    with pytest.raises(Exception, match="no window"):
        lines.fitted_windows(docs.filter(F.length("text") > 9), 64, 5, "doc_id").collect()


def test_trees_are_nested(spark):
    text = 'intro\n# A "x"\n## B\n### C\n## D\n# E\n'
    docs = spark.createDataFrame([(1, "t", text), (2, "bare", "one\n")], "doc long, title string, text string")
    nodes = outline.built(docs, outline.whole_pages(docs), outline.document_headings(docs))
    found = {r["doc"]: r for r in outline.nested(nodes).collect()}

    def shape(trees):
        return [(t["title"], t["node_id"], shape(t.get("nodes", []))) for t in trees]

    assert shape(json.loads(found[1]["tree"])) == [("Preface", "0000", []), ('A "x"', "0001", [("B", "0002", [("C", "0003", [])]), ("D", "0004", [])]), ("E", "0005", [])]
    assert (found[1]["nodes"], found[1]["depth"], shape(json.loads(found[2]["tree"]))) == (6, 3, [("bare", "0000", [])])


def test_deep_trees_merge_without_recursion(spark):
    from folioscan.operators import tree

    rows = [(1, f"{i:04d}", f"{i - 1:04d}" if i else None, f"t{i}", 1, 3000 - i, 1, 3000 - i, None) for i in range(2500)]
    got = tree.merged(spark.createDataFrame(rows, tree.MERGED)).collect()
    assert len(got) >= 1 and sum(len(r["key_items"] or []) for r in got) + len(got) >= 2500


def test_requests_are_dealt_over_tasks_whatever_the_files_row_groups(spark, data):
    requests, responses = decision_rows(spark, data)
    for rows in (requests, responses):
        assert rows.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
