"""Pattern dialect, plans of trigrams and the stored index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions import patterns
from folioscan.operators import lines, search, trigram
from folioscan.sources import corpus

SCHEMA = "doc_id long, text string"


def documents(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return corpus.described(rows, F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def stored(spark, docs, tmp_path):
    trigram.write_index(docs, "doc_key", str(tmp_path / "index"), 16)
    return trigram.open_index(spark, str(tmp_path / "index"))


def lines_of(found):
    return sorted((r["path"], r["line_no"], r["line"], r["match_column"]) for r in found.collect())


def test_dialect(spark):
    rows = spark.createDataFrame([(x,) for x in ("ÄBC", "αβγ", "abc 12", "a+b", "x\x0by", "Kelvin", "foo_bar", "zñ")], "line string")
    cases = {
        r"\p{L}+ \d": {"abc 12"}, r"^\p{Greek}+$": {"αβγ"}, r"^\p{Script=Greek}": {"αβγ"}, r"(?P<n>\d{2})": {"abc 12"}, r"(?<a_b>\d)$": {"abc 12"}, "^[[:alpha:]]+ ": {"abc 12"},
        "^[^[:ascii:]]+": {"ÄBC", "αβγ"}, r"a\+b": {"a+b"}, r"\v": {"x\x0by"}, "(?i)^kELVIN$": {"Kelvin"}, r"\bbar\b": set(), r"\<foo_bar\>": {"foo_bar"}, "[a-z&&[^a-y]]ñ": {"zñ"},
        "[[a-z]--[a-y]]": {"zñ"}, r"\x{3b1}β": {"αβγ"}, "(?x) a b c # letters": {"abc 12"}, r"\p{Lu}{2,}": {"ÄBC"}, r"\p{lowercase_letter}ñ": {"zñ"}, "[]+]b": {"a+b"}, "(?s-i:b.)$": {"ÄBC"} - {"ÄBC"},
        r"\PL+b": {"a+b", "foo_bar"}, "(?:a|x).+?[by]$": {"a+b", "x\x0by"},
    }
    for source, expected in cases.items():
        assert {r["line"] for r in rows.filter(F.col("line").rlike(patterns.java(source))).collect()} == expected, source
    for wrong in (r"\Z", r"\G", r"\R", r"\Qa\E", r"(a)\1", r"\k<a>", "(?=a)", "(?<!a)", "(?>a)", "a++", "a{,3}", "{2}", "*a", "[z-a]", "(", ")", "[", "\\", r"\p{Nonsense}", r"\h", "(?P<1>a)", "a{3,2}", r"\x{D800}"):
        with pytest.raises(ValueError):
            patterns.java(wrong)


def test_plans():
    assert patterns.plan("hello.*world") == ("and", ("hel", "ell", "llo", "wor", "orl", "rld"))
    assert patterns.plan("abc|abd") == ("or", ("abc", "abd"))
    assert patterns.plan("colou?r") == ("or", (("and", ("col", "olo", "lor")), ("and", ("col", "olo", "lou", "our"))))
    assert patterns.plan("x*") is patterns.plan("ab") is patterns.plan("(abc)?") is patterns.plan("abc|.") is True
    assert patterns.plan("a.b", literal=True) == "a.b"
    assert patterns.plan("(abc){2}") == ("and", ("abc", "bca", "cab"))


def test_index_loses_nothing(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcKkſsS é\n", k=60)) for _ in range(150)] + ["", "\n", "abc"]
    docs = documents(spark, texts)
    index = stored(spark, docs, tmp_path)
    sources = ["abc", "a[bc]a", "(ab|ba)+c", "a{2,3}b", "abc|k", "(?i)kss", "a.c.?b", "[ab]{3}", "(a|bc)(ca|b)?k", "^abc$", "s s|é"]
    found = search.indexed_searches(docs, index, sources)
    for i, source in enumerate(sources):
        scan = lines_of(search.grep(docs, source))
        assert lines_of(found.filter(F.col("pattern") == i)) == scan, source
    plan = index.candidates(patterns.plan("abcab"))
    assert {r[0] for r in plan.collect()} <= {r["doc_key"] for r in docs.filter(F.contains("text", F.lit("abc"))).collect()}
    assert lines_of(search.grep_indexed(docs, "abc")) == lines_of(search.grep(docs, "abc", literal=True))


def test_only_the_plan_s_buckets_are_read(spark, tmp_path):
    index = stored(spark, documents(spark, ["needle here", "nothing", "a needle"]), tmp_path)
    plan = index.lists(["nee", "dle"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert {r[0] for r in trigram.read_index(spark, str(tmp_path / "index"), "needle").select("tri").distinct().collect()} == {"nee", "eed", "edl", "dle"}


def test_marks_are_candidates(spark, tmp_path):
    docs = documents(spark, ["# Alpha\n", "\ufeff# Alpha\n", "beta"])
    index = stored(spark, docs, tmp_path)
    assert [x[0] for x in lines_of(search.indexed_searches(docs, index, ["^# Alpha"]))] == ["d/0.txt"]
    for source in ("\ufeff# Alpha", r"\x{FEFF}#"):
        assert [x[2] for x in lines_of(search.indexed_searches(docs, index, [source]))] == ["\ufeff# Alpha"]
    accept = docs.filter("doc_id = 2").select("doc_key")
    assert search.admitted(docs, index, [True], accept).count() == 1


def test_broken_indexes_are_errors(spark, tmp_path):
    docs = documents(spark, ["needle here", "nothing", "a needle"])
    with pytest.raises(FileNotFoundError):
        trigram.open_index(spark, str(tmp_path / "index"))
    index = stored(spark, docs, tmp_path)
    with pytest.raises(FileExistsError):
        trigram.write_index(docs, "doc_key", str(tmp_path / "index"))
    for changed in (docs.filter("doc_id <> 2"), docs.withColumn("text", F.concat("text", F.lit("!")))):
        with pytest.raises(Exception, match="missing or has changed"):
            search.indexed_searches(changed, index, ["needle"]).collect()
    manifest = trigram.read_json(spark, str(tmp_path / "index" / "manifest.json"))
    for wrong in ({"complete": False}, {"version": 1}, {"files": 4}, {"digest": "0"}):
        trigram.write_json(spark, str(tmp_path / "index" / "manifest.json"), {**manifest, **wrong}, overwrite=True)
        with pytest.raises(ValueError):
            trigram.open_index(spark, str(tmp_path / "index"))


def test_empty_corpus(spark, tmp_path):
    index = stored(spark, documents(spark, []), tmp_path)
    assert index.candidates(patterns.plan("abc")).count() == 0 and index.candidates(True).count() == 0


def test_segments_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """A worker sorts the trigrams of a bounded piece of texts, however many a task has; candidates are the same."""
    monkeypatch.setattr(trigram, "PIECE", 1000, raising=False)
    docs = spark.createDataFrame([(i, ("needle " if i % 3 == 0 else "thread ") * 30 if i else None) for i in range(40)], "doc_id long, text string").coalesce(1)
    trigram.write_index(docs, "doc_id", str(tmp_path / "index"))
    index = trigram.open_index(spark, str(tmp_path / "index"))
    sizes = [len(r["keys"]) for r in index.segments.filter("bucket = -1").collect()]
    assert len(sizes) >= 10 and max(sizes) <= 5 and sum(sizes) == 40
    assert {r[0] for r in index.candidates(("and", ["nee", "eed"])).collect()} == set(range(3, 40, 3))
    assert trigram.postings(docs, "doc_id").filter("tri = 'nee'").count() == 13
