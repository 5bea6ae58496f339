"""License scans, ranked search and importance resampling against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import blockmax, licenses, resampling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {ord(a): ord(a.lower()) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# Ranked search


def ranked(docs, queries, k):
    """Every document's score, by the definition."""
    texts = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(texts), sum(size for *_, size in texts)
    df = collections.Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        scores = []
        for doc_id, counts, size in texts:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return collections.Counter(out)


def search(spark, docs, queries, tmp_path, k=5, most=blockmax.SEGMENT):
    index = blockmax.indexed(docs, str(tmp_path / f"index-{most}-{random.random()}"), most=most)
    return collections.Counter(tuple(r) for r in blockmax.searched(index, queries, k).collect())


def test_search_equals_scoring_everything(spark, prose, clashing, odd_rows, tmp_path):
    queries = [(1, prose(12)), (2, prose(30) + " the the the"), (3, "nosuchwordatall"), (4, None), (5, ""), (6, "word Word WORD"), (1, "of"), (None, prose(8)), (6, "word Word WORD")]
    expected = ranked([(r[0], r[1]) for r in odd_rows], queries, 5)
    for most in (blockmax.SEGMENT, 500):
        assert search(spark, clashing, items(spark, queries), tmp_path, most=most) == expected


def test_search_ties_and_blocks(spark, tmp_path):
    """Many equal documents over several blocks: of equal scores the least ids."""
    rng = random.Random(1)
    rows = [(i, rng.choice(("a b", "b c", "a a b c", "c d d é", "x"))) for i in rng.sample(range(5000), 1500)] + [(7000 + i, "x " * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = [(0, "a"), (1, "a b"), (2, "É é d"), (3, "x y"), (4, "a b c d x")]
    assert search(spark, docs, items(spark, queries), tmp_path, 20) == ranked(rows, queries, 20)
    assert search(spark, docs, items(spark, queries), tmp_path, 20, 400) == ranked(rows, queries, 20)


def test_search_of_nothing(spark, none, odd, tmp_path):
    assert not search(spark, none, items(spark, [(1, "a")]), tmp_path)
    assert not search(spark, odd, items(spark, []), tmp_path)


def test_salted_join_and_groups_of_queries(spark, odd, odd_rows, prose, tmp_path, monkeypatch):
    queries = [(i, prose(6)) for i in range(12)]
    monkeypatch.setattr(blockmax, "MOST_TERMS", 0)
    monkeypatch.setattr(blockmax, "QUERIES", 5)
    assert search(spark, odd, items(spark, queries), tmp_path, most=900) == ranked([(r[0], r[1]) for r in odd_rows], queries, 5)


def test_blocks_come_back_and_are_skipped():
    rng = np.random.default_rng(2)
    n = 20_000
    docs = np.sort(rng.choice(n, 9000, replace=False))
    frequency = np.where(rng.random(9000) < 0.01, rng.integers(300, 70_000, 9000), rng.integers(1, 3, 9000))
    frequency[4000:4200] = 90
    tokens = [np.zeros(0, np.int64)] * n
    for d, f in zip(docs.tolist(), frequency.tolist(), strict=True):
        tokens[d] = np.zeros(f, np.int64)
    lengths = [max(1, len(t)) for t in tokens]
    tokens = [t if len(t) else np.ones(1, np.int64) for t in tokens]
    rows = blockmax.segment_rows(0, list(range(n)), lengths, tokens, [b"a", b"b"], n, 20 * n).to_pylist()
    norms = np.array(rows[0]["norms"])
    row = next(r for r in rows if r["term"] == "a")
    lists = [np.array(row[c]) for c in ("firsts", "lasts", "maxima", "widths")]
    postings = blockmax.Postings(row["df"], *lists, row["postings"])
    read = [postings.block(b, norms) for b in range(len(lists[0]))]
    assert (np.concatenate([d for d, _ in read]) == docs).all()
    assert (np.concatenate([i for _, i in read]) == blockmax.impacts(frequency, norms[docs])).all()
    assert [i.max() for _, i in read] == row["maxima"]
    fresh = blockmax.Postings(row["df"], *lists, row["postings"])
    found, scores = blockmax.best([(fresh, 3)], norms, 10, 128)
    order = np.lexsort((docs, -blockmax.impacts(frequency, norms[docs])))[:10]
    assert found.tolist() == docs[order].tolist() and (scores == 3 * blockmax.impacts(frequency, norms[docs])[order]).all()
    assert len(fresh.read) < len(lists[0]) / 2


# Importance resampling


def drawn(docs, target, buckets, longest, percent, least, seed):
    def features(text):
        w = terms(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (collections.Counter(bucket(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(text))])
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(enough):
        r.append(rank + 1 if rank < percent * len(enough) // 100 else None)
    return collections.Counter((*r[:4], r[5] if len(r) > 5 else None) for r in rows)


@pytest.mark.parametrize(("buckets", "longest", "percent", "least"), [(10_000, 1, 10, 20), (64, 3, 50, 0)])
def test_resampling_equals_plain_python(spark, prose, clashing, odd_rows, tmp_path, buckets, longest, percent, least):
    target = [prose(40), None, prose(5), ""]
    rows = resampling.resampled(clashing, items(spark, list(enumerate(target))), str(tmp_path), percent, least, 2024, buckets, longest)
    got = collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows.collect())
    assert got == drawn([(r[0], r[1]) for r in odd_rows], target, buckets, longest, percent, least, 2024)


def test_the_matrix_is_kept_in_blocks(spark, prose, tmp_path, monkeypatch):
    docs = [(i if i % 7 else None, prose(30 + i % 50)) for i in range(120)] + [(3, "x " * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    path = str(tmp_path / "m")
    monkeypatch.setattr(resampling, "BLOCK", 1000)
    matrix = resampling.counted(frame, path)
    assert sum(len(r["ids"]) for r in matrix.collect()) == len(docs)
    sums = resampling.column_sums(spark.read.parquet(path))
    expected = collections.Counter(zlib.crc32(w.encode()) % 10_000 for _, t in docs for w in terms(t))
    assert {b: n for b, n in enumerate(sums.tolist()) if n} == expected
    got = collections.Counter((r["doc_id"], r["weight"]) for r in resampling.weighed(matrix, sums).collect())
    assert got == collections.Counter((i, sum(int(sums[zlib.crc32(w.encode()) % 10_000]) for w in terms(t))) for i, t in docs)


def test_files_of_the_matrix_have_few_blocks(spark, prose, tmp_path, monkeypatch):
    """A task decodes whole files' blocks at once, so they must not grow with its share of the input."""
    monkeypatch.setattr(resampling, "BLOCK", 200)
    frame = spark.createDataFrame([(i, prose(60)) for i in range(100)], "doc_id long, text string").coalesce(1)
    matrix = resampling.counted(frame, str(tmp_path / "m"))
    files = collections.Counter(r[0] for r in matrix.select(F.input_file_name()).collect())
    assert len(files) > 1 and max(files.values()) <= 4
    assert sorted(i for r in matrix.collect() for i in r["ids"]) == list(range(100))


def test_resampling_of_nothing(spark, none, odd, tmp_path):
    assert resampling.report(none, items(spark, [(1, "a")])).count() == 0
    assert resampling.report(odd, items(spark, [])).count() == odd.count()


# License scans


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scanned(docs).collect()}


def base(text):
    w = terms(text)
    found = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_equal_a_plain_search(clashing, odd_rows, spark):
    texts = ["MIT License, mit license; MIT\nlicense", "the Apache License and the GNU general public license", "mit licenses", "permit license", "mit  licence", "mit license mit license x apache license", "É mit—license mit license"]
    docs = clashing.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = licenses.report(docs).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == collections.Counter((i, *base(t)) for i, t in [*((r[0], r[1]) for r in odd_rows), *((500 + i, t) for i, t in enumerate(texts))])
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in rows)


def test_copies_of_templates_are_found_where_they_stand(spark, prose):
    rng = random.Random(6)
    texts, expected = [], []
    for number, (label, template) in enumerate(licenses.TEMPLATES):
        w = template.split()
        changed = list(w)
        for at in rng.sample(range(len(w)), len(w) // 10):
            changed[at] = "zzz"
        longer = list(w)
        for _ in range(len(w) // 12):
            longer.insert(rng.randrange(1, len(longer)), "yyy")
        for version in (w, changed, longer, w[: max(3, len(w) // 3)]):
            before = prose(rng.randint(0, 60))
            texts.append(f"{before}\n{' '.join(version)}\n{prose(rng.randint(0, 60))}")
            expected.append((label, number, len(terms(before)), version))
    got = scanned(spark, texts)
    for i, (label, number, start, version) in enumerate(expected):
        spans = [s for s in got[i]["spans"] if s["label"] == label and abs(s["first_word"] - start) <= 12]
        whole = len(version) >= 0.9 * len(licenses.TEMPLATES[number][1].split())
        if whole:
            assert spans and label in got[i]["labels"].split(","), (i, texts[i])
            assert min(abs(s["first_word"] - start) for s in spans) <= licenses.K
        elif i % 4 == 3 and len(version) >= 20:
            assert not [s for s in got[i]["spans"] if s["template"] == number]


def test_clean_texts_get_no_label(spark, prose):
    texts = [prose(300) for _ in range(20)] + ["", None, "license", "this work is fine and licensed", "permission is hereby granted to nobody"]
    rows = scanned(spark, texts)
    assert all(r["labels"] == "" and not r["spans"] and r["score"] < licenses.LEAST for r in rows.values())


def test_every_copy_and_every_place_is_labelled(spark, prose, clashing):
    notice = "Licensed under CC BY-NC 4.0."
    text = prose(50) + "\n" + notice + "\n" + prose(40) + "\n" + notice
    rows = scanned(spark, [text] * 30 + [prose(10)])
    assert all(r["labels"] == "cc-by-nc" and len(r["spans"]) == 2 and r["score"] == 1.0 for i, r in rows.items() if i < 30) and rows[30]["labels"] == ""
    kept = licenses.scanned(clashing.drop("n_words", "score"))
    assert kept.columns[: len(clashing.columns) - 2] == [c for c in clashing.columns if c not in ("n_words", "score")]


def test_common_words():
    rng = random.Random(9)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(max(before[j + 1], row[-1], before[j] + (x == y)))
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert licenses.common_words(a, b) == plain(a, b)


def test_large_templates_tables_are_joined_by_a_shuffle(spark, prose, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_ROWS", 0)
    assert scanned(spark, ["x Released under the MIT License y", prose(9)])[0]["labels"] == "mit"
    with pytest.raises(ValueError):
        licenses.template_table(spark, (("x", "too short"),))


def test_no_documents(none):
    assert licenses.report(none).count() == 0
