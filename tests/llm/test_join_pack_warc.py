"""The similarity join and packing against brute force, revisits against a loop, and the pipeline."""

from __future__ import annotations

import bisect
import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from folioscan.llm import ngram_join, packing, warc
from folioscan.llm.queries import queries, tokenizer_path
from folioscan.llm.sql import oracle_sql


def sets(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """Class and links of each row, by all pairs."""
    s = [sets(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(s[a] & s[b])
        if s[a] == s[b] or both and 10 * both >= 8 * (len(s[a]) + len(s[b]) - both):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], least[find(i)], links[i]) for i, r in enumerate(rows))


def near(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


def result(df):
    return collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.joined(df).collect())


def test_join(odd, odd_rows, none):
    assert result(odd) == brute(odd_rows)
    assert ngram_join.report(none).count() == 0


def test_join_of_groups_and_shared_passages(spark, odd, prose):
    rng = random.Random(9)
    passage = prose(40)
    rows = [(i, prose(200), None, None, None) for i in range(60)] + [(100 + i, passage + " " + prose(60), None, None, None) for i in range(80)]
    for g in range(12):
        base = prose(250)
        rows += [(1000 + 20 * g + i, near(base, i, rng), None, None, None) for i in range(8)]
    assert result(spark.createDataFrame(rows, odd.schema).repartition(5)) == brute(rows)


def test_large_groups_go_through_blocks(spark, odd, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 8)
    rng = random.Random(3)
    base = prose(150)
    rows = [(i, near(base, 1, rng), None, None, None) for i in range(70)] + [(200 + i, prose(50), None, None, None) for i in range(30)]
    assert result(spark.createDataFrame(rows, odd.schema)) == brute(rows)


def test_joins_by_shuffle_beyond_the_broadcast_bound(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    assert result(odd) == brute(odd_rows)


def shuffled(spark):
    """Bytes written to shuffles so far."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_a_like_are_not_shuffled(spark, odd, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    rng = random.Random(12)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(600)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, near(texts[0], 3, rng), near(texts[599], 3, rng)])], odd.schema)
    before = shuffled(spark)
    kept = {r["doc_id"] for r in ngram_join.deduplicated(rows).select("doc_id").collect()}
    assert kept == set(range(600))
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


def test_marked_ids_are_never_missed(spark):
    ids = spark.range(0, 3000, 3)
    rows = ngram_join.marked(spark.range(3000).withColumnRenamed("id", "k"), "k", ids, 1000)
    found = {r["k"] for r in rows.filter("_maybe").collect()}
    assert found >= set(range(0, 3000, 3)) and len(found) < 1000 + 2000 / 4
    assert [r["_maybe"] for r in ngram_join.marked(spark.sql("SELECT CAST(7 AS LONG) AS k"), "k", ids.limit(0), 0).collect()] == [False]


def test_join_of_different_texts_with_one_id(spark, odd, prose):
    """Near copies of each other, and texts of which each has its own near copy."""
    rng = random.Random(6)
    a, b, c = prose(200), prose(200), prose(200)
    rows = [(i, t, None, None, None) for i, t in [(1, a), (1, near(a, 1, rng)), (2, b), (2, c), (3, near(b, 1, rng)), (4, near(c, 1, rng)), (5, near(c, 2, rng))]]
    assert result(spark.createDataFrame(rows, odd.schema)) == brute(rows)


def test_deduplicated(clashing, odd_rows):
    kept = ngram_join.deduplicated(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, c, _ in brute(odd_rows)}


def test_deduplicated_keeps_unlike_texts_of_one_id(spark, odd, prose):
    a, b, c = prose(100), prose(100), prose(100)
    rows = [(5, a, None, None, None), (5, b, None, None, None), (9, c, None, None, None), (7, a, None, None, None), (7, a, None, None, None)]
    kept = ngram_join.deduplicated(spark.createDataFrame(rows, odd.schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, a), (5, b), (9, c)])


def test_large_keys_are_joined_apart(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 1)
    assert result(odd) == brute(odd_rows)


def test_recall_of_links_near_the_threshold(spark, odd, prose):
    """Groups of near copies, many of them barely alike: all of their links between different texts are found."""
    rng = random.Random(12)
    rows = []
    for g in range(25):
        base = prose(120)
        rows += [(100 * g + i, near(base, rng.randint(0, 2), rng), None, None, None) for i in range(14)]
    expected = brute(rows)
    assert sum(k[2] * n for k, n in expected.items()) > 2000
    assert result(spark.createDataFrame(rows, odd.schema)) == expected


def check_packing(rows, placed, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(p)[:5] for p in placed) == expected
    by = collections.defaultdict(list)
    for p in placed:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(p["length"] for p in placed)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(odd, odd_rows, capacity):
    strange = [(300, "It's they'LL don't <|endoftext|>x İstanbul ΑΣ été naïve\x1cfoo bar 杭州 a1b2 ½ ''s", None, None, None)]
    df = odd.unionByName(odd.sparkSession.createDataFrame(strange, odd.schema))
    sequences, total = check_packing(odd_rows + strange, packing.report(df, tokenizer_path(), capacity).collect(), capacity)
    assert sequences <= -(-total // capacity) * 1.2 + 1


def test_packing_of_nothing_and_extra_columns(none, clashing):
    assert packing.report(none, tokenizer_path()).count() == 0
    assert packing.report(clashing, tokenizer_path()).count() > 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - length)
    return len(gaps)


@pytest.mark.parametrize(("kind", "size"), [("mixed", 40), ("equal", 50_000), ("tiny", 50_000)])
def test_rounds_pack_like_best_fit_decreasing(spark, monkeypatch, kind, size):
    """In one range and in many, offsets are gapless, each piece has one place, and few sequences more are used than by a serial packer."""
    monkeypatch.setattr(packing, "RANGE", size)
    rng, capacity = random.Random(7), 1000
    lengths = {"mixed": [min(1000, int(rng.expovariate(1 / 120)) + 1) for _ in range(900)], "equal": [300] * 400 + [rng.randint(1, 100) for _ in range(100)], "tiny": [2] * 3000, "one": [1000]}[kind]
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, size int").repartition(3)
    found = packing.placed(rows, capacity).collect()
    assert sorted(r["id"] for r in found) == list(range(len(lengths)))
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence"]].append((r["offset"], lengths[r["id"]]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= best_fit_decreasing(lengths, capacity) + 1


def test_sweep_gives_each_slot_its_largest_piece():
    """A range's sweep, and what is left of ranges matched across them, equal a serial successor sweep over all."""
    import pandas as pd

    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.randint(1, 30), rng.choice([packing.PIECE, packing.GAP]), i) for i in range(rng.randint(1, 40))]
        order = sorted(rows)
        stack, expected = [], set()
        for size, kind, i in order:
            if kind == packing.PIECE:
                stack.append(i)
            elif stack:
                expected.add((stack.pop(), i))
        cut = rng.randint(1, 6)
        frame = pd.DataFrame([(k * cut // len(order), kind, i, size, 0, size, i) for k, (size, kind, i) in enumerate(order)], columns=["_range", "kind", "id", "size", "slot", "free", "key"])
        out = pd.concat([packing.swept(g) for _, g in frame.groupby("_range")])
        got = {(r.id, r.sequence) for r in out[(out.kind == packing.PIECE) & (out._rank < 0)].itertuples()}
        left = {(r._1, r.kind, r._8): (r.id if r.kind == packing.PIECE else r.sequence) for r in out[out._rank >= 0].itertuples()}
        counts = collections.Counter(k[:2] for k in left)
        for _, low, a, high, b, n in packing.across(counts):
            got |= {(left[low, packing.PIECE, a + k], left[high, packing.GAP, b + k]) for k in range(n)}
        assert got == expected


def test_sequences_have_the_ids(odd):
    placed = packing.packed(packing.tokenized(odd, tokenizer_path(), 128, with_ids=True), 128)
    rows = packing.sequences(placed).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 512 for r in rows)


def test_revisits(spark):
    kinds = "record_id long, kind string, url string, at long, headers map<string,string>"
    rng = random.Random(5)
    rows = []
    for i in range(400):
        url = rng.choice(["http://www.A.com/x/", "https://a.com/x", "http://b.org/y?utm_source=f&q=1", "http://b.org/y?q=1", "http://hot.net/", None, ""] + ["http://hot.net/"] * 4)
        headers = {"etag": rng.choice(['"1"', '"2"', 'W/"1"']), "x": str(i)} if rng.random() < 0.8 else ({"last-modified": rng.choice("ab")} if rng.random() < 0.7 else None)
        rows.append((i, rng.choice(["response", "revisit", "revisit"]), url, rng.choice([None, *range(50)]), headers))
    rows += rows[:3]
    key = {"http://www.A.com/x/": "a.com/x", "https://a.com/x": "a.com/x", "http://b.org/y?utm_source=f&q=1": "b.org/y?q=1", "http://b.org/y?q=1": "b.org/y?q=1", "http://hot.net/": "hot.net", None: None, "": None}
    expected = collections.Counter()
    for i, kind, url, at, headers in rows:
        if kind != "revisit":
            continue
        before = [(r[3], r[0], r[4]) for r in rows if r[1] == "response" and key[r[2]] == key[url] and r[3] is not None and at is not None and (r[3], r[0]) < (at, i)]
        last, own = max(before, key=lambda x: x[:2], default=None), headers or {}
        if key[url] is None:
            expected[i, "no_url", None, None] += 1
        elif at is None:
            expected[i, "no_time", None, None] += 1
        elif not last:
            expected[i, "no_response", None, None] += 1
        else:
            theirs = last[2] or {}
            pair = next(((own[k].removeprefix("W/"), theirs[k].removeprefix("W/")) for k in ("etag", "last-modified") if k in own and k in theirs), (0, 0))
            ok = pair[0] == pair[1]
            expected[i, "resolved" if ok else "mismatch", last[1] if ok else None, theirs.get("x") if ok else None] += 1
    found = warc.resolved(spark.createDataFrame(rows, kinds)).collect()
    got = collections.Counter((r["record_id"], r["status"], r["response_id"], (r["headers"] or {}).get("x") if r["status"] == "resolved" else None) for r in found)
    assert got == expected
    assert warc.resolved(spark.createDataFrame([], kinds)).count() == 0


def test_revisits_of_odd_captures(spark):
    """A response without headers, m. as a host of its own, and times and ids at both ends of the longs."""
    kinds = "record_id long, kind string, url string, at long, headers map<string,string>"
    low, high = -(2**63), 2**63 - 1
    rows = [
        (1, "response", "http://a.org/", 1, None), (2, "revisit", "http://a.org/", 2, {"etag": '"1"', "server": "x"}),
        (3, "response", "http://m.b.org/", 1, {"etag": '"1"'}), (4, "revisit", "http://www.b.org/", 2, {"etag": '"1"'}),
        (low, "response", "http://c.org/", low, {"etag": '"9"'}), (high, "revisit", "http://c.org/", high, {"etag": '"9"'}),
    ]
    found = {r["record_id"]: r for r in warc.resolved(spark.createDataFrame(rows, kinds)).collect()}
    assert (found[2]["status"], found[2]["headers"]) == ("resolved", {"etag": '"1"'})
    assert found[4]["status"] == "no_response"
    assert (found[high]["status"], found[high]["response_id"]) == ("resolved", low)
    wide = spark.createDataFrame([(low, "http://a.org", "x"), (high, "http://a.org", "x")], "page_id long, url string, html string")
    assert sorted(r["status"] for r in warc.report(wide).collect()) == ["resolved", "resolved"]


def test_sql(spark, data):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    for name, sql in oracle_sql().items():
        ours = queries()[name](spark, data)
        names = sorted(ours.columns)
        rounded = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in map(tuple, ours.select(*names).collect())]
        theirs = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in c.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()]
        assert sorted(rounded, key=str) == sorted(theirs, key=str), name


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    previous = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, previous, data).cache()
        assert after.columns == docs.columns and 0 < after.count(), name
        if name != "mixture":
            assert after.count() < previous.count() and after.exceptAll(previous).isEmpty(), name
        if name == "near_duplicates":
            assert not {r["n_links"] for r in ngram_join.joined(after).collect()} - {0}
        previous = after
    placed = corpus_pipeline.STAGES[-1][1](spark, previous, data).collect()
    rows = [tuple(r) for r in previous.select("doc_id", "text").collect()]
    check_packing(rows, placed, 4096)
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in placed)


def test_pipeline_of_odd_tables(spark, odd, clashing, odd_rows, none, prose, tmp_path):
    """Nulls in every column, repeated rows and ids, clashing and dotted names, a null id; and an empty table."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    labels = [(i, 1, int(i % 3 == 0)) for i in range(24)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [*odd_rows, (None, prose(90), None, None, None), (None, prose(90), None, "s0", None)]
    wide = spark.createDataFrame(rows, odd.schema).withColumns({**{c: F.lit("own") for c in clashing.columns if c not in odd.columns}, "a.b": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (wide, none):
            after = stage(spark, table, str(tmp_path))
            assert after.columns == table.columns, name
            kept = after.count()
            assert 0 < kept <= 2 * len(rows) if table is wide else kept == 0, name
    packed = corpus_pipeline.pack(spark, wide, str(tmp_path))
    assert packed.select("doc_id", "piece", "ids_crc32").count() >= len(rows) and corpus_pipeline.pack(spark, none, str(tmp_path)).count() == 0
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {r["doc_id"] for r in out.select("doc_id").collect()} <= {r[0] for r in rows}


def test_plans_of_components_stay_small(spark, monkeypatch):
    plans, settle = [], ngram_join.settle

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return settle(df)

    monkeypatch.setattr(ngram_join, "settle", kept)
    found = ngram_join.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 130)}
    assert max(plans) <= 12  # over 20 when each frame held those that it was made of
