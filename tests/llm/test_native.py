"""Quality rules, sharding, mixing and fingerprints against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

from folioscan.llm import fingerprints, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, odd, odd_rows):
    extra = [(200, "a b c d e f\na b c d e f\na b c d e f", "en", "s", 0), (201, "x # y $$ z", "en", "s", 0), (202, "one two three four five six one two three four five", "en", "s", 0)]
    rows = odd_rows + extra
    got = collections.Counter(tuple(r)[:6] for r in quality_rules.report(odd.unionByName(spark.createDataFrame(extra, odd.schema))).collect())
    assert got == collections.Counter((r[0], *counts(r[1])) for r in rows)


def test_quality_verdicts(spark, prose, odd, none, clashing):
    texts = {"clean": prose(200), "short": "a few words", "symbols": " ".join(w + "###" for w in prose(100).split()), "caps": prose(80).upper(), "stutter": "one two three four five six " * 30, "pipes": prose(90).replace(" ", " | ")}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts.values())], odd.schema)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.report(docs).collect()}
    assert [kept[i] for i in range(len(texts))] == [True, False, False, False, False, False]
    assert quality_rules.report(none).count() == 0
    passed = quality_rules.filtered(clashing)
    assert passed.columns == clashing.columns and {r["kept"] for r in passed.collect()} == {"own"}


def test_shards(odd, odd_rows, none, clashing):
    rows = sharding.report(clashing, 5).collect()
    size = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == size
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    mixture = collections.Counter((r["shard"], r["source"]) for r in rows)
    total = collections.Counter(r[3] for r in odd_rows)
    assert all(abs(mixture[k, s] - n / 5) <= 1.5 for s, n in total.items() for k in range(5))
    assert sharding.report(none).count() == 0
    again = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.report(clashing, 5).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows}


def shared_out(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mix(odd, odd_rows, none, clashing):
    sizes = collections.Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    expected = shared_out(sizes, (5, 2, 1), 1.5, 2)
    rows = mixing.report(clashing).collect()
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert sorted(map(str, mixing.report(clashing).collect())) == sorted(map(str, rows))
    assert mixing.report(none).count() == 0
    out = mixing.mixed(clashing, (5, 2, 1), 1.5, 2.0)
    assert out.columns == clashing.columns
    assert not {100, 101, 102} & {r["doc_id"] for r in out.select("doc_id").collect()}


def test_a_cut_among_equal_rows_is_exact(spark, odd, prose):
    """Rows repeated as wholes, and rows of one id and size with different texts, at a cut."""
    same = prose(97)
    rows = [(5, same, "en", "s0", 1)] * 50 + [(6, prose(97), "en", "s1", 1) for _ in range(40)] + [(k, prose(30), "en", "s2", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, odd.schema).repartition(7)
    found = mixing.report(docs, (2, 3, 5), 1.0).collect()
    taken, target = collections.Counter(), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(found) == len(rows) and all(abs(taken[s] - t) <= 1 for s, t in target.items()) and all(round(target[s]) % 97 for s in ("s0", "s1"))
    mixed = mixing.mixed(docs, (2, 3, 5), 1.0, 2.0).collect()
    words = collections.Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    assert all(0 <= words[s] - t < 101 for s, t in target.items())


def cuts_by_loop(rows, weights, share, cap):
    """Words taken of each row, by walking each source's rows in the order of the random key."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal = shared_out(sizes, weights, share, cap)
    taken = {}
    for s in sizes:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["doc_id"]))
        left = int(goal[s] + 0.5)
        for k in range(3):
            for r in own:
                part = min(r["size"], left)
                taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + part
                left -= part
    return taken


def test_cuts_equal_a_walk_over_the_sorted_rows(spark, odd, prose):
    from pyspark.sql import functions as F

    rows = [(i, prose(1 + i % 50), "en", f"s{i % 5 % 3}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, odd.schema)
    keys = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.random_key(11, F.col("doc_id")).alias("key")).collect()
    expected = cuts_by_loop([r.asDict() for r in keys], (5, 2, 1), 1.5, 2)
    assert {r["doc_id"]: r["taken"] for r in mixing.report(docs).collect()} == expected


def test_shards_interleave_by_fractional_rank(spark, odd, prose):
    """Order of places equals that of (2 rank + 1) / (2 rows), ranks by the seeded key in each source."""
    from pyspark.sql import functions as F

    rows = [(i, "x", "en", f"s{min(i % 7, 3)}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, odd.schema)
    keys = collections.defaultdict(list)
    for r in docs.select("doc_id", "source", sharding.random_key(7, F.col("doc_id")).alias("key")).collect():
        keys[r["source"]].append((r["key"], r["doc_id"]))
    order = sorted(((2 * k + 1) / (2 * len(own)), s, doc) for s, own in keys.items() for k, (_, doc) in enumerate(sorted(own)))
    found = sorted(sharding.report(docs, 8).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in found] == [doc for _, _, doc in order]


def test_dotted_names_pass_the_filter(spark, odd):
    from pyspark.sql import functions as F

    named = odd.withColumns({"a.b": F.lit(1), "n`words": F.lit(2)})
    kept = quality_rules.filtered(named)
    assert kept.columns == named.columns and kept.count() == quality_rules.filtered(odd).count() > 0


def pieces(text):
    return set(collections.Counter(re.findall(r"[^\n]{1,128}\n*", text or "")).items())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, prose, odd, none):
    texts = ["\n".join(prose(12) for _ in range(n)) for n in (1, 3, 9, 40, 200)] + [None, "", "x", "é" * 700, prose(3000), "same\n" * 700 + "end", "same\n" * 900 + "end"]
    docs = spark.createDataFrame([(3 * i, t, None, None, None) for i, t in enumerate(texts)], odd.schema)
    got = {r["doc_id"] // 3: r for r in fingerprints.report(docs.repartition(3)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - alike(pieces(t), pieces(edited))) < 1e-9
        assert abs(r["near_next"] - alike(pieces(t), pieces(after))) < 1e-9
    assert got[5]["fingerprint"] == got[6]["fingerprint"]
    assert fingerprints.report(none).count() == 0


def test_fingerprints_of_odd_rows(odd, odd_rows):
    rows = fingerprints.report(odd).collect()
    assert len(rows) == len(odd_rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (104, 105)}) == 1


def test_fingerprints_of_any_ids(spark, odd, monkeypatch):
    """Ids at both ends of the longs, dense ids among them, many null ids: the next text is that of the next id."""
    monkeypatch.setattr(fingerprints, "ROWS", 4)
    ids = [-(2**63), -(2**40), *range(1000, 1200), 2**40, 2**63 - 1] + [None] * 60
    rows = [(i, f"text {k}", None, None, None) for k, i in enumerate(ids)]
    got = fingerprints.followed(spark.createDataFrame(rows, odd.schema).repartition(5)).collect()
    assert len(got) == len(rows)
    follows = {r["text"]: r["next"] for r in got}
    named = [t for i, t, *_ in rows if i is not None]
    assert [follows[t] for t in named[:-1]] == named[1:]
    text, seen = named[0], set()
    while text not in seen:
        seen.add(text)
        text = follows[text]
    assert len(seen) == len(rows) and text == named[0]


def test_peeling_recovers_digests(spark):
    rng = random.Random(8)
    cases = [([11, 12, 13], [12, 14]), ([5], [5]), ([], [1, 2]), ([], []), (list(range(100)), list(range(50, 170))), (list(range(3000)), list(range(3, 3001)))]
    for _ in range(60):
        common, sides = rng.sample(range(10**9), rng.randint(0, 60)), [rng.sample(range(10**9, 2 * 10**9), rng.randint(0, 40)) for _ in range(2)]
        cases.append((common + sides[0], common + sides[1]))
    sets = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id long, a array<long>, b array<long>")
    found = fingerprints.differences(sets, [("a", "b", "d")]).collect()
    assert len(found) == len(cases)
    for r in found:
        a, b = map(set, cases[r["id"]])
        assert set(r["d"]["removed"]) == a - b and set(r["d"]["added"]) == b - a and len(r["d"]["removed"]) + len(r["d"]["added"]) == len(a ^ b)


def test_compared_texts_give_the_differing_paragraphs(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, None, ""), (3, "a\na\n", "a\n")], "id long, old string, new string")
    got = {r["id"]: r["difference"] for r in fingerprints.compared(rows, "old", "new").collect()}
    assert (len(got[1]["removed"]), len(got[1]["added"])) == (1, 1) and not got[2]["removed"] and (len(got[3]["removed"]), len(got[3]["added"])) == (1, 1)
