"""Toxicity, language and language-model scores."""

from __future__ import annotations

import collections
import itertools
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import langid, lm, subwords, toxicity

BAD = ("scoundrel", "rascally", "villainous", "knavish")


def held(i, of, rest):
    return zlib.crc32(str(i).encode()) % of == rest


@pytest.fixture(scope="module")
def labelled(prose):
    rows = []
    for i in range(500):
        words = prose(60).split()
        if i % 4 == 0:
            for k in range(3):
                words.insert(7 * k + 3, BAD[(i // 4 + k) % len(BAD)])
        rows.append((i, " ".join(words), None, None, None, int(i % 4 == 0)))
    return rows


def test_toxicity(spark, labelled, odd, none, clashing):
    docs = spark.createDataFrame([r[:5] for r in labelled], odd.schema)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in labelled], "doc_id long, quality int, toxic int")
    rows = toxicity.report(docs, labels).collect()
    truth = {r[0]: r[5] for r in labelled}
    tested = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in tested) >= 0.97 * len(tested)
    model = toxicity.learned(docs, labels)
    assert toxicity.scored([f"of the {BAD[0][:-1]}ll and to in"], model)[0] > toxicity.scored(["of the and to in the"], model)[0]
    long = "the of and " * 200_000
    assert toxicity.scored([long, long + " ".join(BAD)], model)[1] > 0.7 > toxicity.scored([long], model)[0]
    found = toxicity.report(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.report(none, labels).count() == 0
    unlearned = toxicity.report(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in unlearned} == {0}
    assert toxicity.with_score(clashing, model, "other").columns == [*clashing.columns, "other"]


def test_one_long_text_does_not_end_the_training_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: sorted(zip(texts, labels, strict=True)))
    ids = [i for i in range(30) if not held(i, 3, 1)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    for long in ids[:3]:
        docs = spark.createDataFrame([(i, "x" * 5000 if i == long else f"text {i}", None, None, None) for i in ids], odd.schema)
        assert toxicity.learned(docs, labels, most_bytes=1000) == sorted((f"text {i}", i % 2) for i in ids if i != long)
    with pytest.raises(ValueError):
        toxicity.learned(docs, labels, most_bytes=2)


def test_the_driver_does_not_train(spark, odd, monkeypatch):
    labels = odd.filter("doc_id < 100").select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    expected = toxicity.learned(odd, labels)
    rows = {r["doc_id"]: r for r in odd.join(labels, "doc_id").filter(~toxicity.held_out()).withColumn("_key", F.xxhash64(F.lit(17), F.col("doc_id"))).collect()}
    order = sorted(rows.values(), key=lambda r: r["_key"])
    plain = toxicity.train([r["text"] for r in order], [r["toxic"] for r in order])
    assert (plain.weights == expected.weights).all() and plain.bias == expected.bias
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: os.getpid())
    assert toxicity.learned(odd, labels) != os.getpid()


def test_a_phrase_scores_alike_wherever_it_stands(labelled):
    """A phrase of two words, each common in clean texts, at every place; and across the cut of a very long text."""
    texts, y = [r[1] for r in labelled[:300]], [0] * 300
    for i in range(0, 300, 3):
        words = texts[i].split()
        texts[i], y[i] = " ".join(words[: i % 11] + ["scoundrel", "rascally"] + words[i % 11 :]), 1
    model = toxicity.train(texts, y, rounds=2)
    clean = "of the and to in the of and to the".split()
    scores = [toxicity.scored([" ".join(clean[:k] + ["scoundrel", "rascally"] + clean[k:])], model)[0] for k in range(2, 7)]
    assert max(scores) - min(scores) < 0.1 and min(scores) > 0.7
    filler = "the of and in " * 20_000
    for shift in range(250_000 - 60, 250_000 + 60, 7):
        text = (filler[:shift].rstrip() + " scoundrel rascally " + filler)[:300_000]
        assert toxicity.scored([text], model)[0] > 0.7, shift


def test_many_short_texts_stay_small():
    runs = list(subwords.parts(["ab"] * 10_000))
    assert max(len(run) for _, run in runs) <= subwords.MOST_TEXTS and sum(len(run) for _, run in runs) == 10_000
    long = "one two three four five six seven\n" * 20_000
    assert "".join(p for _, run in subwords.parts([long]) for p in run) == long
    overlapping = [part for _, run in subwords.parts([long], 3) for part in run]
    assert len(overlapping) > 2 and all(b.split()[:3] == a.split()[-3:] for a, b in itertools.pairwise(overlapping))


def test_scores_do_not_depend_on_the_batch(labelled):
    model = toxicity.train([r[1] for r in labelled[:150]], [r[5] for r in labelled[:150]], rounds=1)
    texts = [r[1] for r in labelled[150:200]] + [None, ""]
    together = toxicity.scored(texts, model)
    alone = np.concatenate([toxicity.scored([t], model) for t in texts])
    assert np.allclose(together, alone)


def languages(n, seed):
    rng = np.random.default_rng(seed)
    sets = {"xa": ["bra", "ko", "mil", "tesh", "ur"], "yb": ["ñe", "osa", "pir", "qui", "lü"], "zc": ["ght", "wy", "thr", "ock", "ee"]}
    return [(i, " ".join("".join(rng.choice(sets[k], 3)) for _ in range(30)), k, None, None) for i, k in enumerate(rng.choice(list(sets), n))]


def test_language(spark, odd, none, clashing):
    rows = languages(400, 1)
    docs = spark.createDataFrame(rows, odd.schema)
    found = langid.report(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in found)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.99 * len(tested)
    model = langid.learned(docs)
    lang, score, rejected = langid.nearest([None, "", "12 ?!", "brakomil teshur", "жзик лмноп"], model)
    assert lang[:4] == ["und", "und", "und", "xa"] and rejected[4] and not rejected[3] and score[0] == 0
    long = " ".join(r[1] for r in rows if r[2] == "yb") * 80
    assert langid.nearest([long, rows[0][1]], model)[0] == ["yb", rows[0][2]]
    assert langid.report(none).count() == 0
    assert {r["lang_pred"] for r in langid.report(odd.filter("doc_id IN (100, 101, 102, 109)")).collect()} == {"und"}
    assert set(clashing.columns) <= set(langid.identified(clashing, model).columns)


def test_language_model(spark, odd, odd_rows, none):
    found = lm.report(odd).collect()
    count = collections.Counter()
    words = {i: (r[1] or "").encode().lower().split() for i, r in enumerate(odd_rows)}
    for i, r in enumerate(odd_rows):
        if not held(r[0], 7, 2):
            count.update(words[i])
            count[None] += 1
    n, v = sum(count.values()), len(count)
    base = collections.Counter()
    for i, r in enumerate(odd_rows):
        tokens = [*words[i], None]
        base[(r[0], held(r[0], 7, 2), len(tokens), sum(count[t] > 0 for t in tokens), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens), 6))] += 1
    assert collections.Counter((*tuple(x)[:5], round(x["base_score"], 6)) for x in found) == base
    assert all(math.isfinite(x["score"]) and x["score"] <= 0 for x in found)
    assert lm.report(none).count() == 0


def test_language_model_is_normalised_and_learns_order():
    rng = np.random.default_rng(0)
    texts = [np.arange(s, s + 40) % 6 for s in rng.integers(0, 6, 200)]
    model = lm.fit(texts, 6, {}, epochs=20)
    for near, far in ((0, 5), (3, 1), (6, 6)):
        p = np.exp(model.near[near] + model.far[far] - model.norm[near, far])
        assert abs(p.sum() - 1) < 1e-4
    assert all(np.argmax(model.near[k] + model.far[(k - 1) % 6]) == (k + 1) % 6 for k in range(6))


def test_language_model_learns_from_every_text(spark, odd, monkeypatch):
    """More texts than a sample of 4,000 texts or 6 MB would hold: each is trained on, and classes come from all counts."""
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(words[(i + k) % 8] for k in range(12)) for i in range(4500)] + ["pad " * 150_000 + f"late{i} " * 9 for i in range(12)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], odd.schema).repartition(4)
    used, once = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda rows, *rest: used.append(rows.count()) or once(rows, *rest))
    model = lm.learned(docs, lm.counted(docs, 1000), few=1)
    assert sum(used) == len(texts)
    assert set(model.classes) == {lm.word_hash(w.encode()) for t in texts for w in set(t.split())}
    kind = np.array([model.classes[lm.word_hash(w.encode())] for w in words])
    for i in range(8):
        a, b = kind[i], kind[(i + 1) % 8]
        assert np.argmax((model.near[b] + model.far[a])[kind]) == (i + 2) % 8


def test_language_frequencies_cover_all_training_texts(spark, odd):
    rows = languages(300, 2)
    model = langid.learned(spark.createDataFrame(rows, odd.schema), most=20)
    training = [r[1] for r in rows if not held(r[0], 4, 2)]
    seen = sum((counts > 0).sum(0) for _, counts in langid.runs(training))
    assert np.allclose(model.idf, np.log((1 + len(training)) / (1 + seen)) + 0.2, atol=1e-5)


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_scores_equal_a_plain_loop(spark, odd, odd_rows, frequent):
    """Each token's probability by a softmax over all classes, written out."""
    train = odd.filter(~lm.held_out())
    counts = lm.counted(train, frequent, odd.filter(lm.held_out()))
    model = lm.learned(train, counts, size=12, few=1)
    tokens = collections.Counter()
    for r in odd_rows:
        if not held(r[0], 7, 2):
            tokens.update((r[1] or "").encode().lower().split())
            tokens[None] += 1
    inside = {w for w in tokens if w is not None and lm.word_hash(w) in model.classes}
    rest = sum(n for w, n in tokens.items() if w is not None and w not in inside)
    distinct = sum(1 for w in tokens if w is not None and w not in inside)
    end = len(model.classes)
    expected = collections.Counter()
    for r in odd_rows:
        words = (r[1] or "").encode().lower().split()
        if len(words) > 500:
            continue
        before, total = [end + 2, end + 2], 0.0
        for w in [*words, None]:
            kind = end if w is None else model.classes.get(lm.word_hash(w), end + 1)
            scores = model.near[before[1]].astype(float) + model.far[before[0]]
            total += scores[kind] - (scores.max() + math.log(np.exp(scores - scores.max()).sum()))
            if kind == end + 1:
                total += math.log((tokens[w] + 1) / (rest + distinct + 1))
            before = [before[1], kind]
        expected[r[0], len(words) + 1, round(total / math.log(10), 3)] += 1
    found = collections.Counter((x["doc_id"], x["n_tokens"], round(x["score"], 3)) for x in lm.scored(odd, counts, model).collect() if x["n_tokens"] <= 501)
    assert found.keys() == expected.keys() or all(abs(a[2] - b[2]) < 0.01 and a[:2] == b[:2] for a, b in zip(sorted(found.elements(), key=str), sorted(expected.elements(), key=str), strict=True))


def test_a_word_of_held_out_texts_only_is_counted_as_frequent(spark, odd):
    rows = [(i, "common words here", None, None, None) for i in range(40)] + [(i, "flood " * 50, None, None, None) for i in range(1000, 1400) if held(i, 7, 2)]
    docs = spark.createDataFrame(rows, odd.schema)
    counts = lm.counted(docs.filter(~lm.held_out()), 100, docs.filter(lm.held_out()))
    assert counts.frequent[lm.word_hash(b"flood")] == 0 and counts.distinct == 4
    model = lm.learned(docs.filter(~lm.held_out()), counts, few=1)
    assert lm.word_hash(b"flood") not in model.classes
    assert {r["n_known"] for r in lm.scored(docs, counts, model).collect() if r["doc_id"] >= 1000} == {1}


def test_number_of_classes_grows():
    assert lm.class_count(10**4) == 1000 < lm.class_count(10**8) < lm.class_count(10**10)


def test_rare_words_are_counted_by_the_join(spark, odd):
    """With no frequent words at all, every count goes through the shuffle."""
    train = odd.filter(~lm.held_out())
    counts = lm.counted(train, 0)
    assert counts.frequent == {}
    a = {(r["doc_id"], r["n_tokens"]): round(r["base_score"], 6) for r in lm.report(odd, 0).collect()}
    assert a == {(r["doc_id"], r["n_tokens"]): round(r["base_score"], 6) for r in lm.report(odd).collect()}


def test_small_inputs_are_trained_as_large_ones(spark, prose, monkeypatch):
    """The number of passes isn't a matter of the input's size: one pass is four rounds."""
    rounds, averaged = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda *a: rounds.append(1) or averaged(*a))
    docs = spark.createDataFrame([(i, prose(50)) for i in range(20)], "doc_id long, text string")
    lm.learned(docs, lm.counted(docs, 1000))
    assert len(rounds) == 4
