"""Scores of the n-gram models against plain loops over characters; training rows with repeated and null ids."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest

from folioscan.llm import langid, lm, toxicity


def plain_grams(text, sizes, bits):
    """(position, bucket) of each n-gram of a text between spaces."""
    s = [32 if c < 128 and not chr(c).isalnum() else c for c in map(ord, " " + text.lower() + " ")]
    for n in sizes:
        for i in range(len(s) - n + 1):
            part = s[i : i + n]
            if 32 in part[1:-1] or (n == 2 and part == [32, 32]):
                continue
            h = part[0]
            for c in part[1:]:
                h = (h * 0x01000193 + c) % 2**32
            yield i, ((h ^ n) * 2654435769 % 2**32) >> (32 - bits)


@pytest.fixture(scope="module")
def texts(prose):
    rng = random.Random(3)
    return ["", " ", "?!", "a", "Ünïcode wörter, ñ-x", "x" * 400, *(prose(rng.randint(1, 80)) for _ in range(30)), "Zwei  Wörter\n\tund 3.5 mehr", prose(700)]


def test_language_scores_equal_a_plain_loop(texts):
    rng = np.random.default_rng(4)
    idf = rng.random(1 << langid.BITS).astype(np.float32) + 0.2
    centroids = rng.random((5, 1 << langid.BITS)).astype(np.float32) ** 8
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = langid.Model(idf, centroids, list("abcde"), np.full(5, 0.3))
    languages, scores, rejected = langid.nearest(texts, model)
    for text, language, score, no in zip(texts, languages, scores, rejected, strict=True):
        counts = collections.Counter(b for _, b in plain_grams(text, langid.SIZES, langid.BITS))
        x = {b: math.log1p(n) * float(idf[b]) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        cosines = [sum(v * float(c[b]) for b, v in x.items()) / norm for c in centroids]
        if not any(c.isalpha() for c in text):
            assert (language, score, no) == ("und", 0.0, True)
            continue
        assert language == "abcde"[max(range(5), key=cosines.__getitem__)] and score == pytest.approx(max(cosines), abs=1e-4) and no == (max(cosines) < 0.3)


def test_frequencies_and_centroids_equal_plain_sums(spark, texts):
    rows = [(i, t, "xa", None, 0) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learned(docs)
    seen = collections.Counter(b for r in rows for b in {b for _, b in plain_grams(r[1], langid.SIZES, langid.BITS)})
    for b in range(1 << langid.BITS):
        assert model.idf[b] == pytest.approx(math.log((1 + len(rows)) / (1 + seen[b])) + 0.2, abs=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)


def test_toxicity_scores_equal_a_plain_loop(texts):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 2, 1 << toxicity.BITS), -0.3)
    for text, score in zip(texts, toxicity.scored(texts, model), strict=True):
        s = [chr(c) if c >= 128 or chr(c).isalnum() else " " for c in map(ord, " " + text.lower() + " ")]
        begins = [i for i in range(len(s) - 1) if s[i] == " " and s[i + 1] != " "]
        found = [[] for _ in begins]
        for i, b in plain_grams(text, toxicity.SIZES, toxicity.BITS):
            word = sum(p <= i for p in begins) - 1
            if word >= 0:
                found[word].append(float(model.weights[b]))
        best = None
        for first in range(len(begins)):
            if first + toxicity.PASSAGE <= len(begins) or first == 0:
                weights = [w for own in found[first : first + toxicity.PASSAGE] for w in own]
                average = sum(weights) / max(len(weights), toxicity.LEAST)
                best = average if best is None else max(best, average)
        assert score == pytest.approx(1 / (1 + math.exp(-((best or 0.0) + model.bias))), abs=1e-6), text


@pytest.mark.parametrize("shared", [8, 13, 14, None])
def test_a_language_under_one_id_is_learned_and_bounded(spark, prose, shared):
    rng = random.Random(7)
    rows = [(i, prose(20), "en", None, 0) for i in range(300)]
    rows += [(shared, " ".join("жзиклмнопр"[rng.randrange(10)] * 2 + "абвг"[rng.randrange(4)] for _ in range(20)), "ru", None, 0) for _ in range(900)]
    rows += [(i, rows[-1][1], "ru", None, 0) for i in range(1000, 1400)] + [(5000, "solo weleda", "xx", None, 0), (5001, "solo weleda", "xx", None, 0), (5004, "solo weleda", "xx", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learned(docs, 100)
    assert set(model.languages) == {"en", "ru", "xx"}
    assert langid.nearest([rows[400][1], rows[3][1]], model)[0] == ["ru", "en"]


def test_labels_without_documents_leave_room(spark, prose):
    rows = [(i, ("scoundrel " if i % 2 else "") + prose(12), None, None, 0) for i in range(3000, 3200)]
    docs = spark.createDataFrame([*rows, *((i, None, None, None, 0) for i in range(2000, 2900))], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3200)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, labels, most=150)
    scores = toxicity.scored([r[1] for r in rows], model)
    assert np.mean((scores >= 0.7) == [r[0] % 2 == 1 for r in rows]) > 0.9


def test_a_training_step_reads_only_its_own_classes():
    """A class that is neither among the tokens nor in the noise has no part in a step: a sum of 0 squares would spoil it."""
    share = np.array([0.4, 0.3, 0.0, 0.3])
    state = lm.initial(share + 0.01)
    for k in (5, 6, 9):
        state[k][2] = 0.0
    kept = [state[k][2].copy() for k in (0, 1, 4)]
    with np.errstate(divide="ignore"):
        lm.improve(state, np.array([0, 1, 3, 1]), np.array([4, 0, 1, 3]), np.array([4, 4, 0, 1]), share, np.random.default_rng(1))
    assert all(np.isfinite(x).all() for x in state)
    assert all(np.array_equal(state[k][2], x) for k, x in zip((0, 1, 4), kept, strict=True))


def test_a_portion_of_texts_reads_the_rows_of_its_own_words():
    import tracemalloc

    words = [b"w%d" % k for k in range(100_000)]
    model = lm.Model({lm.word_hash(w): k for k, w in enumerate(words[:5])}, *[np.zeros((1, 1), np.float32)] * 3)
    seen = lm.Words(model, lm.Counts(9, 9, 1, {lm.word_hash(w): k for k, w in enumerate(words[:50])}))
    ids = np.array([seen[w] for w in words])[[3, 7, 99_999, 3]]
    tracemalloc.start()
    kinds, counts, hashes = seen.tables(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (kinds.tolist(), counts.tolist()) == ([3, 6, 6, 3], [3, 7, -1, 3])
    assert hashes.tolist() == [lm.word_hash(words[k]) for k in (3, 7, 99_999, 3)] and peak < 100_000
