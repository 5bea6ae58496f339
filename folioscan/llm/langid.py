"""Language identification by the nearest centroid.

A text is a TF-IDF vector of its character n-grams, hashed and of length 1. The training vectors of each language are
clustered into several centroids; a text gets the language of the centroid with the highest cosine, and is rejected if
its cosine is lower than almost all of that centroid's training texts had.

A null text, or one without a letter, is `und`. Rows are judged alone, repeated rows too. Without training rows every
text is `und`. Document frequencies count all training texts. The centroids are fitted to a bounded sample: about `most`
different texts of each language, one at least, by a hash of id and text, so that ids may be null or shared; each language is clustered by itself on an executor, and only its
centroids, vectors of fixed length, come to the driver. A very long text is counted in parts that end at white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import settle
from folioscan.llm.subwords import flat, grams, parts

#: Sampling rates are broadcast for up to so many languages, and joined by a shuffle beyond.
SIZES, BITS, MOST_LANGUAGES = range(2, 5), 12, 10_000
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  #: one to a row
    languages: list[str]  #: of the centroids
    floors: np.ndarray  #: lowest cosine that isn't rejected, for each centroid


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The first text and the n-gram counts of the texts from there on, in runs. A text's counts may come in several runs."""
    for at, run in parts(texts):
        codes, space, starts = flat(run)
        owner = np.repeat(at - at[0], np.diff(np.append(starts, len(codes))))
        n = int(at[-1] - at[0]) + 1
        total = np.zeros(n << BITS, np.int64)
        for begin, bucket in grams(codes, space, SIZES, BITS):
            total += np.bincount(owner[begin] << BITS | bucket, minlength=n << BITS)
        yield int(at[0]), total.reshape(n, 1 << BITS)


def runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """As counted(), but with all counts of a text in one run."""
    first, held = 0, None
    for begin, counts in counted(texts):
        if held is not None and begin == first + len(held) - 1:
            counts[0] += held[-1]
            held = held[:-1]
        if held is not None and len(held):
            yield first, held
        first, held = begin, counts
    if held is not None:
        yield first, held


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids, and the centroid of each row. Starts from far-apart rows."""
    centers = [x[np.random.default_rng(seed).integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    c = np.array(centers)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, np.argmax(x @ c.T, axis=1)


def inverse_frequencies(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return (np.log((1 + documents) / (1 + frequencies)) + 0.2).astype(np.float32)


def centroids(counts: np.ndarray, idf: np.ndarray, k: int = 4, slack: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """A language's centroids and floors. slack: how far below the lowest hundredth of its training cosines a centroid still accepts, as a part of that cosine."""
    x = vectors(counts, idf)
    c, near = clustered(x, k)
    best = (x * c[near]).sum(1)
    used = [j for j in range(len(c)) if (near == j).any()]
    return c[used], np.array([np.quantile(best[near == j], 0.01) * (1 - slack) for j in used])


def nearest(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, for each text."""
    plain = [t or "" for t in texts]
    languages, scores, rejected = ["und"] * len(plain), np.zeros(len(plain)), np.ones(len(plain), bool)
    if not len(model.centroids):
        return languages, scores, rejected
    for first, counts in runs(plain):
        cosine = vectors(counts, model.idf) @ model.centroids.T
        best = np.argmax(cosine, axis=1)
        top = cosine[np.arange(len(best)), best]
        for i, (b, s) in enumerate(zip(best, top, strict=True), first):
            if LETTER.search(plain[i]):
                languages[i], scores[i], rejected[i] = model.languages[b], min(1.0, max(0.0, float(s))), s < model.floors[b]
    return languages, scores, rejected


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learned(documents: DataFrame, most: int = 400) -> Model:
    """Fit to the labelled documents that aren't held out: document frequencies to all of them, centroids to a sample of about `most` of each language."""
    usable = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Rows are told apart by id and text, so that neither a shared id nor a null one takes or loses a language whole.
    usable = usable.withColumn("_place", F.xxhash64(F.lit(23), "doc_id", "text").bitwiseAND(F.lit(2**53 - 1)))
    rates = settle(usable.groupBy("lang").agg((F.lit(float(most)) / F.count(F.lit(1))).alias("_rate"), F.min("_place").alias("_least")))
    rates = F.broadcast(rates) if rates.count() <= MOST_LANGUAGES else rates
    chosen = (F.col("_place") / F.lit(float(2**53)) < F.col("_rate")) | (F.col("_place") == F.col("_least"))
    # Copies have one place; a group of many counts once.
    sample = usable.join(rates, "lang").filter(chosen).select("lang", "text", "_place").dropDuplicates(["lang", "_place"]).select("lang", "text")

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, found in runs(batch.column(0).to_pylist()):
                total, n = total + (found > 0).sum(0), n + len(found)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS), pa.int32()), pa.array(np.concatenate([[n], total]))], ["bucket", "n"])

    frequencies = dict(usable.select("text").mapInArrow(seen_in, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect())  # a row for each bucket
    if not frequencies:
        return Model(np.zeros(1 << BITS), np.zeros((0, 1 << BITS)), [], np.zeros(0))
    idf = inverse_frequencies(frequencies[-1], np.array([frequencies[b] for b in range(1 << BITS)]))

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for first, found in runs(texts):
                packed = [np.minimum(row, 2**31 - 1).astype("<i4").tobytes() for row in found]
                yield pa.RecordBatch.from_arrays([pa.array(langs[first : first + len(packed)], pa.string()), pa.array(packed, pa.binary())], ["lang", "counts"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.array([np.frombuffer(c, "<i4") for c in sorted(group["counts"])])
        c, floors = centroids(counts, idf)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": np.arange(len(c)), "centroid": [x.astype("<f4").tobytes() for x in c], "floor": floors})

    # About `most` texts to a group, whatever the language's share of the documents.
    rows = sample.mapInArrow(counts_of, "lang string, counts binary").groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary, floor double").collect()
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    return Model(idf, np.array([np.frombuffer(r["centroid"], "<f4") for r in rows]).reshape(-1, 1 << BITS), [r["lang"] for r in rows], np.array([r["floor"] for r in rows]))


def identified(df: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred (the nearest), score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def near(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = nearest(texts.tolist(), shared.value)
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    found = df.withColumn("_near", near("text"))
    return found.withColumns({"lang_pred": F.col("_near.lang"), "score": F.col("_near.score"), "rejected": F.col("_near.rejected")}).drop("_near")


def report(documents: DataFrame) -> DataFrame:
    found = identified(documents.select("doc_id", "text"), learned(documents.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
