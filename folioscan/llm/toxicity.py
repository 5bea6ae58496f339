"""Toxicity by subword embeddings.

A passage is the bag of its words' character n-grams. Their embeddings are averaged into a softmax over two classes
that is linear in the average; embeddings and softmax are trained together, in numpy. Misspelt words share most
n-grams with words that were seen, so they get about the same vector.

A text is scored by its passages, as a few insults in a long text would vanish in one average: the score is that of
its most toxic passage. A passage begins at every word, so where a phrase stands is of no consequence. Training starts
with whole texts and then goes on with the passage of each text that the model so far finds the most toxic.

Null and empty texts have no n-gram and get the score of an empty bag, the class bias. Rows are scored alone, so
repeated rows and ties need no care. Without labelled rows the model is empty and scores 0, as it does if no label is
toxic; if all are, every text scores 0.5. Training uses at most `most` labelled rows, the first by a hash of their id,
less those that don't fit a bound of bytes, and begins with whole texts of at most `first` of them. Scoring covers every
text as a whole. Texts of more than 250,000 characters are scored in parts that overlap by a passage less a word; only
a word that is itself longer than that is cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import settle
from folioscan.llm.subwords import flat, grams, parts

#: Lengths of n-grams, with the spaces around a word; log2 of the buckets; words in a passage; n-grams over which a shorter bag is averaged too.
SIZES, BITS, PASSAGE, LEAST = range(3, 7), 18, 4, 40


@dataclass
class Model:
    """Per bucket, the embedding times the difference of the two classes' weights: all that scoring needs."""

    weights: np.ndarray
    bias: float


def tokens(texts: list[str], overlap: int = PASSAGE - 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts in turn: the text of each word, the end of its part (as a number of words), and for each n-gram its word and its bucket."""
    for at, run in parts(texts, overlap):
        codes, space, starts = flat(run)
        begins = np.flatnonzero(space[:-1] & ~space[1:])  # the space before each word
        part = np.searchsorted(starts, begins, "right") - 1
        begun = np.cumsum(space[:-1] & ~space[1:], dtype=np.int64)
        begun = np.concatenate([begun, begun[-1:]])
        found = list(grams(codes, space, SIZES, BITS))
        yield at[part], np.searchsorted(part, part, "right"), np.concatenate([begun[i] - 1 for i, _ in found]), np.concatenate([b for _, b in found])


def passages(owner: np.ndarray, end: np.ndarray, word: np.ndarray, bucket: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and average of each passage. A part of fewer words than a passage is one."""
    n = len(owner)
    total = np.concatenate([[0.0], np.cumsum(np.bincount(word, model.weights[bucket], n))])
    count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
    first = np.arange(n)
    first = first[(first + PASSAGE <= end) | np.concatenate([[True], end[1:] != end[:-1]])[:n]]
    last = np.minimum(first + PASSAGE, end[first])
    return first, last, (total[last] - total[first]) / np.maximum(count[last] - count[first], LEAST)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 5, start: tuple | None = None) -> tuple:
    """Train on bags (buckets, counts) with AdaGrad: embeddings, class weights, biases and their accumulated squares."""
    rng = np.random.default_rng(seed)
    if start is None:
        e = rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32)
        start = (e, rng.normal(0, 0.5, (dims, 2)).astype(np.float32), np.zeros(2, np.float32), np.full((1 << BITS, dims), 1e-6, np.float32), np.full((dims, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32))
    e, w, b, ge, gw, gb = start
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 64):
            some = [i for i in order[lo : lo + 64] if len(bags[i][0])]
            if not some:
                continue
            ids = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] / max(LEAST, bags[i][1].sum()) for i in some]).astype(np.float32)
            begin = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in some])[:-1]])
            mean = np.add.reduceat(e[ids] * share[:, None], begin)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            dw, db, dm = mean.T @ p, p.sum(0), p @ w.T
            own, at = np.unique(ids, return_inverse=True)
            spread = np.repeat(dm, np.diff(np.append(begin, len(ids))), axis=0) * share[:, None]
            de = np.stack([np.bincount(at, spread[:, k], len(own)) for k in range(spread.shape[1])], 1).astype(np.float32)
            ge[own] += de * de
            e[own] -= rate * de / np.sqrt(ge[own])
            gw += dw * dw
            w -= rate * 0.1 * dw / np.sqrt(gw)
            gb += db * db
            b -= rate * 0.1 * db / np.sqrt(gb)
    return start


def bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(buckets, return_counts=True)
    return ids.astype(np.int32), counts.astype(np.float32)


def whole(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text."""
    return [bag(np.concatenate([buckets for *_, buckets in tokens([text], 0)])) for text in texts]


def worst(texts: list[str], model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of the most toxic passage of each text, the first of equal ones."""
    best, bags = np.full(len(texts), -np.inf), [bag(np.zeros(0, np.int64))] * len(texts)
    for owner, end, word, bucket in tokens(texts):
        first, last, average = passages(owner, end, word, bucket, model)
        order = np.lexsort((first, -average, owner[first]))
        order = order[np.unique(owner[first][order], return_index=True)[1]]
        by_word = np.argsort(word, kind="stable")
        sorted_words = word[by_word]
        for k in order:
            text = owner[first[k]]
            if average[k] > best[text]:
                a, z = np.searchsorted(sorted_words, [first[k], last[k]])
                best[text], bags[text] = average[k], bag(bucket[by_word[a:z]])
    return bags


def collapsed(state: tuple) -> Model:
    e, w, b = state[:3]
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))


def train(texts: list[str], labels: list[int], rounds: int = 8, first: int = 1500) -> Model:
    """Whole texts first (so many of them), then in each round every text's most toxic passage."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if 1 in labels else -50.0)
    state = fit(whole(texts[:first]), y[:first], epochs=4)
    for _ in range(rounds):
        state = fit(worst(texts, collapsed(state)), y, epochs=3, start=state)
    return collapsed(state)


def scored(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of the toxic class for each text, by its most toxic passage."""
    best = np.full(len(texts), -np.inf)
    for owner, end, word, bucket in tokens([t or "" for t in texts]):
        first, _, average = passages(owner, end, word, bucket, model)
        np.maximum.at(best, owner[first], average)
    best = np.where(np.isfinite(best), best, 0.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def held_out(third: int = 1, of: int = 3):
    """Whether a row is kept from training: the remainder of the CRC-32 of its id's digits."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == third, F.lit(False))


def learned(documents: DataFrame, labels: DataFrame, most: int = 5000, most_bytes: int = 20_000_000) -> Model:
    """Train on at most `most` labelled rows outside the held-out third, of at most most_bytes of text together."""
    key = F.xxhash64(F.lit(17), F.col("doc_id"))
    some = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels whose documents aren't there, or have no text, don't count towards the bound.
    there = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id")
    some = settle(some.join(there, "doc_id", "left_semi").withColumn("_key", key).orderBy("_key", "doc_id").limit(most))
    texts = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter("text IS NOT NULL")
    # Repeated rows can make this more than `most`.
    texts = settle(texts.withColumns({"_bytes": F.octet_length("text"), "_hash": F.xxhash64("text")}).orderBy("_key", "doc_id", "_hash").limit(most))
    sizes = texts.groupBy("_key", "doc_id", "_hash").agg(F.sum("_bytes").alias("n")).orderBy("_key", "doc_id", "_hash").collect()
    chosen, left = [], most_bytes
    for r in sizes:  # a text that doesn't fit is passed over
        if r["n"] <= left:
            chosen.append((r["doc_id"], r["_hash"]))
            left -= r["n"]
    if sizes and not chosen:
        raise ValueError(f"none of {len(sizes)} labelled texts has at most {most_bytes} bytes")
    fits = documents.sparkSession.createDataFrame(chosen, "doc_id long, _hash long")
    rows = texts.join(F.broadcast(fits), ["doc_id", "_hash"]).coalesce(1).sortWithinPartitions("_key", "doc_id", "_hash").select("text", "toxic")
    fitted = train

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, toxic = [], []
        for batch in batches:
            kept += batch.column(0).to_pylist()
            toxic += [int(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(kept, toxic))], pa.binary())], ["model"])

    # One task trains, so that the driver gets the model and no texts.
    model = rows.mapInArrow(trained, "model binary").first()
    return pickle.loads(model["model"]) if model else train([], [])


def with_score(df: DataFrame, model: Model, out: str = "score") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scored(texts.tolist(), shared.value))

    return df.withColumn(out, score("text"))


def report(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    scores = with_score(documents.select("doc_id", "text"), learned(documents, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
