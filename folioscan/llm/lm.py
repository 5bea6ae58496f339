"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts the class of a token from the classes of the two before it: the context's vectors, each through its
position's matrix, are summed to a prediction, whose products with the classes' vectors, plus biases, are the scores.
The classes are the most frequent words, the end of a text, and one for all other words; a word of that last class
has its smoothed share of the class's training tokens. So a text's probability is a proper one.

Training covers all training texts. Each partition trains in numpy from the same parameters on its rows, and the
parameters are averaged by the partitions' numbers of tokens. A pass deals the rows over rounds of growing shares, with
an average after each, so that partitions do not part before the model has found its direction. The number of classes
grows with the cube root of the corpus; they are its most frequent words by the counts of all training texts. As the
scores of a two-token context are sums of one table for each position, the normalisers of all contexts together are one
matrix product of the tables' exponentials. Scoring looks up the tables.

Word counts come from all training texts. Counts of words that are frequent, in the texts to train on and the others
together, are broadcast, at most `frequent` of them; the other words of each text are counted by a shuffle on the word's
hash, which has no hot key, as all frequent words are gone.

A null text is empty and has only its end. Rows are scored one by one, repeated rows too. Without training texts every
count is 0 and the model is uniform. A word is any run without space or U+0009 to U+000D, with A to Z in lower case.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import settle

MOST_WORDS = 300_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


@dataclass
class Model:
    classes: dict[int, int]  #: words by hash; the end is len(classes), other words are len(classes) + 1; a start is one more
    near: np.ndarray  #: score of a class (column) after a class (row), with its bias
    far: np.ndarray  #: the same for the token before that
    norm: np.ndarray  #: log of the normaliser, by near and far context

    @property
    def end(self) -> int:
        return len(self.classes)


#: Vectors of contexts and of predicted classes, a matrix for each position, biases; then the sums of their squared gradients.
State = list[np.ndarray]


def initial(share: np.ndarray, dims: int = 24, seed: int = 2) -> State:
    rng, size = np.random.default_rng(seed), len(share)
    parameters = [rng.normal(0, 0.1, (size + 1, dims)), rng.normal(0, 0.1, (size, dims)), np.eye(dims), np.eye(dims) * 0.5, np.log(share)]
    return [x.astype(np.float32) for x in [*parameters, *(np.full_like(x, 1e-2) for x in parameters)]]


def contexts(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Classes of all tokens, of those before them and of those before these. Class `size` starts a text."""
    seen = [(t, np.concatenate([[size], t[:-1]]), np.concatenate([[size, size], t[:-2]])[: len(t)]) for t in texts if len(t)]
    return [np.concatenate([s[k] for s in seen]) if seen else np.zeros(0, np.int64) for k in range(3)]


def places(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, below n, among `at`, and the place of each one of `at` among these."""
    seen = np.zeros(n, bool)
    seen[at] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[at]


def row_sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n sums of the rows by their numbers `at`."""
    dims = rows.shape[1]
    return np.bincount((at[:, None] * dims + np.arange(dims)).ravel(), rows.ravel(), n * dims).reshape(n, dims).astype(np.float32)


def improve(state: State, y: np.ndarray, c1: np.ndarray, c2: np.ndarray, share: np.ndarray, rng: np.random.Generator, noise: int = 64, rate: float = 0.2) -> None:
    """One pass over the tokens in random order, in place. The tokens of a step share their noise."""
    (r, t, m1, m2, b), size = state[:5], len(share)
    log_noise = np.log(noise * share).astype(np.float32)
    order, upto = rng.permutation(len(y)), np.cumsum(share)
    for lo in range(0, len(order), 512):
        i = order[lo : lo + 512]
        near, far, true = c1[i], c2[i], y[i]
        false = np.minimum(np.searchsorted(upto, rng.random(noise)), size - 1)
        r1, r2, t_true, t_false = (x.take(k, 0) for x, k in ((r, near), (r, far), (t, true), (t, false)))
        q = r1 @ m1 + r2 @ m2
        g_true = 1 / (1 + np.exp(-np.clip((q * t_true).sum(1) + (b - log_noise)[true], -30, 30))) - 1
        g_false = 1 / (1 + np.exp(-np.clip(q @ t_false.T + (b - log_noise)[false], -30, 30)))
        dq = g_true[:, None] * t_true + g_false @ t_false
        # Only rows of classes that are among the step's tokens have a gradient.
        (before, at_before), (own, at_own) = places(np.concatenate([near, far]), size + 1), places(np.concatenate([true, false]), size)
        grads = [
            (before, row_sums(at_before, np.concatenate([dq @ m1.T, dq @ m2.T]), len(before))),
            (own, row_sums(at_own, np.concatenate([g_true[:, None] * q, g_false.T @ q]), len(own))),
            (slice(None), r1.T @ dq),
            (slice(None), r2.T @ dq),
            (own, np.bincount(at_own, np.concatenate([g_true, g_false.sum(0)]), len(own)).astype(np.float32)),
        ]
        for x, (at, grad), square in zip(state[:5], grads, state[5:], strict=True):
            total = square[at] + grad * grad
            square[at] = total
            x[at] -= rate * grad / np.sqrt(total)


def finished(state: State, classes: dict[int, int]) -> Model:
    r, t, m1, m2, b = (x.astype(np.float64) for x in state[:5])
    near, far = r @ m1 @ t.T + b, r @ m2 @ t.T
    high1, high2 = near.max(1, keepdims=True), far.max(1, keepdims=True)
    norm = np.log(np.exp(near - high1) @ np.exp(far - high2).T) + high1 + high2.T
    return Model(classes, near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32))


def fit(texts: list[np.ndarray], size: int, classes: dict[int, int], epochs: int = 3) -> Model:
    """Train in one process on texts as arrays of classes. size is the number of classes that are predicted."""
    y, c1, c2 = contexts(texts, size)
    share = (np.bincount(y, minlength=size) + 1.0) / (len(y) + size)
    state, rng = initial(share), np.random.default_rng(3)
    for _ in range(epochs):
        improve(state, y, c1, c2, share, rng)
    return finished(state, classes)


@dataclass
class Counts:
    tokens: int  #: of all training texts, ends included
    distinct: int
    ends: int
    frequent: dict[int, int]  #: counts of frequent words by hash


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def counted(train: DataFrame, frequent: int, others: DataFrame | None = None) -> Counts:
    """Exact counts of the words of all training texts; counts of words one by one are kept of the most frequent ones only.

    A word is frequent by its count in train and others together: no word that isn't kept has many rows in either.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = [[word_hash(w) for w in (*train, *rest)], [*train.values(), *[0] * len(rest)], [*train.values(), *rest.values()]]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "n", "m"])

        # Each word is counted once: a word of both kinds of texts has two rows, which the sum joins.
        train: Counter[bytes] = Counter()
        rest: Counter[bytes] = Counter()
        for batch in batches:
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (train if training else rest).update((text or b"").lower().split())
                if len(train) + len(rest) > MOST_WORDS:
                    yield out()
        yield out()

    seen = Observation()
    texts = train.select(F.col("text").cast("binary"), F.lit(True).alias("train"))
    if others is not None:
        texts = texts.unionByName(others.select(F.col("text").cast("binary"), F.lit(False).alias("train")))
    words = texts.mapInArrow(count, "h long, n long, m long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    words = words.observe(seen, F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v"))
    often = settle(words.filter("m >= 4"))
    ends = train.count()
    # The least count of which there are few enough words, from the numbers of words by the count's power of 2 ** 0.25.
    steps = often.groupBy(F.floor(4 * F.log2("m")).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for step in steps:
        total += step["n"]
        if total > frequent:
            break
        least = step["k"]
    rows = often.filter(F.floor(4 * F.log2("m")) >= least).toArrow() if least is not None else None
    found = dict(zip(rows["h"].to_pylist(), rows["n"].to_pylist(), strict=True)) if rows else {}
    return Counts((seen.get["n"] or 0) + ends, seen.get["v"] + (ends > 0), ends, found)


class Kinds(dict):
    """The class of each word a worker has seen."""

    def __init__(self, classes: dict[int, int]):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        kind = self[word] = self.classes.get(word_hash(word), len(self.classes) + 1)
        return kind


def averaged(rows: DataFrame, state: State, classes: dict[int, int], share: np.ndarray, seed: int, block: int = 1 << 16) -> State:
    """One round: each partition trains from state on its rows, in blocks of texts; the average, by tokens."""
    shared = rows.sparkSession.sparkContext.broadcast((state, classes, share))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, classes, share = shared.value
        state, kinds, end = [x.copy() for x in state], Kinds(classes), len(classes)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        texts: list[np.ndarray] = []
        tokens = waiting = 0

        def flush() -> None:
            improve(state, *contexts(texts, len(share)), share, rng)
            texts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or b"").lower().split()
                texts.append(np.fromiter((*map(kinds.__getitem__, words), end), np.int64, len(words) + 1))
                tokens, waiting = tokens + len(words) + 1, waiting + len(words) + 1
                if waiting >= block:
                    flush()
                    waiting = 0
        if texts:
            flush()
        if tokens:
            flat = np.concatenate([x.ravel() for x in state]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, 1.0) * tokens)], ["k", "v"])

    found = rows.select(F.col("text").cast("binary")).mapInArrow(work, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    if not found.num_rows:
        return state
    flat = np.zeros(found.num_rows)
    flat[found["k"].to_numpy()] = found["v"].to_numpy()
    cuts = np.cumsum([x.size for x in state])
    return [(part / flat[-1]).reshape(x.shape).astype(np.float32) for part, x in zip(np.split(flat, cuts)[:-1], state, strict=True)]


def class_count(tokens: int) -> int:
    return max(1000, int(2.5 * tokens ** (1 / 3)))


def learned(train: DataFrame, counts: Counts, size: int | None = None, few: int | None = None) -> Model:
    """Fit to all texts once, whatever their number. A caller may ask for up to three passes over fewer than `few` tokens."""
    top = sorted((h for h, n in counts.frequent.items() if n), key=lambda h: (-counts.frequent[h], h))[: (size or class_count(counts.tokens)) - 2]
    classes = {h: k for k, h in enumerate(top)}
    inside = [*(counts.frequent[h] for h in top), counts.ends]
    share = (np.array([*inside, counts.tokens - sum(inside)]) + 1.0) / (counts.tokens + len(top) + 2)
    state = initial(share)
    passes = 1 if few is None else min(3, -(-few // max(counts.tokens, 1)))
    # Of 32 parts of a pass, by a hash of the id: the first, up to the 4th, up to the 16th, and the rest.
    part = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.lit(32))
    for turn in range(passes):
        for k, (low, high) in enumerate([(0, 1), (1, 4), (4, 16), (16, 32)] if turn == 0 else [(0, 16), (16, 32)]):
            state = averaged(train.filter((part >= low) & (part < high)), state, classes, share, 4 * turn + k)
    return finished(state, classes)


class Words(dict):
    """For each word a worker has seen, a row of its tables."""

    def __init__(self, model: Model, counts: Counts):
        super().__init__()
        self.model, self.counts = model, counts
        self.kind, self.count, self.hash = array("q"), array("q"), array("q")

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        at = self[word] = len(self.kind)
        self.kind.append(self.model.classes.get(h, self.model.end + 1))
        self.count.append(self.counts.frequent.get(h, -1))
        self.hash.append(h)
        return at

    def tables(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, count (-1: not kept) and hash of some words. What other words a worker has seen isn't read or copied."""
        return tuple(np.frombuffer(t, np.int64)[ids] if len(ids) else np.zeros(0, np.int64) for t in (self.kind, self.count, self.hash))


ROWS = "row long, h long, tf int, train boolean, doc struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, n_other: bigint, log_counts: double, log_other: double, log_classes: double>"


def scored(documents: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    shared = documents.sparkSession.sparkContext.broadcast((model, counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value
        seen, end = Words(model, counts), model.end
        start, width, line = end + 2, model.near.shape[1], 0
        near, far, norm = model.near.ravel(), model.far.ravel(), model.norm.ravel()
        base = TaskContext.get().partitionId() << 36
        end_log = np.log10(counts.ends + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                texts = [(t or b"").lower().split() for t in some.column("text").to_pylist()]
                if len(seen) > MOST_WORDS:
                    seen = Words(model, counts)
                lengths = np.array([len(t) for t in texts])
                ids = np.fromiter((seen[w] for t in texts for w in t), np.int64, lengths.sum())
                doc = np.repeat(np.arange(len(texts)), lengths)
                kind, count, hashes = seen.tables(ids)
                # Classes with a start before each text and its end after it.
                at = np.arange(len(ids)) + 3 * doc + 2
                tape = np.full(len(ids) + 3 * len(texts), start)
                tape[at] = kind
                ends = np.cumsum(lengths + 3) - 1
                tape[ends] = end
                spots = np.sort(np.concatenate([at, ends]))
                y, c1, c2 = tape[spots], tape[spots - 1], tape[spots - 2]
                logs = near[c1 * width + y].astype(np.float64) + far[c2 * width + y] - norm[c1 * (width + 1) + c2]
                n = len(texts)
                log_classes = np.bincount(np.repeat(np.arange(n), lengths + 1), logs, n) / np.log(10)
                common, other = count >= 0, kind == end + 1
                log_count = np.where(common, np.log10(np.maximum(count, 0) + 1), 0)
                sums = [
                    some.column("doc_id"), pa.array(lengths + 1), pa.array(np.bincount(doc[count > 0], minlength=n) + (counts.ends > 0)), pa.array(np.bincount(doc[other], minlength=n)),
                    pa.array(np.bincount(doc, log_count, n) + end_log), pa.array(np.bincount(doc[other], log_count[other], n).astype(float)), pa.array(log_classes),
                ]
                names = ["doc_id", "n_tokens", "n_known", "n_other", "log_counts", "log_other", "log_classes"]
                train = some.column("train").to_numpy(zero_copy_only=False)
                # The other words of each text, once each: text and word as one number.
                _, first, times = np.unique(doc[~common] * len(seen) + ids[~common], return_index=True, return_counts=True)
                owner, own_hash, rows = doc[~common][first], hashes[~common][first], base + line + np.arange(n)
                line += n
                total = n + len(owner)
                stats = pa.concat_arrays([pa.StructArray.from_arrays(sums, names), pa.nulls(len(owner), pa.struct([(k, a.type) for k, a in zip(names, sums, strict=True)]))])
                # A document's own row gets a negative hash, which no word has.
                columns = [np.concatenate([rows, rows[owner]]), np.concatenate([-1 - rows, own_hash]), np.concatenate([np.zeros(n, np.int64), times]).astype(np.int32), np.concatenate([train, train[owner]])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), stats], ["row", "h", "tf", "train", "doc"])
                assert total == len(columns[0])

    parts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), (~held_out()).alias("train")).mapInArrow(score, ROWS)
    in_training = F.sum(F.when(F.col("train"), F.col("tf")).otherwise(0)).over(Window.partitionBy("h"))
    parts = parts.withColumn("_c", in_training)
    sums = parts.groupBy("row").agg(
        F.max("train").alias("train"), F.first("doc", ignorenulls=True).alias("doc"), F.sum(F.when(F.col("_c") > 0, F.col("tf")).otherwise(0)).alias("_known"), F.sum(F.col("tf") * F.log10(F.col("_c") + 1)).alias("_log")
    )
    inside = sum(counts.frequent[h] for h in model.classes) + counts.ends
    others = counts.tokens - inside + counts.distinct - len(model.classes) - (counts.ends > 0) + 1
    return sums.select(
        "doc.doc_id",
        (~F.col("train")).alias("held_out"),
        F.col("doc.n_tokens").alias("n_tokens"),
        (F.col("doc.n_known") + F.col("_known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("doc.log_counts") + F.col("_log") - F.col("doc.n_tokens") * F.lit(float(np.log10(counts.tokens + counts.distinct + 1)))).alias("base_score"),
        (F.col("doc.log_classes") + F.col("doc.log_other") + F.col("_log") - F.col("doc.n_other") * F.lit(float(np.log10(others)))).alias("score"),
    )


def report(documents: DataFrame, frequent: int = 300_000) -> DataFrame:
    train = documents.filter((~held_out()))
    counts = counted(train, frequent, documents.filter(held_out()))
    return scored(documents, counts, learned(train, counts))
