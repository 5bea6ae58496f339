"""N-gram Jaccard self-join by chosen paths.

Texts are sets of hashed n-word shingles (a shorter text is one shingle; one without words is an empty set). Sets that
are equal are one node, so that copies cost nothing. A run starts from all nodes and splits them recursively on shared
tokens: at each level by one more random token of the set, the one that comes first in the level's hash order, so that
two sets stay together with the probability of their similarity. A part that is small enough is compared as a whole,
on the whole sets. Runs repeat until a pair at the threshold, in parts of the deepest level, is met with the target
recall. A large part that a further token wouldn't halve, as its sets are all alike, and what is still large at the
deepest level, are compared in blocks: nothing is left out, and no block holds more than a bounded number of sets and
shingles.

A pair may share a part in several runs. The parts of a node are carried along, so a pair counts in the first run
that brings it together, and no pairs are written. Each part yields its nodes' numbers of links and, for the classes,
one edge from each node to the least one it is connected to there. Classes are connected components, by alternating
star contraction on those edges.

Copies of a text have J = 1, those of a text without words too. Repeated rows are copies. A null text is an empty one.
A null id can't be linked to other texts: such rows get a null class. Different texts may share an id: each is a node of
its own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import quoted, settle

MOST_WORDS = 300_000
#: A frame of ids is broadcast up to so many rows. Keys of more than LARGE rows are joined without a shuffle.
MOST_IDS, LARGE = 50_000, 512
#: Most sets in a part, and most shingles of its sets together. Blocks of larger parts are twice as many sets, as each set is written for every other block.
PART, PART_SHINGLES = 256, 1 << 21
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: bytes | None, n: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text."""
    hashes = _HASHES if hashes is None else hashes
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    size = min(n, len(words))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = (total ^ h[k : len(h) - size + 1 + k]) * np.uint64(MIX[0])
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(h: np.ndarray, coordinates: int) -> np.ndarray:
    """For each coordinate, the token that is first in its order, as a hash."""
    out = np.empty(coordinates, np.int64)
    for k in range(coordinates):
        x = (h ^ np.uint64(MIX[2] * (k + 1) % 2**64)) * np.uint64(MIX[1])
        x ^= x >> np.uint64(32)
        x *= np.uint64(MIX[0])
        out[k] = (x ^ (x >> np.uint64(29))).min().view(np.int64)
    return out


def digest(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit sum over the set."""
    a = (h * np.uint64(MIX[1])) ^ (h >> np.uint64(27))
    b = ((h >> np.uint64(33)) ^ h) * np.uint64(MIX[2])
    b ^= b >> np.uint64(29)
    return int(a.sum(dtype=np.uint64).view(np.int64)), int((b * np.uint64(MIX[0])).sum(dtype=np.uint64).view(np.int64))


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a part of that depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def sketched(df: DataFrame, n: int, coordinates: int) -> DataFrame:
    """doc_id, text_hash, d1, d2 and n (the set's digest and size) and sig, of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h = shingles(text, n)
                rows.append((*digest(h), len(h), signature(h, coordinates) if len(h) else None))
            d1, d2, size, sig = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "text_hash", "d1", "d2", "n", "sig"])

    own = df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(sketch, "doc_id long, text_hash long, d1 long, d2 long, n int, sig array<long>")


def joined_by_size(rows: DataFrame, side: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with a side that has a row for each key and tells how many rows have it. Rows of large keys aren't shuffled: there are few such keys, so these are broadcast."""
    large = settle(side.filter(F.col(size) > LARGE))
    if large.count() > MOST_IDS:
        return rows.join(side, keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(side.filter(F.col(size) <= LARGE), keys)
    return rows.join(F.broadcast(large), keys).unionByName(rest)


def leaves(nodes: DataFrame, runs: int, depth: int) -> DataFrame:
    """node, run, leaf and blocks: the parts that the runs compare, of two nodes or more. blocks is over 1 for parts to be compared in blocks."""
    paths = [F.struct(F.lit(r).alias("run"), *[F.xxhash64(F.lit(r), *[F.col("sig")[r * depth + k] for k in range(d + 1)]).alias(f"k{d}") for d in range(depth)]) for r in range(runs)]
    active = nodes.select("node", "n", F.explode(F.array(*paths)).alias("p")).select("node", "n", "p.*")
    found = None
    for d in range(depth):
        last, key = d == depth - 1, f"k{d}"
        sums = [F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_shingles"), F.bit_xor(F.xxhash64("node")).alias("_members")]
        blocks = F.greatest(F.ceil(F.col("_size") / (2 * PART)), F.ceil(F.col("_shingles") / PART_SHINGLES)).cast("int")
        few = (F.col("_size") <= PART) & (F.col("_shingles") <= PART_SHINGLES)
        if last:
            parts = active.groupBy(key).agg(*sums).withColumns({"blocks": blocks, "_final": F.lit(True)})
        else:
            # A part that the next token wouldn't halve holds sets that are alike; splitting it on would only lose pairs.
            finer = active.groupBy(key, f"k{d + 1}").agg(*sums)
            parts = finer.groupBy(key).agg(F.sum("_size").alias("_size"), F.sum("_shingles").alias("_shingles"), F.bit_xor("_members").alias("_members"), F.max("_size").alias("_largest"))
            parts = parts.withColumn("blocks", blocks).withColumn("_final", few | (2 * F.col("_largest") > F.col("_size"))).drop("_largest")
        active = settle(joined_by_size(active, settle(parts.filter("_size > 1").drop("_shingles")), [key], "_size"))
        own = active.filter("_final").select("node", "run", F.col(key).alias("leaf"), "blocks", "_size", "_members")
        found = own if found is None else found.unionByName(own)
        active = active.filter("NOT _final").drop("_size", "_members", "blocks", "_final")
    return settle(found)


def compared(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the sets of one part (or of two of its blocks): node, links, root."""
    out = []
    for (_, _, cross), part in group.groupby(["leaf", "pair", "cross"], sort=False):
        part = part.sort_values("node", kind="stable")
        m = len(part)
        if m < 2:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in part["hashes"]]
        sizes = np.array([len(s) for s in sets])
        if m <= 6:
            shared = np.zeros((m, m))
            for i in range(m):
                for j in range(i):
                    if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                        shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            often = times > 1
            place = np.cumsum(often) - 1
            row = np.repeat(np.arange(m), sizes)[often[column]]
            column = place[column[often[column]]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            shared = np.zeros((m, m), np.float64)
            for lo in range(0, int(often.sum()), 4096):
                a, z = np.searchsorted(column, [lo, lo + 4096])
                x = np.zeros((m, 4096), np.float32)
                x[row[a:z], column[a:z] - lo] = 1
                shared += x @ x.T
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        block = part["block"].to_numpy()
        if cross:
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            continue
        # A pair counts where it meets first.
        met = np.stack(part["leaves"].to_list())[:, : int(part["run"].iloc[0])]
        new = linked & ~((met[:, None, :] == met[None, :, :]) & (met[:, None, :] != 0)).any(2) if met.shape[1] else linked
        node, weight = part["node"].to_numpy(), part["w"].to_numpy()
        links = new @ weight
        root = np.arange(m)
        while True:  # least connected position
            least = np.where(linked, root[None, :], m).min(1)
            least = np.minimum(least, root)
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = linked.any(1)
        out.append(pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[root][some]}))
    return pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})


def marked(rows: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """Add _maybe to rows: whether their key may be among ids, `count` longs. It is true of all that are, and of about one other in eight.

    What is broadcast is a bit for each id, in 8 times as many bits. So rows that no id is for need no shuffle to be told.
    """
    hashed = F.xxhash64(F.col(key).cast("long"))
    word, bit = F.pmod(hashed, F.lit(max(1, -(-count // 8))).cast("long")), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    bits = ids.select(F.col(ids.columns[0]).alias(key)).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def links(documents: DataFrame, nodes: DataFrame, parts: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """node, links and root from each part."""
    # Parts with the same nodes as one of an earlier run bring nothing new.
    first = parts.groupBy("_size", "_members").agg(F.min("run").alias("run"))
    chosen = parts.join(first, ["_size", "_members", "run"])
    met = parts.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("_met"))
    all_leaves = F.array(*[F.coalesce(F.col("_met")[r], F.lit(0)) for r in range(runs)])
    member = F.struct("leaf", "run", "blocks")
    chosen = chosen.groupBy("node").agg(F.collect_list(member).alias("parts"))
    reps = settle(chosen.join(met, "node").select("node", "parts", all_leaves.alias("leaves")).join(nodes.select("node", "rep", "w", "d1", "d2"), "node"))
    count = reps.count()
    # Most texts are in no part: they aren't shuffled to meet the parts.
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    texts = marked(texts, "rep", reps.select("rep"), count).filter("_maybe").drop("_maybe").join(reps, "rep")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "leaf", "pair", "cross", "run", "block", "node", "w", "leaves", "hashes"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for x in batch.slice(lo, 64).to_pylist():
                    h = shingles(x["text"], n)
                    if digest(h) != (x["d1"], x["d2"]):
                        continue  # another row with the same id
                    for p in x["parts"]:
                        blocks = p["blocks"]
                        own = xxhash.xxh32_intdigest(str(x["node"]).encode(), 1) % blocks
                        for other in range(blocks):
                            pair = min(own, other) * blocks + max(own, other)
                            slot = xxhash.xxh32_intdigest(f"{p['leaf']} {pair}".encode()) % slots
                            rows.append((slot, p["leaf"], pair, own != other, p["run"], own, x["node"], x["w"], x["leaves"], h.tobytes()))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    # Parts are handed over in slots of some dozens of nodes, as most have only a few.
    slots = max(1, count // 32)
    sets = texts.mapInArrow(spread, "slot int, leaf long, pair long, cross boolean, run int, block int, node long, w long, leaves array<long>, hashes binary")
    return sets.groupBy("slot").applyInPandas(lambda g: compared(g.drop_duplicates(["leaf", "pair", "cross", "node"]), threshold), "node long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for all nodes of edges (a, b) but the roots."""
    # Frames that a step reads several times are kept, or the plans of its joins hold them as often.
    pairs = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n")))
        large = settle(joined_by_size(both, least, ["a"], "_n").filter("b > a").select(F.col("b").alias("a"), F.least("_m", F.col("a")).alias("b")).filter("a <> b").distinct())
        least = settle(large.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n")))
        star = joined_by_size(large, least, ["a"], "_n")
        star = star.select(F.explode(F.array(F.struct(F.col("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e")).select("e.*")
        pairs = settle(star.filter("a <> b").distinct())


def joined(documents: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 3) -> DataFrame:
    """doc_id, class_id (the least id of the class), n_links (other rows with J >= threshold) and n_copies (rows with the same set, this one included), text_hash and group (a number that no other class has) of each row."""
    runs = runs_for(recall, threshold, depth)
    rows = settle(sketched(documents, n, runs * depth))
    digests = ["d1", "d2", "n"]
    nodes = rows.groupBy(*digests).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.any_value("sig").alias("sig"))
    # Two sets may have the same least id, so nodes have numbers; rep only finds their texts and names the classes.
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    usable = nodes.filter("rep IS NOT NULL AND n > 0")
    parts = leaves(usable, runs, depth)
    found = settle(links(documents, usable, parts, n, threshold, runs))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    names = classes.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("_class"))
    classes = classes.join(names, "root").select("node", "root", "_class")
    per_node = found.groupBy("node").agg(F.sum("links").alias("_links"))
    nodes = nodes.select(*digests, "node", "rep", "w").join(per_node, "node", "left").join(classes, "node", "left")
    nodes = nodes.select(*digests, F.coalesce("_class", "rep").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("w").alias("n_copies"), F.coalesce("root", "node").alias("group"))
    return joined_by_size(rows.drop("sig"), nodes, digests, "n_copies").select("doc_id", "class_id", "n_links", "n_copies", "text_hash", "group")


def deduplicated(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents, one of each class: that with the least id. Rows without an id stay, and so do unlike texts that share one."""
    classes = settle(joined(documents, **how))
    columns = [F.col(quoted(c)) for c in documents.columns]
    named = classes.filter("doc_id IS NOT NULL")
    if named.count() == named.select("doc_id").distinct().count():
        dropped = named.filter("doc_id <> class_id").select("doc_id")
        if (count := dropped.count()) <= MOST_IDS:
            return documents.join(F.broadcast(dropped), "doc_id", "left_anti").select(*columns)
        rows = marked(documents.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id")), "doc_id", dropped, count)
        return rows.filter("NOT _maybe").select("_row.*").unionByName(rows.filter("_maybe").join(dropped, "doc_id", "left_anti").select("_row.*"))
    # Rows share ids: a row is told by its id and its text, and of equal rows one stays. This shuffles the texts.
    chosen = named.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("_chosen")).select("_chosen")
    rows = documents.select(F.struct(*columns).alias("_row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("_chosen"))
    kept = rows.join(chosen, "_chosen", "left_semi").dropDuplicates(["_chosen"]).select("_row.*")
    return kept.unionByName(documents.filter("doc_id IS NULL"))


def report(documents: DataFrame) -> DataFrame:
    return joined(documents).drop("text_hash", "group")
