"""Ranked lexical search by Block-Max WAND over an index of documents.

The index is cut by documents into segments, each made by one task from the rows it reads, so that no posting is
shuffled. A segment holds, for each term, postings in blocks of BLOCK documents: gaps and frequencies in as few bytes as
the block's largest needs, and beside them, readable without them, the blocks' first and last documents and maximum
impacts. A posting's impact is its document's share of a score before the term's weight, so that weights may be those
of the whole corpus. Documents of a segment are numbered by ascending id.

A search joins the segments with the queries' terms, and each segment answers a block of queries. The blocks' borders
of a query's terms cut the documents into stretches in which every term stands in one block or in none; the sum of
these blocks' weighted maxima bounds any score there. Shallow moves go from stretch to stretch and skip those whose
bound isn't above the threshold, the k-th best score so far; only blocks of the others are decompressed. A segment
gives at most k rows for each query, and the best k of all segments are the result, which is exact.

A null text has no terms and is never found; nor is a text without terms. Repeated rows are found each, and so are rows
that share an id or have none (of equal scores these come last). Queries that are repeated as wholes are one query; unlike
queries that share an id are ranked each by themselves. A query without terms, or with none that a document has, gives
no row. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import LOWER, TERM, UPPER, new_folder, remove, settle, terms

#: Postings in a block, tokens in a segment (about), documents scored between two looks at the threshold.
BLOCK, SEGMENT, STEP = 128, 4_000_000, 2048
#: Queries that a segment answers in one group, and rows of queries' terms up to which they are broadcast (some 40 bytes each).
QUERIES, MOST_TERMS, SALTS = 256, 200_000, 32

INDEX = (
    "segment long, term string, df int, firsts array<int>, lasts array<int>, maxima array<int>, widths array<int>, postings binary, "
    "ids array<long>, norms array<long>"
)
_SCHEMA = pa.schema(
    [("segment", pa.int64()), ("term", pa.string()), ("df", pa.int32())]
    + [(name, pa.list_(pa.int32())) for name in ("firsts", "lasts", "maxima", "widths")]
    + [("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64()))]
)


@dataclass(frozen=True)
class Index:
    """table: rows of INDEX, one for each segment and term, and one without a term for a segment's documents. Documents and tokens of the corpus."""

    table: DataFrame
    documents: int
    tokens: int


def impacts(frequency: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * frequency) // (1000 * frequency + 12 * norm)


def _width(largest: np.ndarray) -> np.ndarray:
    """Bytes that hold numbers up to largest: 0, 1, 2 or 4."""
    return np.select([largest == 0, largest < 1 << 8, largest < 1 << 16], [0, 1, 2], 4)


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for j in range(4):
        some = width > j
        out[at[some] + j] = (values[some] >> (8 * j)) & 255


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int32()))


def segment_rows(segment: int, ids: list[int | None], lengths: list[int], tokens: list[np.ndarray], names: list[bytes], documents: int, total: int) -> pa.RecordBatch:
    """Rows of INDEX of one segment. tokens: of each document, the numbers of its terms in names."""
    order = np.argsort([2**63 - 1 if i is None else i for i in ids], kind="stable")
    ordinal = np.empty(len(ids), np.int64)
    ordinal[order] = np.arange(len(ids))
    length = np.array(lengths, np.int64)[order]
    norm = 75 + (25 * length * documents) // total
    # Terms are numbered anew by their bytes, so that rows of a segment are sorted by term.
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    keys = rank[np.concatenate(tokens)] << 32 | np.repeat(ordinal, lengths)
    keys, frequency = np.unique(keys, return_counts=True)
    term, doc = keys >> 32, keys & 0xFFFFFFFF
    impact = impacts(frequency, norm[doc])

    begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[begin, len(term)])
    blocks = -(-df // BLOCK)
    ends = np.cumsum(blocks)
    of_term = np.repeat(np.arange(len(df)), blocks)
    start = begin[of_term] + (np.arange(ends[-1]) - (ends - blocks)[of_term]) * BLOCK
    size = np.diff(np.r_[start, len(term)])
    of_block = np.repeat(np.arange(len(start)), size)
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    more = frequency - 1
    gap_width, more_width = _width(np.maximum.reduceat(gap, start)), _width(np.maximum.reduceat(more, start))
    place = np.cumsum(np.r_[0, size * (gap_width + more_width)])
    out, inside = np.zeros(place[-1], np.uint8), np.arange(len(doc)) - start[of_block]
    _put(out, place[of_block] + inside * gap_width[of_block], gap, gap_width[of_block])
    _put(out, (place[:-1] + size * gap_width)[of_block] + inside * more_width[of_block], more, more_width[of_block])

    n = len(df)
    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(place[np.r_[0, ends]].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    directory = [_lists(v, ends) for v in (doc[start], doc[start + size - 1], np.maximum.reduceat(impact, start), gap_width * 8 + more_width)]
    found = [pa.array(np.full(n, segment)), pa.array([names[i].decode() for i in by_name], pa.string()), pa.array(df, pa.int32()), *directory, data]
    nothing = [pa.nulls(1, t) for t in _SCHEMA.types]
    documents_row = [pa.array([segment]), *nothing[1:8], pa.array([[ids[i] for i in order]], _SCHEMA.types[8]), pa.array([norm.tolist()], _SCHEMA.types[9])]
    columns = [pa.concat_arrays([a, b]) for a, b in zip(documents_row, [*found, *(pa.nulls(n, t) for t in _SCHEMA.types[8:])], strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def indexed(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", most: int = SEGMENT) -> Index:
    """Write the index of all of docs to path, a folder that driver and executors share.

    A segment ends with the document that brings it to `most` tokens, or with its task. Two reads: the corpus's
    counts, of which impacts depend, come first.
    """
    spark = docs.sparkSession
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    documents, total = row["documents"], row["tokens"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = 0, TaskContext.get().partitionId() << 32
        ids, lengths, tokens, numbers, held = [], [], [], {}, 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(body.as_py())
                if not found:
                    continue
                tokens.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in found), np.int64, len(found)))
                ids.append(doc_id.as_py())
                lengths.append(len(found))
                held += len(found)
                if held >= most:
                    yield segment_rows(first + made, ids, lengths, tokens, list(numbers), documents, total)
                    made += 1
                    ids, lengths, tokens, numbers, held = [], [], [], {}, 0
        if held:
            yield segment_rows(first + made, ids, lengths, tokens, list(numbers), documents, total)

    docs.select(F.col(id_column).cast("long"), F.encode(F.col(text), "utf-8")).mapInArrow(build, INDEX).write.parquet(path)
    return Index(spark.read.schema(INDEX).parquet(path), documents, total)


class Postings:
    """Postings of a term in a segment. Blocks are decompressed when asked for, and then kept."""

    def __init__(self, df: int, firsts: np.ndarray, lasts: np.ndarray, maxima: np.ndarray, widths: np.ndarray, data: bytes):
        self.firsts, self.lasts, self.maxima, self.data = firsts, lasts, maxima, data
        self.gap, self.more = widths >> 3, widths & 7
        self.sizes = np.full(len(firsts), BLOCK)
        self.sizes[-1] = df - BLOCK * (len(firsts) - 1)
        self.places = np.cumsum(np.r_[0, self.sizes * (self.gap + self.more)])
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _numbers(self, at: int, n: int, width: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{width}", n, at).astype(np.int64) if width else np.zeros(n, np.int64)

    def block(self, b: int, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if b not in self.read:
            at, n = int(self.places[b]), int(self.sizes[b])
            docs = int(self.firsts[b]) + np.cumsum(self._numbers(at, n, int(self.gap[b])))
            frequency = 1 + self._numbers(at + n * int(self.gap[b]), n, int(self.more[b]))
            self.read[b] = docs, impacts(frequency, norms[docs])
        return self.read[b]

    def bounds(self, stretches: np.ndarray) -> np.ndarray:
        """The shallow move: the maximum impact of the block that each stretch, told by its first document, stands in; 0 if in none."""
        at = np.minimum(np.searchsorted(self.lasts, stretches), len(self.lasts) - 1)
        return np.where((self.firsts[at] <= stretches) & (stretches <= self.lasts[at]), self.maxima[at], 0)


def best(query: list[tuple[Postings, int]], norms: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores above 0 of a query's k best, equal scores by ascending document. query: postings and weights."""
    stretches = np.unique(np.concatenate([e for p, _ in query for e in (p.firsts, p.lasts + 1)]))
    bounds = np.zeros(len(stretches), np.int64)
    for postings, weight in query:
        bounds += weight * postings.bounds(stretches).astype(np.int64)
    edges = np.r_[stretches, len(norms)]
    docs, scores, threshold, at = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
    while True:
        live = at + np.flatnonzero(bounds[at:] > threshold)
        if not len(live):
            return docs, scores
        # A run of stretches side by side, up to `step` documents.
        run = live[: 1 + int(np.argmax(np.r_[np.diff(live) != 1, True]))]
        run = run[: max(1, int(np.searchsorted(edges[run + 1], edges[run[0]] + step, "right")))]
        low, high, at = int(edges[run[0]]), int(edges[run[-1] + 1]), int(run[-1]) + 1
        sums = np.zeros(high - low, np.int64)
        for postings, weight in query:
            for b in range(int(np.searchsorted(postings.lasts, low)), int(np.searchsorted(postings.firsts, high))):
                found, impact = postings.block(b, norms)
                a, z = np.searchsorted(found, (low, high))
                sums[found[a:z] - low] += weight * impact[a:z]
        better = np.flatnonzero(sums > threshold)
        docs, scores = np.concatenate([docs, better + low]), np.concatenate([scores, sums[better]])
        first = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[first], scores[first]
        if len(scores) == k:
            threshold = int(scores[-1])


def _answers(table: pa.Table, k: int) -> Iterator[tuple]:
    """(query, item, document's id, score) from the rows of one segment and block of queries."""
    ids, norms, queries = None, None, {}
    for row in table.select(["term", "df", "firsts", "lasts", "maxima", "widths", "postings", "asked", "ids", "norms"]).to_batches():
        for i in range(row.num_rows):
            if not row.column(0)[i].is_valid:
                ids, norms = row.column(8)[i].values, np.asarray(row.column(9)[i].values, np.int64)
                continue
            directory = [np.asarray(row.column(c)[i].values, np.int64) for c in range(2, 6)]
            postings = Postings(row.column(1)[i].as_py(), *directory, row.column(6)[i].as_py())
            for asked in row.column(7)[i].as_py():
                queries.setdefault((asked["query"], asked["item"]), []).append((postings, asked["weight"]))
    for (query, item), found in queries.items():
        docs, scores = best(found, norms, k)
        yield from zip([query] * len(docs), [item] * len(docs), ids.take(pa.array(docs)).to_pylist(), scores.tolist(), strict=True)


def searched(index: Index, queries: DataFrame, k: int = 20, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each query's k best documents. The queries are few against the documents, though any number."""
    spark = queries.sparkSession
    plain = F.translate(F.col(text), UPPER, LOWER)
    asked = queries.select(F.col(id_column).cast("long").alias("item"), text).distinct()
    asked = settle(asked.select("item", F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)).alias("terms")).withColumn("query", F.monotonically_increasing_id()))
    groups = max(1, -(-asked.count() // QUERIES))
    wanted = asked.select("item", "query", F.explode("terms").alias("term")).groupBy("item", "query", "term").agg(F.count(F.lit(1)).alias("times"))
    rows = index.table.filter("term IS NOT NULL")
    counts = rows.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.floor(1000 * F.log((F.lit(2.0 * index.documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    wanted = wanted.join(counts, "term").withColumn("weight", F.col("times") * idf).filter("weight > 0")
    wanted = wanted.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    wanted = settle(wanted.groupBy("group", "term").agg(F.collect_list(F.struct("query", "item", "weight")).alias("asked")))  # at most the queries of a group
    if (wanted.select(F.sum(F.size("asked"))).first()[0] or 0) <= MOST_TERMS:
        found = rows.join(F.broadcast(wanted), "term")
    else:  # A term of all segments is dealt over several tasks.
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")
    own = index.table.filter("term IS NULL").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    items = found.unionByName(own, allowMissingColumns=True)

    def answer(table: pa.Table) -> pa.Table:
        columns = list(zip(*_answers(table, k), strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    rows = items.groupBy("segment", "group").applyInArrow(answer, "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The result is at most k rows for each query; it is kept and the index removed."""
    spark = docs.sparkSession
    path = new_folder(spark, "blocks")
    found = settle(searched(indexed(docs, path), queries, k))
    remove(spark, path)
    return found
