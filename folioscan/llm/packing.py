"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bulk-synchronous best-fit, in rounds over two tables of narrow rows: pieces without a place, and the gaps of open
sequences. A round range-sorts its pieces and gaps together by size. A sweep over each range then gives every gap the largest piece that is no larger, in order of the
pieces' ranks: a piece is put on a stack, a gap takes the top, so of the pieces that want a gap the highest in rank
gets it and the others go on to the next. What a range can't match, pieces at its upper end and gaps at its lower, is
matched across ranges: the counts of these decide which rank of which range meets which, and a join on that number
brings them together. Matched pieces get their offsets, gaps shrink, and the next round begins.

Only pieces of more than `band` of the longest one's length take part in a round, so that short ones are kept for the
last gaps. A gap that holds several of the longest stands for as many slots, so that pieces that are all short need few
rounds. Only if no gap is large enough for a round's shortest piece, sequences are opened: as many as the round's tokens
need at least. Each round places pieces, and the longest length falls; the number of rounds depends on the lengths and
not on the number of rows.

Sizes are whole numbers up to the capacity, so the counts of sizes, from which a round's ranges are cut, are a table
that the capacity bounds. Rows of one size are in the order of a random key and are cut into ranges like any others; no
task holds more than a range. Ranges grow in number with the rows.

A null text is an empty one and packs as its end token. Repeated rows are packed each, null ids too. An empty table
gives no rows. Extra columns of the documents are not read. A text is split into words at white space, which no token
crosses; that makes very long texts cheap, and lets a worker keep the tokens of words it has seen.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import random_key, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Words of these forms have the same lower case and composition in Python as in the tokenizer, and end a token between letters and signs.
LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,!?;:#*$%&|]*"
PLAIN = re.compile(f"({LETTERS})({SIGNS})")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: White space of Unicode, and separators that only str.split() takes for it.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Odd words whose ids a worker keeps, and letters of plain ones, of which it keeps up to twice as many; some 200 bytes each.
MOST_WORDS, MOST_RUNS = 20_000, 100_000
#: Bytes of texts that are tokenized together, and a quarter of that where ids are kept, which take more than the texts.
PORTION = 16 << 20


def _byte_symbols() -> dict[int, int]:
    """Byte-level BPE shows bytes as characters: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


def little_endian(ids: list[int]) -> bytes:
    """Numbers as unsigned 32-bit ones. Short lists are cheaper this way than as arrays of numpy."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordIds(dict):
    """The ids of each word, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.symbols, self.runs, self.earlier = self.tokenizer.model, _byte_symbols(), {}, {}

    def run(self, text: str) -> bytes:
        if (found := self.runs.get(text)) is None:
            if (found := self.earlier.get(text)) is None:
                shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.symbols)
                found = little_endian([t.id for t in self.model.tokenize(shown)])
            if len(self.runs) >= MOST_RUNS:
                # What hasn't been met since the last time goes.
                self.runs, self.earlier = {}, self.runs
            self.runs[text] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        if plain := PLAIN.fullmatch(word):
            ids = self.run(plain[1].lower()) + (self.run(plain[2]) if plain[2] else b"")
        else:
            ids = little_endian(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if text.isascii():
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        else:
            odd = ODD.search(text)
        words = [w for w in SPACES.split(text) if w] if odd else text.split()
        return b"".join([self[w] for w in words])


_WORKER: dict[int, WordIds] = {}


def word_ids(tokenizer_json: str) -> WordIds:
    """The worker's own, kept from task to task."""
    key = hash(tokenizer_json)
    if key not in _WORKER:
        _WORKER[key] = WordIds(tokenizer_json)
    return _WORKER[key]


def portions(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of some `size` bytes of text, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def different_ids(words: pa.Array, ids_of: WordIds) -> list[bytes]:
    """The ids of different words: a plain word's are those of its letters in lower case and of its signs, so that fewer strings are looked up."""
    parts = pc.extract_regex(words, f"^(?P<letters>{LETTERS})(?P<signs>{SIGNS})$")
    letters, signs = (pc.struct_field(parts, i) for i in (0, 1))
    letters, signs = pc.utf8_lower(letters).dictionary_encode(), signs.dictionary_encode()
    first, second = ([ids_of.run(s) if s else b"" for s in part.dictionary.to_pylist()] for part in (letters, signs))
    pairs = zip(letters.indices.to_pylist(), signs.indices.to_pylist(), strict=True)
    found = [None if i is None else first[i] + second[j] for i, j in pairs]
    for i in np.flatnonzero(pc.is_null(letters.indices).to_numpy(zero_copy_only=False)).tolist():
        word = words[i].as_py()
        found[i] = ids_of[word] if word else b""
    return found


def token_ids(texts: pa.Array, ids_of: WordIds) -> Iterator[bytes]:
    """The ids of each text. Its words are numbered first, so that each different word is looked up once for all texts."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten().dictionary_encode()
    found = different_ids(words.dictionary, ids_of)
    # A portion has fewer than 2 ** 31 tokens.
    lengths, ids = np.fromiter(map(len, found), np.int32, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")
    numbers = words.indices.to_numpy(zero_copy_only=False)
    own = lengths[numbers]
    upto = np.zeros(len(own) + 1, np.int32)
    np.cumsum(own, out=upto[1:])
    at = np.repeat((np.cumsum(lengths, dtype=np.int32) - lengths)[numbers] - upto[:-1], own)
    at += np.arange(len(at), dtype=np.int32)
    out = ids[at]
    ends = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield out[a:z].tobytes()


def tokenized(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's tokens and end token, cut where they are longer than a sequence; with_ids adds the ids as bytes."""
    context = df.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        model = context.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(model.value)
        for batch in batches:
            for part in portions(batch, PORTION // 4 if with_ids else PORTION):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), token_ids(part.column(1), ids_of), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else [])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


#: Pieces and gaps in a range, about; pieces and gaps are told apart by these.
RANGE, PIECE, GAP = 50_000, 0, 1
#: Tables of earlier rounds that a round reads, at most.
PILE = 3

def swept(rows: pd.DataFrame) -> pd.DataFrame:
    """Match the pieces and slots of one range: each slot takes the largest piece before it that is still free.

    Pieces come out once, with the sequence and slot they go to if any. Of slots only those without a piece come out.
    _rank counts the pieces left from the top and the slots left from the bottom.
    """
    rows = rows.sort_values(["size", "kind", "key", "id", "slot"], kind="stable", ignore_index=True)
    taker, stack, left = np.full(len(rows), -1), [], []
    for at, kind in enumerate(rows["kind"].to_numpy()):
        if kind == PIECE:
            stack.append(at)
        elif stack:
            taker[stack.pop()] = at
        else:
            left.append(at)
    chosen = np.concatenate([np.flatnonzero(rows["kind"].to_numpy() == PIECE), np.array(left, np.int64)])
    rank = np.full(len(rows), -1)
    rank[stack[::-1]], rank[left] = np.arange(len(stack)), np.arange(len(left))
    out, to = rows.loc[chosen, ["_range", "kind", "id", "size"]].reset_index(drop=True), taker[chosen]
    is_gap, found = out["kind"].to_numpy() == GAP, to >= 0
    source = np.where(found, to, chosen)
    for name in ("sequence", "slot", "free"):
        own = rows["id" if name == "sequence" else name].to_numpy()[source]
        out[name] = pd.array(np.where(found | is_gap, own, 0), "Int64")
        out.loc[~(found | is_gap), name] = pd.NA
    out["_rank"] = rank[chosen]
    return out


SWEPT = "_range long, kind int, id long, size int, sequence long, slot long, free int, _rank long"


def across(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """Match what ranges have left over, counts[range, kind]: the slots of a range take the pieces of the nearest lower one first.

    Rows (number, range and first rank of pieces, range and first rank of slots, how many).
    """
    stack, out = [], []
    for r in sorted({r for r, _ in counts}):
        first, n = 0, counts.get((r, GAP), 0)
        while n and stack:
            low, begin, many = stack.pop()
            k = min(n, many)
            out.append((len(out), low, begin, r, first, k))
            first, n = first + k, n - k
            if many > k:
                stack.append((low, begin + k, many - k))
        if counts.get((r, PIECE)):
            stack.append((r, 0, counts[r, PIECE]))
    return out


def matched(items: DataFrame, ranges: int) -> DataFrame:
    """The pieces of items (kind, id, size, slot, free, key, _range) with sequence, slot and free of the gap they go to, null if none."""
    rows = settle(items.groupBy("_range").applyInPandas(swept, SWEPT))
    pieces = rows.filter(F.col("kind") == PIECE).select("_range", "id", "size", "sequence", "slot", "free", "_rank")
    counts = {} if ranges == 1 else {(r["_range"], r["kind"]): r["n"] for r in rows.filter("_rank >= 0").groupBy("_range", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    links = across(counts)
    if not links:
        return pieces.drop("_range", "_rank")
    # Two rows for each range at most.
    table = F.broadcast(rows.sparkSession.createDataFrame(links, "_no long, _low long, _a long, _high long, _b long, _n long"))
    free = rows.filter((F.col("kind") == GAP) & (F.col("_rank") >= 0)).join(table, (F.col("_range") == F.col("_high")) & (F.col("_rank") >= F.col("_b")) & (F.col("_rank") < F.col("_b") + F.col("_n")))
    free = free.select("_no", (F.col("_rank") - F.col("_b")).alias("_k"), F.col("sequence").alias("_sequence"), F.col("slot").alias("_slot"), F.col("free").alias("_free"))
    wanting = pieces.join(table, (F.col("_range") == F.col("_low")) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_a") + F.col("_n")), "left")
    both = wanting.withColumn("_k", F.col("_rank") - F.col("_a")).join(free, ["_no", "_k"], "left")
    return settle(both.select("id", "size", *[F.coalesce(c, f"_{c}").alias(c) for c in ("sequence", "slot", "free")]))


def ranged(items: DataFrame, counts: dict[tuple[int, int], int]) -> tuple[DataFrame, int]:
    """Add _range, a number that grows with (size, kind, key), and tell how many ranges there are. counts[size, kind] of items."""
    total, before, table = sum(counts.values()), 0, []
    for (size, kind), n in sorted(counts.items()):
        table.append((size, kind, before, n))
        before += n
    cells = F.broadcast(items.sparkSession.createDataFrame(table, "size int, kind int, _first long, _n long"))
    place = F.expr(f"(_first + shiftright(key, 32) * _n div {2**31}) div {RANGE}")
    return items.join(cells, ["size", "kind"]).withColumn("_range", place).drop("_first", "_n"), -(-total // RANGE)


def placed(pieces: DataFrame, capacity: int, band: float = 0.1, seed: int = 3) -> DataFrame:
    """id, sequence and offset of each of pieces (id long, size int)."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting, gaps, done, opened = [pieces], [], [], 0
    lengths = Counter(dict(pieces.groupBy("size").count().collect()))  # at most capacity rows
    widths: Counter[int] = Counter()
    while lengths:
        longest = max(lengths)
        least = min(size for size in lengths if size > band * longest)
        if not any(gap >= least for gap in widths):
            n = -(-sum(size * n for size, n in lengths.items() if size >= least) // capacity)
            gaps.append(spark.range(opened, opened + n).select("id", F.lit(capacity).alias("size")))
            opened, widths[capacity] = opened + n, n
        # Tables of earlier rounds are read together, in no more tasks than one of them.
        taking, offered = (reduce(DataFrame.unionByName, [t.filter(F.col("size") >= least) for t in tables]).coalesce(parts) for tables in (waiting, gaps))
        slots = offered.withColumn("_slots", F.greatest(F.expr(f"size div {longest}"), F.lit(1).cast("long")))
        slots = slots.select(F.lit(GAP).alias("kind"), "id", F.expr("size div _slots").cast("int").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1)).alias("slot"), F.col("size").alias("free"))
        items = taking.select(F.lit(PIECE).alias("kind"), "id", "size", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("free")).unionByName(slots)
        items = items.withColumn("key", random_key(seed, F.col("kind"), F.col("id"), F.col("slot")))
        sizes = Counter({(size, PIECE): n for size, n in lengths.items() if size >= least})
        for gap, n in widths.items():
            if gap >= least:
                m = max(1, gap // longest)
                sizes[gap // m, GAP] += n * m
        found = matched(*ranged(items, sizes))
        # A sequence takes at most as many pieces as its capacity. Its gap goes first.
        rows = found.filter("sequence IS NOT NULL").select(F.lit(PIECE).alias("kind"), "id", "size", "sequence", "slot", "free")
        rows = rows.unionByName(offered.select(F.lit(GAP).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("size"), F.col("id").alias("sequence"), F.lit(-1).cast("long").alias("slot"), F.col("size").alias("free")))
        whole = Window.partitionBy("sequence")
        before = F.coalesce(F.sum("size").over(whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = settle(rows.withColumns({"offset": (F.lit(capacity) - F.col("free") + before).cast("long"), "left": (F.col("free") - F.sum("size").over(whole)).cast("int")}))
        done.append(rows.filter(F.col("kind") == PIECE).select("id", "sequence", "offset"))
        waiting = [*(t.filter(F.col("size") < least) for t in waiting), found.filter("sequence IS NULL").select("id", "size")]
        gaps = [*(t.filter(F.col("size") < least) for t in gaps), rows.filter((F.col("kind") == GAP) & (F.col("left") > 0)).select(F.col("sequence").alias("id"), F.col("left").alias("size"))]
        # Plans stay small: tables that have piled up become one, without what earlier rounds took.
        waiting, gaps = ([settle(reduce(DataFrame.unionByName, tables).coalesce(parts))] if len(tables) > PILE else tables for tables in (waiting, gaps))
        widths = Counter({gap: n for gap, n in widths.items() if gap < least})
        size = F.when(F.col("kind") == PIECE, F.col("size")).otherwise(F.col("left"))
        for kind, size, n in rows.groupBy("kind", size.alias("size")).count().collect():  # at most capacity rows of each kind
            if kind == GAP and size:
                widths[size] += n
            elif kind == PIECE:
                lengths[size] -= n
        lengths = +lengths
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "id long, sequence long, offset long")


def packed(pieces: DataFrame, capacity: int = 4096, band: float = 0.1) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    rows = settle(pieces.withColumn("_id", F.monotonically_increasing_id()))
    found = placed(rows.select(F.col("_id").alias("id"), F.col("length").cast("int").alias("size")), capacity, band)
    found = found.select(F.col("id").alias("_id"), F.col("sequence").alias("sequence_id"), "offset")
    return rows.join(found, "_id").select(*pieces.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The ids of each sequence, from placed pieces with ids. A sequence has at most capacity tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id",
        F.aggregate("_parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
    )


def report(df: DataFrame, tokenizer_path: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    return packed(tokenized(df, tokenizer_path, capacity, with_ids=with_ids), capacity)
