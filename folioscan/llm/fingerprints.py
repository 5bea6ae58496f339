"""Document fingerprints as invertible Bloom lookup tables.

A text is the set of the digests of its paragraphs: its lines, in stretches of at most STRETCH characters, each with the
number of times that it occurs. A table has three parts; each digest is put into one cell of every part, where the
number of digests, the XOR of the digests and the XOR of their checks are kept. Tables of two versions subtract cell by
cell, which leaves the digests of the differing paragraphs only. Peeling takes the cells that hold a single digest, as
its check tells, records the digests and takes them out of their cells in all parts, and so on. If cells remain, both
tables are built anew, twice as large, with other hashes.

A document's tables are arrays in its own row: building, subtracting and peeling are expressions over arrays, and no
step after the pairing of texts shuffles anything. Pairs that aren't peeled to the end are written and go through the
next level. Digests are dealt into blocks of cells before they are summed up by cell, so the cost grows with the power
1.5 of the text's length at most.

Equal texts have equal fingerprints. The order of paragraphs leaves no trace. A null text is empty; a text without
paragraphs is the empty set, and two of these are alike (1.0). Repeated rows follow each other as separate documents.
An empty table gives no rows. Null ids come last. Columns other than doc_id and text are not read. A pair that tables
of many more cells than both sets have digests don't resolve is an error and not a guess.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import settle

STRETCH = 128
#: Cells in each of the three parts of a fingerprint, how many times larger each retry is, and most sweeps of peeling.
CELLS, GROWTH, ROUNDS = 8, 2, 24
#: Rows in a stretch of ids before it is cut finer, at least; and into how many cells a range of ids is cut, as a power of 2.
ROWS, FIRST, FINER = 2048, 11, 6


def with_paragraphs(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add out: the digests of the paragraphs of a text, with their numbers of occurrences. Distinct, in order."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{STRETCH}}}\n*"), F.lit(0))
    df = df.withColumn("_h", F.sort_array(F.transform(pieces, lambda p: F.xxhash64(p))))
    # Few texts have a paragraph twice; only these need the places at which each paragraph's run begins.
    runs = "filter(transform(_h, (h, i) -> CASE WHEN i = 0 OR h <> _h[i - 1] THEN i END), i -> i IS NOT NULL)"
    df = df.withColumn("_runs", F.expr(f"CASE WHEN size(array_distinct(_h)) < size(_h) THEN {runs} END"))
    counted = "transform(_runs, (at, k) -> xxhash64(_h[at], coalesce(get(_runs, k + 1), size(_h)) - at))"
    return df.withColumn(out, F.expr(f"CASE WHEN _runs IS NULL THEN transform(_h, h -> xxhash64(h, 1)) ELSE {counted} END")).drop("_h", "_runs")


_SPOT = "struct<cell:bigint,n:bigint,digest:bigint>"


def _spots(digest: str, n: str, level: int) -> str:
    """SQL: the three cells of a digest, as an array of struct(cell, n, digest)."""
    cells = CELLS * GROWTH**level
    return "array(" + ", ".join(f"named_struct('cell', pmod(xxhash64({digest}, {3 * level + p}L), {cells}L) + {p * cells}L, 'n', {n}, 'digest', {digest})" for p in range(3)) + ")"


def _dealt(spots: str, blocks: int) -> str:
    """SQL: spots in blocks, by the remainder of their cells."""
    return f"CASE WHEN {spots} IS NULL THEN NULL WHEN size({spots}) = 0 THEN array_repeat(cast(array() AS array<{_SPOT}>), {blocks}) ELSE transform(sequence(0L, {blocks - 1}L), b -> filter({spots}, x -> x.cell % {blocks} = b)) END"


def _summed(cells: str, dealt: str, blocks: int) -> str:
    """SQL: cells with the dealt spots put in."""
    into = "named_struct('n', t.n + y.n, 'digest', t.digest ^ y.digest, 'check', t.check ^ xxhash64(y.digest, -1L))"
    return f"transform({cells}, (x, at) -> aggregate(filter({dealt}[at % {blocks}], y -> y.cell = at), x, (t, y) -> {into}))"


def _blocks(level: int) -> int:
    return math.isqrt(3 * CELLS * GROWTH**level - 1) + 1


def with_table(df: DataFrame, digests: str, out: str, level: int = 0) -> DataFrame:
    """Add out, the cells (n, digest, check) of the table of an array of distinct digests; null of null."""
    blocks, empty = _blocks(level), "named_struct('n', 0L, 'digest', 0L, 'check', 0L)"
    # Each step is a column that the next one names twice, as the optimizer would else put it inside the next one's loops.
    df = df.withColumn("_spots", F.expr(f"flatten(transform({digests}, d -> {_spots('d', '1L', level)}))"))
    df = df.withColumn("_dealt", F.expr(_dealt("_spots", blocks))).drop("_spots")
    filled = _summed(f"array_repeat({empty}, {3 * CELLS * GROWTH**level})", "_dealt", blocks)
    return df.withColumn(out, F.expr(f"CASE WHEN size(_dealt) > 0 THEN {filled} END")).drop("_dealt")


def subtracted(a: str, b: str) -> str:
    """SQL: the cells of one table minus those of another of the same size."""
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'digest', x.digest ^ y.digest, 'check', x.check ^ y.check))"


def peeled(cells: str, level: int) -> str:
    """SQL: peel subtracted cells: struct(cells that are left, found: array of struct(digest, n) with n 1 or -1 for the side that has it, and the rest of the fold's state).

    A sweep has three steps: cells with a single digest are found, these digests' cells are dealt into blocks, and they
    are taken out of all three parts. A digest that is single in several parts is taken by the first of these. It ends
    with a sweep that finds nothing.
    """
    size, blocks = CELLS * GROWTH**level, _blocks(level)
    place = [f"pmod(xxhash64(x.digest, {3 * level + p}L), {size}L) + {p * size}L" for p in range(3)]
    single = [f"(at >= {(p + 1) * size} AND abs(s.cells[{place[p]}].n) = 1 AND s.cells[{place[p]}].digest = x.digest)" for p in range(2)]
    here = f"at = CASE at div {size} WHEN 0 THEN {place[0]} WHEN 1 THEN {place[1]} ELSE {place[2]} END"
    pure = f"filter(transform(s.cells, (x, at) -> CASE WHEN abs(x.n) = 1 AND x.check = xxhash64(x.digest, -1L) AND {here} AND NOT {single[0]} AND NOT {single[1]} THEN named_struct('digest', x.digest, 'n', x.n) END), x -> x IS NOT NULL)"
    taken = f"flatten(transform({pure}, e -> {_spots('e.digest', '-e.n', level)}))"
    found = f"transform(filter(s.spots, x -> x.cell < {size}), x -> named_struct('digest', x.digest, 'n', -x.n))"

    def made(cells: str = "s.cells", found: str = "s.found", spots: str = "s.spots", dealt: str = "s.dealt", idle: str = "s.idle") -> str:
        return f"named_struct('cells', {cells}, 'found', {found}, 'spots', {spots}, 'dealt', {dealt}, 'idle', {idle})"

    start = made(cells, "cast(array() AS array<struct<digest:bigint,n:bigint>>)", f"cast(array() AS array<{_SPOT}>)", f"cast(array() AS array<array<{_SPOT}>>)", "false")
    return f"""aggregate(sequence(0L, {3 * ROUNDS - 1}L), {start}, (s, step) -> CASE
        WHEN s.idle THEN s
        WHEN step % 3 = 0 THEN {made(spots=taken)}
        WHEN step % 3 = 1 THEN {made(dealt=_dealt("s.spots", blocks), idle="size(s.spots) = 0")}
        ELSE {made(cells=_summed("s.cells", "s.dealt", blocks), found=f"concat(s.found, {found})")} END)"""


def differences(sets: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """For each pair (a, b, out) add out: struct(level, removed, added), the digests that only the array a or only the array b has, as recovered by peeling, and the level it took.

    A pair begins at the level with as many cells as both sets have digests, which is enough for versions that share a
    fifth of their paragraphs. The loop has a step for each level that a pair needs, which is the
    logarithm of the longest text's paragraphs; a row takes part until all of its pairs are resolved.
    """
    result = "struct<level:int,removed:array<bigint>,added:array<bigint>>"
    todo, names = sets, [*sets.columns, *(out for _, _, out in pairs)]
    for a, b, out in pairs:
        levels = f"ceil(log({GROWTH}, (size({a}) + size({b}) + 1) / {{}}))"
        todo = todo.withColumns({f"_least{out}": F.expr(f"cast(greatest(0, {levels.format(3.0 * CELLS)}) AS int)"), f"_most{out}": F.expr(f"cast({levels.format(1.0 * CELLS)} AS int) + 8"), out: F.expr(f"cast(NULL AS {result})")})
    level, done = 0, []
    unresolved = reduce(lambda x, y: x | y, [F.col(out).isNull() for _, _, out in pairs])
    while True:
        tried = todo
        for a, b, out in pairs:
            turn = f"CASE WHEN {out} IS NULL AND _least{out} <= {level} THEN {{}} END"
            tried = tried.withColumns({"_ga": F.expr(turn.format(a)), "_gb": F.expr(turn.format(b))})
            tried = with_table(with_table(tried, "_ga", "_ta", level), "_gb", "_tb", level)
            tried = tried.withColumn("_cells", F.expr(subtracted("_ta", "_tb"))).drop("_ga", "_gb", "_ta", "_tb")
            tried = tried.withColumn("_peeled", F.expr(f"CASE WHEN _cells IS NOT NULL THEN {peeled('_cells', level)} END")).drop("_cells")
            side = "transform(filter(_peeled.found, x -> x.n = {0}), x -> x.digest)"
            solved = f"CASE WHEN {out} IS NOT NULL THEN {out} WHEN NOT exists(_peeled.cells, x -> x.n <> 0 OR x.digest <> 0 OR x.check <> 0) THEN cast(named_struct('level', {level}, 'removed', {side.format(1)}, 'added', {side.format(-1)}) AS {result}) WHEN _most{out} <= {level} THEN raise_error('a pair is not resolved by the largest table') END"
            tried = tried.withColumn(out, F.expr(solved)).drop("_peeled")
        tried = settle(tried)
        done.append(tried.filter(~unresolved).select(names))
        todo, level = tried.filter(unresolved), level + 1
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)


def written(digests: str, cells: str) -> str:
    """SQL: the fingerprint as text: number of digests, cells, and the cells that aren't empty (place, n, digest, check) in hexadecimal."""
    shown = "CASE WHEN x.n <> 0 THEN concat_ws('.', lower(hex(at)), lower(hex(x.n)), lower(hex(x.digest)), lower(hex(x.check))) END"
    return f"concat_ws(':', size({digests}), {3 * CELLS}, array_join(filter(transform({cells}, (x, at) -> {shown}), x -> x IS NOT NULL), ' '))"


def _cut(rows: DataFrame, id_: str, n: int) -> DataFrame:
    """Add _cell: the first id of the stretch of ids that a row is in. Stretches with more rows than others are cut finer, by the bits of the id.

    A stretch has at most max(ROWS, n / 2 ** 16) rows unless its ids are all equal, so there are few stretches whatever the ids.
    """
    span = rows.agg(F.min(id_).alias("low"), F.max(id_).alias("high")).first()
    bits = ((span["high"] or 0) - (span["low"] or 0)).bit_length()
    shift, most = max(0, bits - FIRST), max(ROWS, n >> 16)
    start = F.expr(f"shiftleft(shiftright({id_}, {shift}), {shift})") if shift < 64 else F.lit(0).cast("long")
    rows = rows.withColumn("_cell", start)
    crowded = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    while shift:
        # At most n / most stretches are crowded, which is at most 2 ** 16.
        crowded = settle(crowded.select("_cell", F.lit(True).alias("_crowded")))
        if crowded.isEmpty():
            return rows
        shift = max(0, shift - FINER)
        finer = F.expr(f"CASE WHEN _crowded THEN shiftleft(shiftright({id_}, {shift}), {shift}) ELSE _cell END")
        rows = rows.join(F.broadcast(crowded), "_cell", "left").withColumn("_cell", finer)
        crowded = rows.filter("_crowded").groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
        rows = rows.drop("_crowded")
    return rows


def followed(df: DataFrame) -> DataFrame:
    """doc_id, text, and next, the text of the next row by id (the first row's after the last).

    Rows go to stretches of ids and are sorted only there; rows without an id, which come last, to stretches of their
    texts' hashes. The first row of each stretch is also given to the stretch before it. The stretches are few, so that
    one window may order them.
    """
    rows = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_null": F.col("doc_id").isNull()})
    sizes = {r["_null"]: r["n"] for r in rows.groupBy("_null").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    named = _cut(rows.filter("NOT _null").withColumn("_id", F.col("doc_id").cast("long")), "_id", sizes.get(False, 0))
    parts = [named.drop("_id")]
    if True in sizes:
        parts.append(_cut(rows.filter("_null"), "_hash", sizes[True]))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = F.struct("doc_id", "_hash")
    firsts = rows.groupBy("_null", "_cell").agg(F.min(order).alias("_first"))
    by_cell = Window.orderBy("_null", "_cell")
    firsts = settle(firsts.withColumn("_to", F.lag(F.struct("_null", "_cell")).over(by_cell)))
    last = firsts.agg(F.max(F.struct("_null", "_cell"))).first()[0]
    firsts = firsts.withColumn("_to", F.coalesce("_to", F.struct(F.lit(last["_null"]).alias("_null"), F.lit(last["_cell"]).cast("long").alias("_cell"))))
    heads = rows.join(F.broadcast(firsts), ["_null", "_cell"]).filter(order.eqNullSafe(F.col("_first"))).groupBy("_to").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(df.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(0).cast("long").alias("_hash"), "_to._null", "_to._cell", F.lit(1).alias("_head"))
    window = Window.partitionBy("_null", "_cell").orderBy("_head", "doc_id", "_hash", "text")
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads).withColumn("next", F.lead("text").over(window))
    return both.filter("_head = 0").select("doc_id", "text", "next")


def likeness(a: Column, b: Column, different: Column) -> Column:
    """Digests that both sets have, as a part of those that either has."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - different) / (a + b + different))


def compared(pairs: DataFrame, left: str, right: str, out: str = "difference") -> DataFrame:
    """Add out, a struct of the level at which the tables were peeled and of the paragraphs' digests that only one text has: removed and added."""
    sets = settle(with_paragraphs(with_paragraphs(pairs, F.col(left), "_a"), F.col(right), "_b"))
    return differences(sets, [("_a", "_b", out)]).drop("_a", "_b")


def report(df: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that of the next document's; and the level that each comparison took."""
    text = followed(df).withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.expr("n_chars div 2").cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _half)"), F.expr("substring(next, 1, _half)"))
    text = text.withColumn("edited", edited)
    for column, out in (("text", "_own"), ("edited", "_changed"), ("next", "_after")):
        text = with_paragraphs(text, F.col(column), out)
    sets = settle(text.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "_own", "_changed", "_after"))
    found = differences(sets, [("_own", "_changed", "_edit"), ("_own", "_after", "_follow")])
    found = with_table(with_table(found, "_own", "_t0"), "_changed", "_t1")
    n = {c: F.size(c) for c in ("_own", "_changed", "_after")}
    different = {c: F.size(F.col(c)["removed"]) + F.size(F.col(c)["added"]) for c in ("_edit", "_follow")}
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(written("_own", "_t0")).alias("fingerprint"), F.expr(written("_changed", "_t1")).alias("edited_fingerprint"),
        likeness(n["_own"], n["_changed"], different["_edit"]).alias("near_edited"), likeness(n["_own"], n["_after"], different["_follow"]).alias("near_next"),
        F.col("_edit.level").alias("edited_level"), F.col("_follow.level").alias("next_level"),
    )
