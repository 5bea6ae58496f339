"""License scans by diagonal voting.

All rolling hashes of k words of every text are joined with the positions of license templates that have the same hash.
A match votes for a diagonal, the offset between text and template, as a copy of a template gives one diagonal and a copy
with words put in or left out gives a few close together. Diagonals that lie within a few words of each other are merged
to a span. By the q-gram lemma a span that differs in a given share of its words keeps a number of hashes; spans with
fewer are dropped, and the others are verified: similarity is the longest common subsequence of span and template, in
words, over the longer of both. A span of `least` or more gives its template's label, unless it overlaps a better one, as
licenses that differ in a word do.

Spans are kept by the text's digest, so that any number of copies is joined to a text's few spans. Beside them,
phrases of a license's name give labels by themselves.

A null or empty text has no words, labels or spans and scores 0. Rows that are repeated, or share an id or none, are
labelled each. An empty table gives no rows. Extra columns aren't read by the query and are kept by scanned(), whose own
columns may not be among them. A text is scanned whole, and its spans, of which it has as many as copies of templates,
are merged by one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import settle, terms

#: Phrases that name a license, and the label each gives.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts by which works are put under a license, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This work is licensed under the GNU General Public License version 2"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "apache",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Words in a hash, similarity of a span, and rows of templates or spans up to which they are broadcast (some 50 bytes each).
K, LEAST, MOST_ROWS = 3, 0.8, 500_000
MOST_WORDS = 300_000

#: Columns that a scan adds.
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, template: int, first_word: bigint, last_word: bigint, similarity: double>>"
)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def rolling(found: list[bytes], k: int, hashes: Hashes) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(found) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    own = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    return runs.view(np.int64)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K, least: float = LEAST) -> DataFrame:
    """gram, template, place, and what a template asks for: its words (size), hashes that a span keeps (votes), words that diagonals may lie apart (slack).

    A span of similarity `least` lacks or changes (1 - least) of the template's words at most, and each spoils k hashes.
    """
    rows, hashes = [], Hashes()
    for number, (_, text) in enumerate(templates):
        found = terms(text.encode())
        if len(found) < k:
            raise ValueError(f"template {number} has fewer than {k} words")
        lost = int((1 - least) * len(found) + 1e-9)
        votes, slack = max(1, len(found) - k + 1 - k * lost), max(1, lost)
        rows += [(int(g), number, i, len(found), votes, slack) for i, g in enumerate(rolling(found, k, hashes))]
    return spark.createDataFrame(rows, "gram long, template int, place int, size int, votes int, slack int")


def digest(text: str = "text") -> list:
    return [F.xxhash64(F.lit(s), F.col(text)).alias(f"_digest{s}") for s in (1, 2)]


def candidates(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K, least: float = LEAST, text: str = "text") -> DataFrame:
    """_digest1, _digest2, template, first, last: stretches of words of a text (by its digest) that may be a template."""
    spark = docs.sparkSession
    table = template_table(spark, templates, k, least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            runs = [rolling(terms(t.as_py()), k, hashes) for t in batch.column(2)]
            ends = np.cumsum([0, *map(len, runs)])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *runs])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], ["_digest1", "_digest2", "grams"])

    grams = docs.select(*digest(text), F.encode(F.col(text), "utf-8")).mapInArrow(hashed, "_digest1 long, _digest2 long, grams array<long>")
    grams = grams.select("_digest1", "_digest2", F.posexplode("grams").alias("at", "gram"))
    if sum(len(terms(t.encode())) for _, t in templates) <= MOST_ROWS:
        table = F.broadcast(table)
    key = ["_digest1", "_digest2", "template"]
    votes = grams.join(table, "gram").select(*key, "at", "place", "size", "votes", "slack").distinct()  # copies of a text vote once
    diagonals = votes.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal"), "size", "votes", "slack").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), (F.max("at") + (k - 1)).alias("last")
    )
    along = Window.partitionBy(*key).orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")).cast("int")
    spans = diagonals.withColumn("span", F.sum(F.coalesce(starts, F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "span", "votes").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.filter(F.col("n") >= F.col("votes")).select(*key, "first", "last")


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    numbers = {w: i for i, w in enumerate(set(a))}
    row, other = np.zeros(len(b) + 1, np.int64), np.array([numbers.get(w, -1) for w in b])
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == numbers[w])))
    return int(row[-1])


def verified(text: list[bytes], first: int, last: int, template: list[bytes]) -> tuple[int, int, float]:
    """The span with similarity, widened at either end by the template's words that no hash matched, where that is better."""
    best = None
    room = max(K, len(template) - (last - first + 1))
    for before in range(min(room, first) + 1):
        for after in sorted({0, min(room - before, len(text) - 1 - last)}):
            a, z = first - before, last + after
            likeness = common_words(template, text[a : z + 1]) / max(len(template), z - a + 1)
            if best is None or likeness > best[2]:
                best = a, z, likeness
    return best


def apart(spans: list[tuple]) -> list[tuple]:
    """Spans (template, first, last, similarity) without those that overlap a better one, in order. Of equally good ones the longer, then the first template stays."""
    kept: list[tuple] = []
    for span in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        at = bisect.bisect(kept, span[1], key=lambda s: s[1])
        if (at == 0 or kept[at - 1][2] < span[1]) and (at == len(kept) or span[2] < kept[at][1]):
            kept.insert(at, span)
    return kept


def places(joined: bytes, phrase: bytes) -> list[int]:
    """At which words a phrase starts, in words joined and enclosed by spaces."""
    found, at, counted, word = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        found.append(word)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, k: int = K, least: float = LEAST, text: str = "text") -> DataFrame:
    """docs with n_words, the phrases' places (n_base, first_word, last_word, base_labels), labels, score and spans of its verified licenses.

    Labels are those of phrases and spans; the score is 1 with a phrase, else the best span's similarity.
    """
    found = settle(candidates(docs, templates, k, least, text))
    few = found.count() <= MOST_ROWS
    found = found.groupBy("_digest1", "_digest2").agg(F.collect_list(F.struct("template", "first", "last")).alias("_found"))
    rows = docs.withColumns({f"_digest{i + 1}": d for i, d in enumerate(digest(text))})
    rows = rows.join(F.broadcast(found) if few else found, ["_digest1", "_digest2"], "left").drop("_digest1", "_digest2")
    own, at = docs.columns, docs.columns.index(text)
    split, names = [terms(t.encode()) for _, t in templates], [n for n, _ in templates]
    span_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("similarity", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]

    def scan(body: bytes | None, spans: list[dict] | None) -> tuple:
        found = terms(body)
        joined = b" " + b" ".join(found) + b" "
        base = [(p, label) for phrase, label in phrases for p in places(joined, b" ".join(terms(phrase.encode())))]
        starts = [p for p, _ in base]
        checked = [(s["template"], *verified(found, s["first"], s["last"], split[s["template"]])) for s in spans or ()]
        kept = [{"label": names[t], "template": t, "first_word": a, "last_word": z, "similarity": v} for t, a, z, v in apart([c for c in checked if c[3] >= least])]
        labels = {label for _, label in base}
        score = 1.0 if base else max((v for *_, v in checked), default=0.0)
        return len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in kept})), score, kept

    def scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            columns = list(zip(*(scan(t.as_py(), s.as_py()) for t, s in zip(texts, batch.column(len(own)), strict=True)), strict=True)) or [[]] * len(types)
            arrays = [*batch.columns[: len(own)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*own, *NAMES])

    return rows.select(*own, "_found").mapInArrow(scanning, f"{_ddl(docs)}, {COLUMNS}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def report(docs: DataFrame) -> DataFrame:
    return scanned(docs.select("doc_id", "text")).drop("text")
