from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_key", "_size", "_source", "_range", "_row", "_doc", "n_words", "kept", "score", "_toxic", "rep", "w", "text_crc32", "_taken", "_copy", "length")


@pytest.fixture(scope="session")
def prose():
    """A seeded writer of texts over a vocabulary."""
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "to", "in", *("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(3000))]

    def write(n: int) -> str:
        return " ".join(rng.choice(vocabulary[:5]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n))

    return write


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows and repeated ids."""
    long = prose(30_000)
    same = prose(120)
    rows = [(i, prose(60 + i), "en", f"s{i % 3}", 0) for i in range(24)]
    rows += [(100, None, "en", "s0", None), (101, "", None, "s1", 0), (102, " \n\t ", "en", None, 4), (103, long, "en", None, len(long)), (104, same, "en", "s0", 1), (105, same, None, "s0", 1), (106, same + " end", "en", "s2", 1)]
    rows += [(107, same, "en", "s0", 1)] * 3 + [(107, "another text of that id", "en", "s0", 1), (108, "word", "en", "s1", 4), (109, "??? 12", "en", "s1", 5)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("own") for c in CLASHES})
