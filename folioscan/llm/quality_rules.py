"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Each document is judged alone, so ties, repeated rows and an empty table need no care. A null text counts as an empty
one, has no word and fails. A long text is processed whole: the cost of every metric is n log n in its words. Of the
input, judged() replaces columns that are named like a metric and filtered() keeps all columns, whatever their names.
Windows of five words are told apart by the 64-bit hash of their words' 64-bit hashes, not by the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import SPACE, WORD, quoted

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for on was as be this with by are or at an from "
    "de la le les des et un une du en est que pour dans sur pas au par il elle avec "
    "der die das und zu den von mit ein eine nicht auf ist für im sie auch sich dem "
    "el los las y que del se una por con no para su al lo como más"
).split()

SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high, or if it has fewer words than from_words."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Ratios are in parts of the words, lines or characters of the text.
RULES = (
    Rule("n_words", low=10),
    Rule("repeat_word_ratio", high=0.2),
    Rule("mean_word_chars", low=2.0, high=16.0),
    Rule("symbol_word_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02, from_words=100),
    Rule("dup_line_ratio", high=0.5),
    Rule("upper_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def repeated_words(hashes: str, n: int = 5) -> str:
    """SQL: number of words in n-word windows that occur at least twice, from the array of the words' hashes.

    The windows' hashes are sorted only in texts where two are equal; a window's words that no later repeated window
    covers count once, so the count is the size of the windows' union.
    """
    window = ", ".join(f"{hashes}[i + {k}]" for k in range(n))
    return f"""
      CASE WHEN size({hashes}) <= {n} THEN 0L ELSE
        aggregate(
          array(transform(slice({hashes}, 1, size({hashes}) - {n - 1}), (x, i) -> xxhash64({window}))),
          0L,
          (none, w) -> CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE
            aggregate(
              array(sort_array(transform(w, (h, i) -> struct(h, i)))),
              0L,
              (nothing, s) -> aggregate(
                sort_array(transform(
                  filter(s, (e, j) -> coalesce(e.h = get(s, j - 1).h, false) OR coalesce(e.h = get(s, j + 1).h, false)),
                  e -> e.i)),
                struct(-{n} AS last, 0L AS n),
                (acc, at) -> struct(at AS last, acc.n + least({n}, at - acc.last) AS n),
                acc -> acc.n))
          END)
      END"""


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics of a text that the rules name. A null text counts as an empty one."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    df = df.withColumns({"_body": body, "_words": F.filter(F.split(body, SPACE + "+"), lambda w: w != "")})
    df = df.withColumns(
        {
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "_lines": F.filter(F.split("_body", "\n"), lambda x: x.rlike(WORD)),
            "_bare": F.length(F.regexp_replace("_body", SYMBOLS, "")),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("_body", SPACE + "+", "")).cast("long"),
            "n_symbols": (F.length("_body") - F.col("_bare")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(repeated_words("_hashes")).cast("long"),
            "_stops": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))),
            "_upper": F.length("_body") - F.length(F.regexp_replace("_body", r"\p{Lu}+", "")),
            "_dotted": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        }
    )
    words = F.col("n_words")
    return df.withColumns(
        {
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), words),
            "mean_word_chars": _ratio(F.col("word_chars"), words),
            "symbol_word_ratio": _ratio(F.col("n_symbols"), words),
            "stop_word_ratio": _ratio(F.col("_stops"), words),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "upper_ratio": _ratio(F.col("_upper"), F.col("word_chars")),
            "ellipsis_line_ratio": _ratio(F.col("_dotted"), F.col("n_lines")),
        }
    ).drop("_body", "_words", "_hashes", "_lines", "_bare", "_stops", "_upper", "_dotted")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one predicate over measured columns."""
    verdict = F.lit(True)
    for rule in rules:
        metric, fine = F.col(rule.metric), F.lit(True)
        if rule.low is not None:
            fine = fine & (metric >= rule.low)
        if rule.high is not None:
            fine = fine & (metric <= rule.high)
        verdict = verdict & (fine | (F.col("n_words") < rule.from_words))
    return verdict


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with the metrics and kept, the rules' verdict."""
    return measured(df, text).withColumn("kept", passes(rules))


def filtered(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of df."""
    whole = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_own"), F.col(quoted(text)).alias("_text"))
    # A filter would be pushed below the projection and measure every text again for each rule that it names.
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))))
    return judged(whole, rules, "_text").select("_own", once.alias("_once")).select("_own.*")


def report(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and the verdict."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = judged(df.select("doc_id", "text"), rules).withColumn("base_failed", base)
    kept = (F.col("kept") & ~F.col("base_failed")).alias("kept")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *counts, "base_failed", kept, *(r.metric for r in rules if r.metric not in counts))
