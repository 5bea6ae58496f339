"""Decision requests and answers as VARIANT: closed schemas walked, and answers held against what was asked.

A request has a state and questions by id, each of one of three types; an answer has the type of its question and agrees
with itself and with the question's criteria. What is wrong is named, once for each question, or for the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.sources.storage import settle

#: Most questions, options and levels, bytes of a response and of a name, how far rounded numbers may be off.
QUESTIONS, OPTIONS, LEVELS, MOST_BYTES, NAME_BYTES, OFF = 64, 255, 10, 1 << 20, 256, 0.02
FIELDS = ("type", "instructions", "criteria")
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def is_a(value: Column, *kinds: str) -> Column:
    """Whether a variant is of one of some kinds; what isn't there is of none."""
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


def described(value: Column) -> Column:
    return is_a(value, "STRING", "OBJECT", "ARRAY")


def absent(value: Column) -> Column:
    """Not there, or null."""
    return value.isNull() | F.is_variant_null(value)


def members(value: Column) -> Column:
    """An object's fields as a map; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """An array's elements; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def text(value: Column) -> Column:
    return F.when(is_a(value, "STRING"), F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    """A number's value; one that is written as text is none."""
    return F.when(F.coalesce(F.schema_of_variant(value).rlike(_NUMBER), F.lit(False)), F.try_variant_get(value, "$", "double"))


def first_fault(*faults: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for test, name in faults], F.lit(None).cast("string"))


def probable(value: Column) -> Column:
    return F.coalesce((number(value) >= 0) & (number(value) <= 1), F.lit(False))


def name_fits(value: Column) -> Column:
    name = text(value)
    return F.coalesce((F.trim(name) != "") & (F.octet_length(name) <= NAME_BYTES) & ~name.rlike(r"\p{Cntrl}"), F.lit(False))


def only_faults(rows: DataFrame) -> DataFrame:
    """request_id, question and fault of rows that have one.

    A filter on fault would be pushed below the steps that work it out, with all of them written out for each use; an
    exploded array isn't.
    """
    return rows.select("request_id", "question", F.explode(F.array_compact(F.array("fault"))).alias("fault"))


def questions_of(requests: DataFrame) -> DataFrame:
    """request_id, id and question of requests whose questions are an object."""
    return requests.select("request_id", F.explode(members(F.try_parse_json("questions"))).alias("id", "question"))


def _with_question_fault(rows: DataFrame) -> DataFrame:
    """Add fault to questions. Step by step, so that what several rules need is worked out once."""
    rows = rows.withColumn("_q", members(F.col("question")))
    of = lambda name: F.try_element_at("_q", F.lit(name))
    rows = rows.withColumns({"_type": of("type"), "_criteria": of("criteria"), "_told": described(of("instructions"))})
    rows = rows.withColumns({"_kind": text(F.col("_type")), "_options": members(F.col("_criteria")), "_levels": elements(F.col("_criteria"))})
    noul = absent(F.col("_criteria")) | (F.size("_options") == 2) & described(F.try_element_at("_options", F.lit("true"))) & described(F.try_element_at("_options", F.lit("false")))
    choice = F.size("_options").between(2, OPTIONS) & F.forall(F.map_entries("_options"), lambda e: (e["key"] != "") & (F.is_variant_null(e["value"]) | described(e["value"])))
    score = F.size("_levels").between(2, LEVELS) & F.forall("_levels", described)
    right = F.when(F.col("_kind") == "noul", noul).when(F.col("_kind") == "choice", choice).when(F.col("_kind") == "score", score)
    fault = first_fault(
        (F.col("id") == "", "id"), (F.col("_q").isNull(), "question"), (F.exists(F.map_keys("_q"), lambda k: ~k.isin(*FIELDS)), "field"), (~F.col("_told"), "instructions"),
        (~F.coalesce(F.col("_kind").isin("noul", "choice", "score"), F.lit(False)), "type"), (~F.coalesce(right, F.lit(False)), "criteria"),
    )
    return rows.withColumn("fault", fault)


def request_faults(requests: DataFrame) -> DataFrame:
    """request_id, question (null: the whole request) and fault of requests (request_id, state, questions; JSON)."""
    whole = requests.withColumn("_fields", members(F.try_parse_json("questions")))
    fault = first_fault((~described(F.try_parse_json("state")), "state"), (F.col("_fields").isNull(), "questions"), (~F.size("_fields").between(1, QUESTIONS), "question_count"))
    of_whole = whole.select("request_id", F.lit(None).cast("string").alias("question"), fault.alias("fault"))
    each = _with_question_fault(questions_of(requests)).select("request_id", F.col("id").alias("question"), "fault")
    return only_faults(of_whole).unionByName(only_faults(each))


def _distribution_fits(shares: Column, keys: Column) -> Column:
    """Whether a map of variants is a distribution over just these keys."""
    numbers = F.transform(F.map_values(shares), number)
    same = (F.size(shares) == F.size(keys)) & (F.size(F.array_except(keys, F.map_keys(shares))) == 0)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(same & F.forall(F.map_values(shares), probable) & (F.abs(total - 1) <= OFF), F.lit(False))


def _with_answer_fault(both: DataFrame) -> DataFrame:
    """Add fault to pairs of question and answer: each type's rules over its own rows, step by step, so that what several need is worked out once."""
    asked, told = (lambda name: F.try_element_at("_q", F.lit(name))), (lambda name: F.try_element_at("_a", F.lit(name)))
    rows = both.withColumns({"_q": members(F.col("question")), "_a": members(F.col("answer"))})
    rows = rows.withColumns({"_type": asked("type"), "_own": told("type")})
    # Kept with the kinds that rows are dealt by, as each type's rules read it.
    rows = settle(rows.select(*both.columns, text(F.col("_type")).alias("_kind"), text(F.col("_own")).alias("_answered")))
    rows = rows.withColumns({"_q": members(F.col("question")), "_a": members(F.col("answer"))})
    fits = F.coalesce(F.col("_answered") == F.col("_kind"), F.lit(False))
    odd = rows.filter(~fits).withColumn("fault", F.when(F.col("question").isNull() | F.col("answer").isNull(), "answer_ids").otherwise("answer_type"))
    noul = rows.filter(fits & (F.col("_kind") == "noul")).withColumn("_noul", told("noul")).withColumn("fault", first_fault((~probable(F.col("_noul")), "probability")))

    def rated(kind: str, **columns: Column) -> DataFrame:
        own = rows.filter(fits & (F.col("_kind") == kind)).withColumns({"_sure": told("confidence"), "_given": told("probabilities"), **columns})
        own = own.withColumns({"_shares": members(F.col("_given")), "_unsure": ~absent(F.col("_sure")) & ~probable(F.col("_sure")), "_is_given": ~absent(F.col("_given"))})
        return own.withColumn("_numbers", F.transform(F.map_values("_shares"), number))

    choice = rated("choice", _options=F.map_keys(members(asked("criteria"))), _own=told("choice")).withColumn("_choice", text(F.col("_own")))
    choice = choice.withColumn("fault", first_fault(
        (~F.array_contains("_options", F.col("_choice")), "option"), (F.col("_unsure"), "confidence"), (F.col("_is_given") & ~_distribution_fits(F.col("_shares"), F.col("_options")), "distribution"),
        (F.col("_is_given") & (number(F.try_element_at("_shares", F.col("_choice"))) < F.array_max("_numbers") - 1e-9), "disagrees"),
    ))
    score = rated("score", _levels=elements(asked("criteria")), _own=told("score"), _told=told("legend")).withColumn("_score", number(F.col("_own")))
    score = score.withColumns({"_top": F.size("_levels") - 1, "_legend": members(F.col("_told")), "_places": F.transform(F.sequence(F.lit(0), F.size("_levels") - 1), lambda i: i.cast("string"))})
    expected = F.aggregate(F.zip_with(F.map_keys("_shares"), "_numbers", lambda k, v: k.try_cast("double") * v), F.lit(0.0), lambda s, x: s + x)
    same = F.forall(F.zip_with("_places", "_levels", lambda i, w: F.coalesce(F.to_json(F.try_element_at("_legend", i)) == F.to_json(w), F.lit(False))), lambda x: x)
    score = score.withColumn("fault", first_fault(
        (~F.coalesce((F.col("_score") >= 0) & (F.col("_score") <= F.col("_top")), F.lit(False)), "range"), (F.col("_unsure"), "confidence"), (F.col("_is_given") & ~_distribution_fits(F.col("_shares"), F.col("_places")), "distribution"),
        (F.col("_is_given") & (F.abs(F.col("_score") - expected) > OFF * F.col("_top")), "disagrees"), (~absent(F.col("_told")) & ~F.coalesce((F.size("_legend") == F.size("_levels")) & same, F.lit(False)), "legend"),
    ))
    return reduce(DataFrame.unionByName, [part.select(*both.columns, "fault") for part in (odd, noul, choice, score)])


def response_faults(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id, question (null: the whole response) and fault of responses (request_id, body) to sound requests. JSON with a repeated key is none."""
    rows = responses.withColumn("_m", members(F.try_parse_json("body")))
    of = lambda name: F.try_element_at("_m", F.lit(name))
    rows = rows.withColumns({f"_{n}": of(n) for n in ("answers", "model", "id", "provider", "usage")})
    rows = rows.withColumns({"_map": members(F.col("_answers")), "_used": members(F.col("_usage"))})
    rows = rows.withColumns({f"_{n}": F.try_element_at("_used", F.lit(n)) for n in ("input_tokens", "output_tokens", "cost")})
    count_fits = lambda c: absent(c) | F.coalesce(F.schema_of_variant(c).rlike("INT$") & (number(c) >= 0), F.lit(False))
    spent = absent(F.col("_cost")) | F.coalesce(number(F.col("_cost")) >= 0, F.lit(False))
    rows = rows.withColumn("_fits", absent(F.col("_usage")) | F.col("_used").isNotNull() & count_fits(F.col("_input_tokens")) & count_fits(F.col("_output_tokens")) & spent)
    whole = first_fault(
        (F.octet_length("body") > MOST_BYTES, "bytes"), (F.col("_m").isNull(), "json"), (F.col("_map").isNull(), "schema"), (~name_fits(F.col("_model")), "model"),
        (reduce(lambda a, b: a | b, [~absent(F.col(n)) & ~name_fits(F.col(n)) for n in ("_id", "_provider")]), "metadata"), (~F.coalesce("_fits", F.lit(False)), "usage"),
    )
    of_whole = rows.select("request_id", F.lit(None).cast("string").alias("question"), whole.alias("fault"))
    # A response's answers beside its request's questions, by their ids; texts are joined and parsed after that, once.
    pairs = responses.join(requests.select("request_id", "questions"), "request_id", "left")
    pairs = pairs.withColumns({"_asked": members(F.try_parse_json("questions")), "_m": members(F.try_parse_json("body"))})
    pairs = pairs.withColumn("_told", members(F.try_element_at("_m", F.lit("answers"))))
    ids = F.array_union(F.coalesce(F.map_keys("_asked"), F.array().cast("array<string>")), F.map_keys("_told"))
    pairs = pairs.select("request_id", "_asked", "_told", F.explode(ids).alias("id"))
    both = pairs.select("request_id", "id", F.try_element_at("_asked", F.col("id")).alias("question"), F.try_element_at("_told", F.col("id")).alias("answer"))
    return only_faults(of_whole).unionByName(only_faults(_with_answer_fault(both).select("request_id", F.col("id").alias("question"), "fault")))
