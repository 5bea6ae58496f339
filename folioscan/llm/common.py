"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words, as a character class of a regular expression: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 bytes with A-Z lower-cased and all that isn't in a TERM made a space.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine (tests) may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the session's shared folder.

    Spark removes the files once the frame is no longer referenced, if
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    """A column's name as SQL takes it whole, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def words(text: Column | str) -> Column:
    """Words of a text, in order; a null text has none."""
    split = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE + "+")
    return F.filter(split, lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """Number of words, without building an array of them."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def terms(text: bytes | None) -> list[bytes]:
    """TERMs of a text's UTF-8 bytes, in order, A-Z lower-cased; a null text has none."""
    return (text or b"").translate(_TERM_BYTES).split()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that doesn't exist yet, among those that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def random_key(seed: int, *columns: Column) -> Column:
    """A seeded pseudo-random long in [0, 2**63), the same in every run."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(2**63 - 1))


def key_ranges(spark: SparkSession, rows: int) -> int:
    """Into how many ranges random keys are cut: several for each shuffle partition, each of at most about 100,000 rows of any group."""
    return max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 100_000))


def key_range(key: str, ranges: int) -> Column:
    return F.expr(f"{key} div {-(-(2**63) // ranges)}")


def range_offsets(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Sum of value over each (group, _range), and over the group's earlier ranges (_before)."""
    sums = df.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come earlier in order.

    df has _range, a range number that grows with order, so that no task holds a whole group: the sums of the
    ranges give each range's start and a window over a single range gives the rest. group columns aren't null.
    """
    keys = [*group, "_range"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = range_offsets(df, group, value).drop("_sum")
    joined = df.join(starts, keys)
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def source_key(source: str = "source") -> Column:
    """A key for a source that sorts by code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
