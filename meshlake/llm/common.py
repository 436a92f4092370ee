"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is, and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one too small to give every core a split of its own is dealt out over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * split else rows


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Join right by broadcast if it is counted to have at most limit rows, else by shuffle."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)
