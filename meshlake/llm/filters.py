"""Membership filters of a fixed greatest size, built and probed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap block, as Spark's bitmap functions have it.
BLOCK = 1 << 15
#: Greatest filter: 2^28 bits are 32 MB, whatever the number of keys.
MAX_BITS = 1 << 28


def bits_for(keys: int, per_key: int = 32, most: int = MAX_BITS) -> int:
    """A power of two near per_key bits a key, from one block to the greatest size."""
    bits = BLOCK
    while bits < min(keys * per_key, most):
        bits *= 2
    return bits


def _slot(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits)) + 1


def bitmap_filter(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """(block, bitmap): one bit a hash. Rows are aggregated before they are shuffled."""
    slot = _slot(F.col(h), bits)
    return hashes.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def _probe(h: Column, bits: int) -> tuple[Column, Column]:
    """(the number of h's block, whether h's bit is set in the block's bitmap)."""
    slot = _slot(h, bits)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bitmap_bucket_number(slot), F.getbit(byte.cast("long"), F.pmod(at, F.lit(8)).cast("int")) == 1


def maybe_in(df: DataFrame, filter_rows: DataFrame, h: Column, bits: int) -> DataFrame:
    """Rows of df whose hash may be in the filter; no row whose hash is in it is lost.

    The filter has at most MAX_BITS / BLOCK rows of 4 KB, so broadcasting it is bounded.
    Beyond that many keys it lets more through, and stays right.
    """
    block, hit = _probe(h, bits)
    joined = df.withColumn("__block", block).join(F.broadcast(filter_rows.withColumnRenamed("block", "__block")), "__block")
    return joined.where(hit).drop("__block", "bitmap")


def surely_out(df: DataFrame, filter_rows: DataFrame, h: Column, bits: int) -> DataFrame:
    """The rows of df that maybe_in leaves out: their hash is in no way in the filter. A null hash is in none."""
    block, hit = _probe(h, bits)
    joined = df.withColumn("__block", block).join(F.broadcast(filter_rows.withColumnRenamed("block", "__block")), "__block", "left")
    return joined.where(~F.coalesce(hit, F.lit(False))).drop("__block", "bitmap")
