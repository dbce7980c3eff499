"""Bitmaps of a fixed size over a column of longs, in DataFrame expressions: they keep rows out of a shuffle; where they are full they keep nothing out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a bitmap.
MAP = 1 << 17


def one_array(cells: DataFrame, size: int, value: str) -> DataFrame:
    """One row with one array of `size` values: those of cells (at, and value as a bigint) in their places, 0 elsewhere."""
    spark = cells.sparkSession
    empty = spark.range(size).select(F.col("id").alias("at"), F.lit(0).cast("long").alias(value))
    full = cells.select(F.col("at").cast("long").alias("at"), value).unionAll(empty).groupBy("at").agg(F.max(value).alias(value) if value == "n" else F.bit_or(value).alias(value))
    return full.agg(F.sort_array(F.collect_list(F.struct("at", value))).alias("cells")).select(F.col(f"cells.{value}").alias(value))


def bitmap(keys: DataFrame) -> DataFrame:
    """One row with an array of MAP longs in which a bit is set for each key."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    cells = keys.groupBy(F.shiftright("key", 6).bitwiseAND(F.lit(MAP - 1)).alias("at")).agg(F.bit_or(bit).alias("bits"))
    return one_array(cells, MAP, "bits")


def within(bits: Column, key: Column) -> Column:
    """Whether a bitmap may hold a key."""
    word = F.get(bits, F.shiftright(key, 6).bitwiseAND(F.lit(MAP - 1)).cast("int"))
    return F.call_function("shiftright", word, key.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
