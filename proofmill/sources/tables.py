"""Tables as DataFrames with a dense, 0-based row number in __rid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.catalog import RID, SPARK_TYPES, Table
from ..plans.errors import DataRequiredNonDefaultColumnValueNotProvided
from .staging import Rounds

_ARROW = {"TEXT": pa.string(), "INT": pa.int64(), "FLOAT": pa.float64(), "BOOL": pa.bool_()}


def from_rows(spark: SparkSession, table: Table, rows: list[tuple], first: int = 0) -> DataFrame:
    """Rows of literals. Generated columns are null until they are computed."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(table.columns)
    arrays = [pa.array(range(first, first + len(rows)), pa.int64()), *(pa.array(v, _ARROW[c.type]) for v, c in zip(columns, table.columns, strict=True))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[RID, *table.names]), schema=f"{RID} bigint, {table.schema}")


def placed(df: DataFrame, name: str = "rows") -> DataFrame:
    """df with its place: __at in the partition __part. Written first: a plan that is run again may deal its rows out otherwise, and then rows would be lost or numbered twice."""
    at = F.monotonically_increasing_id()
    staged = Rounds(df.sparkSession).keep(df.withColumn("__at", at), name)
    return staged.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df sorted by the keys, dealt out by ranges of them. Rows of equal keys are spread too, so that a common key is no hot range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(parts, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")


def numbered(df: DataFrame, first: int = 0) -> DataFrame:
    """df with __rid: the place of each row in the order of its partitions. df is run once and written to the shared folder."""
    return after(placed(df), df.columns, first)


def after(placed: DataFrame, columns: list[str], first: int = 0) -> DataFrame:
    """Row numbers from places (__at) in parts (__part): how many rows are in the parts before is added. There is one count a part, and they alone are broadcast."""
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))
    return placed.join(F.broadcast(sizes), F.col("__part") == F.col("__p"), "left").select((F.col("__at") + F.col("__before") + first).cast("long").alias(RID), *columns)


def numbered_by(df: DataFrame, keys: list[str], first: int = 0) -> DataFrame:
    """df with __rid: the rank of each row in the order of the keys, where equal rows stand in any order. One shuffle, by ranges; df is run once."""
    return after(placed(ranged(df, keys)), df.columns, first)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with __rid in the order of its files and rows. A single file's row numbers come from its scan; more files add the sizes of those before them."""
    df = spark.read.parquet(path)
    source = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if len(df.inputFiles()) <= 1:
        return source.select(F.col("__row").alias(RID), *df.columns)
    return after(source.withColumnsRenamed({"__file": "__part", "__row": "__at"}), df.columns)


def bound(df: DataFrame, table: Table, first: int = 0) -> DataFrame:
    """A DataFrame as rows of a declared table: its columns by name, cast; declared defaults where it has none. It keeps its __rid if it has one."""
    if RID not in df.columns:
        df = numbered(df)
    missing = [c.name for c in table.columns if c.name not in df.columns and c.required]
    if missing:
        raise DataRequiredNonDefaultColumnValueNotProvided(table_name=table.name, column_name=missing[0])
    pick = [(df[c.name] if c.name in df.columns and c.generated is None else F.lit(c.default if c.has_default else None)).cast(SPARK_TYPES[c.type]).alias(c.name) for c in table.columns]
    return df.select((df[RID] + first).alias(RID), *pick)
