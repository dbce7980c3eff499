"""What the corpus operators share: tables, staged files in the shared folder, word rules, slices of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder

#: What separates words: space and the ASCII controls from tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    drop() removes a table that nothing reads any more; what a returned DataFrame
    still reads stays until the program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def stage(self, df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
        """df as a table of that name. tidy: the shuffle files of earlier steps go at once, which takes a moment; steps that shuffle little need not ask for it."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        if tidy:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files once nothing refers to them
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.at}/{name}")

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            remove(self.spark, self.at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, whatever others the table has."""
    return df.select(*[df[n] for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them in any case."""
    taken, out = {n.lower() for n in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    found = F.split(F.coalesce(text, F.lit("")), BLANK)
    return F.filter(found, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most about `most` bytes of text each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = text_bytes(batch.column(column))[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (one more at the end). Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
