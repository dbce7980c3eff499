"""From raw documents to training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm.decontaminate import keep_clean
from proofmill.llm.language import keep_known
from proofmill.llm.lines import dedup
from proofmill.llm.near import keep_one
from proofmill.llm.packing import pack
from proofmill.llm.util import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Null, empty and letterless texts go; each row is judged by its own text, whatever ids repeat. Empty table: no rows."""
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that lose every line with a word go. Rows that repeat id and text lose the same lines. Empty table: no rows."""
    return dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; those without a word or an id all stay. Empty table: no rows."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; each row is judged by its own text. Null and empty texts stay. Empty table: no rows; empty benchmark: all rows."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence. Null and empty texts are one piece, the closing id. Empty table: no rows."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language ID, edit distances and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
