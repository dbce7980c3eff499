"""Databases as Parquet, with row pointers, and as SQLite files."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.navigation import with_pointers
from ..plans.catalog import RID, Catalog

_SQLITE = {"TEXT": "TEXT", "INT": "INTEGER", "FLOAT": "REAL", "BOOL": "INTEGER"}


def checksum(df: DataFrame) -> dict[str, int]:
    """The number of rows, and a sum over hashes of rows that stays the same in any order and changes with any value."""
    found = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": found["n"], "hash": int(found["h"] or 0)}


def _manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    try:
        return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/_checksums", wholetext=True).collect()) or "{}")
    except AnalysisException:
        return {}


def write_parquet(catalog: Catalog, frames: dict[str, DataFrame], folder: str, pointers: bool = True) -> list[str]:
    """A Parquet table for each table: rows in order, with row numbers, pointers and reverse lists if asked for. The names of the tables that were written:
    a table whose rows are those that the folder's checksums tell of is left as it is."""
    spark = next(iter(frames.values())).sparkSession if frames else None
    known, new, written = _manifest(spark, folder) if spark else {}, {}, []
    for name in sorted(catalog.tables):
        df = with_pointers(catalog, frames, name) if pointers else frames[name]
        new[name] = checksum(df) | {"columns": df.schema.simpleString()}
        if known.get(name) != new[name]:
            df.orderBy(RID).write.mode("overwrite").parquet(f"{folder}/{name}")
            written.append(name)
    if spark and new != known:
        spark.createDataFrame([(json.dumps(new, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_checksums")
    return written


def verify(spark: SparkSession, folder: str) -> list[str]:
    """The tables under a folder whose rows are not those that its checksums tell of."""
    return [n for n, told in sorted(_manifest(spark, folder).items()) if checksum(df := spark.read.parquet(f"{folder}/{n}")) | {"columns": df.schema.simpleString()} != told]


def write_sqlite(catalog: Catalog, frames: dict[str, DataFrame], path: str) -> None:
    """A file with each table and an index for each column, written on the driver, a part of a table at a time."""
    Path(path).unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        for t in catalog.tables.values():
            db.execute(f'CREATE TABLE "{t.name}" ({", ".join(f"{chr(34)}{c.name}{chr(34)} {_SQLITE[c.type]} NOT NULL" for c in t.columns)}) STRICT')
            marks = ", ".join("?" * len(t.columns))
            rows = frames[t.name].orderBy(RID).select(*t.names).toLocalIterator()
            db.executemany(f'INSERT INTO "{t.name}" VALUES ({marks})', ([int(v) if isinstance(v, bool) else v for v in r] for r in rows))
            for c in t.columns:
                db.execute(f'CREATE INDEX "{t.name}_{c.name}_index" ON "{t.name}" ("{c.name}")')
    db.close()
