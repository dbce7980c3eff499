"""Rows as JSON: offenders, one at a time, and whole databases."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.catalog import RID, Catalog, Table


def as_json(v: Any) -> Any:
    """Whole numbers are written as floats."""
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def pretty(table: Table, row: Row) -> str:
    """A row with its columns in alphabetical order, indented."""
    return json.dumps({c: as_json(row[c]) for c in table.names}, indent=2, sort_keys=True, ensure_ascii=False)


def database_json(catalog: Catalog, frames: dict[str, DataFrame]) -> dict[str, list[dict[str, Any]]]:
    """A small database as one value: {table: rows}. For large ones, see write_json()."""
    return {t.name: [{c: as_json(r[c]) for c in t.names} for r in frames[t.name].orderBy(RID).collect()] for t in catalog.tables.values()}


def write_json(catalog: Catalog, frames: dict[str, DataFrame], folder: str) -> None:
    """A folder of JSON lines for each table, in order of rows."""
    for t in catalog.tables.values():
        cols = [F.col(c.name).cast("double").alias(c.name) if c.type == "INT" else F.col(c.name) for c in t.columns]
        frames[t.name].orderBy(RID).select(*cols).write.mode("overwrite").json(f"{folder}/{t.name}")


def show(catalog: Catalog, frames: dict[str, DataFrame], rows: int = 1_000_000) -> None:
    for name in sorted(catalog.tables):
        print(name)
        frames[name].orderBy(RID).drop(RID).show(rows, truncate=False)


def write_if_changed(path: str | Path, data: bytes) -> bool:
    """Whether the file was written: not if it already holds the data."""
    path = Path(path)
    if path.exists() and path.read_bytes() == data:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return True
