"""A typed Python module for a database that is written as Parquet: a class for each table's rows, and methods that read them."""

from __future__ import annotations

import keyword
from pathlib import Path

from ..plans.catalog import Catalog
from .report import write_if_changed

_PYTHON = {"TEXT": "str", "INT": "int", "FLOAT": "float", "BOOL": "bool"}

HEAD = '''"""Made by proofmill from a database's tables; the rows stand in Parquet beside it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

'''

BASE = '''

class Database:
    """The tables under a folder. A pointer is a row's number in its table, from 0."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _row(self, name: str, pointer: int, columns: list[str]) -> tuple:
        found = self._table(name).where(F.col("__rid") == pointer).select(*columns).collect()
        if not found:
            raise IndexError(f"{name} has no row {pointer}")
        return tuple(found[0])
'''


def _fields(catalog: Catalog, table: str) -> list[tuple[str, str, str]]:
    """(column, type in Python, what it is) of a table as it is published: row numbers in place of references, lists of rows that refer to it."""
    t = catalog[table]
    pointers = {r.column: r.target for r in catalog.references if r.table == table}
    out = [(c.name, "int", f"row of {pointers[c.name]}") if c.name in pointers else (c.name, _PYTHON[c.type], "") for c in t.columns if c.key != "inherited"]
    if t.parent:
        out.append(("parent", "int", f"row of {t.parent}"))
    out += [(f"children_{x}", "list[int]", f"rows of {x}") for x in catalog.children(table)]
    return out + [(f"referrers_{r.table}__{r.column}", "list[int]", f"rows of {r.table}") for r in catalog.references if r.target == table]


def module(catalog: Catalog) -> str:
    """The module's text. Fields whose names Python reserves, or that start with an underscore, get a plain name of their own."""
    rows, methods = [], []
    for name in sorted(catalog.tables):
        kind = "".join(p.capitalize() for p in name.split("_")) + "Row"
        fields = _fields(catalog, name)
        safe = {c: f"c_{c}" if keyword.iskeyword(c) or c.startswith("_") or c in ("count", "index") else c for c, _, _ in fields}
        rows.append(f"\nclass {kind}(NamedTuple):\n" + "".join(f"    {safe[c]}: {t}{f'  # {said}' if said else ''}\n" for c, t, said in fields))
        columns = [c for c, _, _ in fields]
        methods.append(
            f'\n    def {name}(self) -> DataFrame:\n        return self._table("{name}")\n\n    def {name}_len(self) -> int:\n        return self._table("{name}").count()\n'
            f'\n    def {name}_rows(self) -> DataFrame:\n        """The pointers of all rows."""\n        return self._table("{name}").select("__rid")\n'
            f'\n    def {name}_row(self, pointer: int) -> {kind}:\n        return {kind}(*self._row("{name}", pointer, {columns!r}))\n'
        )
    return HEAD + "\n".join(rows) + BASE + "".join(methods)


def write_module(catalog: Catalog, path: str) -> bool:
    """Whether the module was written: not if the file already holds it."""
    return write_if_changed(Path(path), module(catalog).encode())
