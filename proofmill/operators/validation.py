"""All rules of a catalog over its tables: a list of checks in their fixed order, each a DataFrame of offending rows.

The first error is found by one job over all checks; every offender can be had as a DataFrame of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_text
from ..functions.script import ScriptError
from ..functions.script_columns import compile_expression
from ..plans import errors as e
from ..plans.catalog import PATH, RID, Catalog, Reference, Table
from . import keys

OFFENDER = f"check_no int, {RID} bigint, shown array<string>"


@dataclass
class Check:
    """rows: RID and shown (texts that its error tells); make: the error of a row. Without rows: an error that needs none."""

    name: str
    table: str
    rows: DataFrame | None
    make: Callable[[list[str]], e.ValidationError]


class Validation:
    def __init__(self, catalog: Catalog, frames: dict[str, DataFrame], scripts: tuple[tuple[str, str | None], ...] = ()):
        self.catalog, self.frames, self.scripts = catalog, frames, scripts
        self.checks: list[Check] = []
        for t in catalog.tables.values():
            self._charsets(t)
            self._shapes(t)
        for t in catalog.tables.values():
            self._finite(t)
        for t in catalog.tables.values():
            if t.own_key and t.own_key.key == "primary":
                self._primary(t)
                for r in catalog.references:
                    if r.target == t.name and r.kind == "ref":
                        self._plain(r)
        for t in catalog.tables.values():
            if t.parent:
                self._hierarchy(t)
        for r in catalog.references:
            if catalog[r.target].parent:
                self._to_child(r)
        for t in catalog.tables.values():
            for unique in t.uniques:
                self._unique(t, unique)
        for t in catalog.tables.values():
            if t.checks:
                self._rows(t)

    def add(self, name: str, table: str, rows: DataFrame | None, make: Callable[[list[str]], e.ValidationError], shown: list[Column] | None = None) -> None:
        if rows is not None:
            rows = rows.select(F.col(RID), F.array(*(shown or [F.lit("")])).alias("shown"))
        self.checks.append(Check(name, table, rows, make))

    def text(self, t: Table, column: str) -> Column:
        return as_text(t.column(column).type, F.col(column))

    def _charsets(self, t: Table) -> None:
        for c in t.columns:
            if not c.restricted:
                continue

            def make(shown: list[str], t: Table = t, name: str = c.name, whole: bool = c.type == "INT") -> e.ValidationError:
                if whole:
                    return e.ForeignChildKeyTableIntegerKeyMustBeNonNegative(referred_table=t.name, offending_column=name, offending_value=int(shown[0]))
                return e.ForeignChildKeyTableStringMustBeAlphanumeric(referred_table=t.name, offending_column=name, offending_value=shown[0])

            self.add("key charset", t.name, keys.charset_offenders(self.frames[t.name], c.name), make, [self.text(t, c.name)])

    def _shapes(self, t: Table) -> None:
        for r in self.catalog.references:
            if r.table != t.name or r.kind == "ref":
                continue
            expected = len(r.path)

            def make(shown: list[str], r: Reference = r, expected: int = expected) -> e.ValidationError:
                at = {"referrer_table": r.table, "referrer_column": r.column, "referee_table": r.target, "offending_value": shown[0]}
                if shown[1] == "-1":
                    return e.ForeignChildKeyReferrerCannotHaveWhitespaceInSegments(**at)
                return e.ForeignChildKeyReferrerHasIncorrectSegmentsInCompositeKey(**at, expected_segments=expected, actual_segments=int(shown[1]))

            rows = keys.shape_offenders(self.frames[t.name], r.column, expected)
            self.add("reference shape", t.name, rows, make, [F.col(r.column), F.col("__segments").cast("string")])

    def _finite(self, t: Table) -> None:
        for c in t.columns:
            if c.type == "FLOAT":
                rows = keys.infinite_offenders(self.frames[t.name], c.name)
                text = F.when(F.isnan(c.name), "NaN").otherwise(self.text(t, c.name))
                make = lambda shown, t=t, c=c: e.NanOrInfiniteFloatNumbersAreNotAllowed(table_name=t.name, column_name=c.name, column_value=shown[0], row_index=int(shown[1]))
                self.add("finite", t.name, rows, make, [text, (F.col(RID) + 1).cast("string")])

    def _primary(self, t: Table) -> None:
        key = t.own_key.name
        make = lambda shown: e.DuplicatePrimaryKey(table_name=t.name, value=shown[0])
        self.add("primary key", t.name, keys.later_rows(self.frames[t.name], [key]), make, [self.text(t, key)])

    def _plain(self, r: Reference) -> None:
        here, key = self.catalog[r.table], self.catalog[r.target].own_key.name
        rows = keys.orphans(self.frames[r.table], self.frames[r.target], [(r.column, key)])
        make = lambda shown: e.NonExistingForeignKey(table_with_foreign_key=r.table, foreign_key_column=r.column, referred_table=r.target, referred_table_column=key, key_value=shown[0])
        self.add("reference", r.table, rows, make, [self.text(here, r.column)])

    def _hierarchy(self, t: Table) -> None:
        whole = t.whole_key
        listed = lambda names: f"({', '.join(names)})"
        twice = lambda shown: e.FoundDuplicateChildPrimaryKeySet(table_name=t.name, columns=listed(whole), duplicate_values=listed(shown))
        self.add("child key", t.name, keys.later_rows(self.frames[t.name], whole), twice, [self.text(t, k) for k in whole])
        above = self.catalog[t.parent].whole_key
        rows = keys.orphans(self.frames[t.name], self.frames[t.parent], [(k, k) for k in above])
        lost = lambda shown: e.ParentRecordWithSuchPrimaryKeysDoesntExist(parent_table=t.parent, parent_columns_names_searched=listed(above), parent_columns_to_find=listed(shown))
        self.add("parent", t.name, rows, lost, [self.text(t, k) for k in above])

    def _to_child(self, r: Reference) -> None:
        here, there = self.catalog[r.table], self.catalog[r.target]
        if r.kind == "ref":
            parent, pairs = self.frames[r.target], [*r.shared, (r.column, r.path[0])]
        else:
            parent, pairs = keys.path_pairs(r.shared, r.column, r.path, self.frames[r.target])
        rows = keys.orphans(self.frames[r.table], parent, pairs)
        ours = [a for a, _ in r.shared]
        tables = [(here.column(a).ancestor or here.name) for a in ours]

        def make(shown: list[str]) -> e.ValidationError:
            kind = e.NonExistingParentToChildKey if r.kind == "child" else e.NonExistingForeignKeyToChildTable
            return kind(
                table_parent_keys=shown[1:], table_parent_tables=tables, table_parent_columns=ours, table_with_foreign_key=r.table,
                foreign_key_column=r.column, referred_table=r.target, referred_table_column=PATH.join(r.path) if r.kind != "ref" else there.own_key.name, key_value=shown[0],
            )

        self.add("reference to a child", r.table, rows, make, [self.text(here, r.column), *[self.text(here, a) for a in ours]])

    def _unique(self, t: Table, unique: tuple[str, ...]) -> None:
        make = lambda shown: e.UniqConstraintViolated(table_name=t.name, tuple_definition=f"({', '.join(unique)})", tuple_value=f"({', '.join(shown)})")
        self.add("unique", t.name, keys.later_rows(self.frames[t.name], list(unique)), make, [self.text(t, c) for c in unique])

    def _rows(self, t: Table) -> None:
        compiled = []
        for text in t.checks:
            try:
                compiled.append((text, compile_expression(text, [(c.name, c.type, F.col(c.name)) for c in t.columns], self.scripts, "BOOL")))
            except ScriptError as err:
                said = str(err)
                self.checks.append(Check("row check", t.name, None, lambda _, text=text, said=said: e.LuaCheckExpressionLoadError(table_name=t.name, expression=text, error=said)))
                return
        df = self.frames[t.name]
        for k, (_, c) in enumerate(compiled):  # an interpreted check runs once, and what it says is kept
            df = df.withColumn(f"__check_{k}", F.when(c.wrong, c.said).when(~c.result, F.struct(F.lit("boolean").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit("false").alias("txt"), F.lit(False).alias("flag"), F.lit(None).cast("string").alias("err"))))
        first = F.coalesce(*[F.when(F.col(f"__check_{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"__check_{k}").alias("s"))) for k in range(len(compiled))])
        rows = df.withColumn("__first", first).where("__first is not null")

        def make(shown: list[str]) -> e.ValidationError:
            at = {"table_name": t.name, "expression": compiled[int(shown[0])][0], "column_names": t.names, "row_values": shown[4:]}
            if shown[1] == "error":
                return e.LuaCheckEvaluationError(**at, error=shown[3])
            if shown[1] == "boolean":
                return e.LuaCheckEvaluationFailed(**at, error="Expression check for the row didn't pass.")
            return e.LuaCheckEvaluationErrorUnexpectedReturnType(**at, error=f"Unexpected expression return value, expected boolean, got {shown[1]}")

        told = [F.col("__first.k").cast("string"), *[F.coalesce(F.col(f"__first.s.{x}"), F.lit("")) for x in ("kind", "txt", "err")]]
        self.add("row check", t.name, rows, make, told + [self.text(t, c.name) for c in t.columns])

    # results

    def offenders(self) -> DataFrame | None:
        """check_no, __rid and shown of every offending row of every check; None without checks."""
        found = [c.rows.select(F.lit(k).alias("check_no"), RID, "shown") for k, c in enumerate(self.checks) if c.rows is not None]
        return reduce(DataFrame.unionAll, found) if found else None

    def first_error(self) -> e.ValidationError | None:
        upto = next((k for k, c in enumerate(self.checks) if c.rows is None), len(self.checks))
        found = [c.rows.select(F.lit(k).alias("check_no"), RID, "shown") for k, c in enumerate(self.checks[:upto])]
        if found:
            rows = reduce(DataFrame.unionAll, found).orderBy("check_no", RID).limit(1).collect()
            if rows:
                return self.checks[rows[0]["check_no"]].make(list(rows[0]["shown"]))
        return self.checks[upto].make([]) if upto < len(self.checks) else None

