"""A compiled database: checked tables as DataFrames, and how to read, check and publish them."""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.script import ScriptError
from .functions.script_columns import EXPECTED, with_generated
from .operators import navigation, proofs
from .operators.sql import register, translate
from .operators.validation import Validation
from .operators.views import view_rows
from .plans import errors as e
from .plans.catalog import RID, Catalog, Table
from .plans.ir import Program
from .plans.parser import load_file, parse_text
from .sinks import report, sources as source_sink, stores, typed
from .sources import modules, scripts, tables
from .sources.literals import Loader, check_exclusive

_numbers = itertools.count()


class Database:
    """Tables by name, in the order of their declaration; each has __rid, its dense row number from 0."""

    def __init__(self, spark: SparkSession, program: Program, catalog: Catalog):
        self.spark, self.program, self.catalog = spark, program, catalog
        self.frames: dict[str, DataFrame] = {}
        self.scripts = scripts.texts(program.scripts)
        self._prefix = f"db{next(_numbers)}_"
        self._views: dict[str, str] = {}
        self.edits: list = []

    def table(self, name: str) -> DataFrame:
        return self.frames[name]

    # SQL

    def _sql_tables(self) -> dict[str, tuple[str, list[tuple[str, str]]]]:
        return {n: (v, [(c.name, c.type) for c in self.catalog[n].columns]) for n, v in self._views.items()}

    def _register(self, *names: str) -> None:
        self._views |= register({n: self.frames[n] for n in names}, self._prefix)

    def sql(self, text: str) -> DataFrame:
        """Runs a statement of the SQL that views and proofs use."""
        if not self._views:
            self._register(*self.frames)
        return translate(text, self._sql_tables()).run(self.spark)

    # checks

    def validation(self) -> Validation:
        return Validation(self.catalog, self.frames, self.scripts)

    def offenders(self) -> DataFrame:
        """Every row that breaks a rule: check_no, __rid and the texts that its error tells."""
        found = self.validation().offenders()
        return found if found is not None else self.spark.createDataFrame([], "check_no int, __rid bigint, shown array<string>")

    def validate(self) -> None:
        """Raises the first error, in the fixed order of rules, tables and rows."""
        if error := self.validation().first_error():
            raise error

    def prove(self) -> None:
        sql = [p for p in self.program.proofs if p.language == "SQL"]
        if sql:
            self._register(*self.frames)
            proofs.check_sql(self.spark, sql, self.catalog, self.frames, self._sql_tables())
        if rules := [p for p in self.program.proofs if p.language == "DATALOG"]:
            proofs.check_datalog(self.spark, rules, self.catalog, self.frames)

    def proof_offenders(self, comment: str) -> DataFrame:
        """All rows that offend against the proof of that name, as often as it finds them; its error tells the first proofs.SHOWN of them."""
        found = next((p for p in self.program.proofs if p.comment == comment), None)
        if found is None:
            raise KeyError(comment)
        if found.language == "SQL":
            self._register(*self.frames)
            return proofs.rows_of(self.frames[found.table], proofs.sql_offenders(self.spark, found, self._sql_tables()))
        program, relations = proofs.rules.RuleProgram(), proofs.edb(self.catalog, self.frames)
        for k, p in enumerate(p for p in self.program.proofs if p.language == "DATALOG"):
            rows = proofs.datalog_offenders(self.spark, p, f"rows_against_{k}", program, self.catalog, relations)
            if p is found:
                return proofs.rows_of(self.frames[p.table], rows)
        raise KeyError(comment)

    # navigation

    def pointers(self, name: str) -> DataFrame:
        return navigation.with_pointers(self.catalog, self.frames, name)

    def row(self, name: str, pointer: int) -> dict[str, Any] | None:
        found = self.frames[name].where(F.col(RID) == pointer).collect()
        return {c: found[0][c] for c in self.catalog[name].names} if found else None

    def value(self, name: str, column: str, pointer: int) -> Any:
        found = self.row(name, pointer)
        return None if found is None else found[column]

    def rows_iter(self, name: str) -> DataFrame:
        return self.frames[name].select(RID)

    def length(self, name: str) -> int:
        return self.frames[name].count()

    # outputs

    def to_json(self) -> dict[str, list[dict[str, Any]]]:
        return report.database_json(self.catalog, self.frames)

    def write_json(self, folder: str) -> None:
        report.write_json(self.catalog, self.frames, folder)

    def write_parquet(self, folder: str, pointers: bool = True) -> list[str]:
        return stores.write_parquet(self.catalog, self.frames, folder, pointers)

    def write_module(self, path: str) -> bool:
        """A typed Python module that reads what write_parquet() writes."""
        return typed.write_module(self.catalog, path)

    def write_sqlite(self, path: str) -> None:
        stores.write_sqlite(self.catalog, self.frames, path)

    def write_sources(self) -> list[str]:
        return source_sink.write_back(self.program, self.edits)

    def show(self) -> None:
        report.show(self.catalog, self.frames)


def _generate(spark: SparkSession, table: Table, df: DataFrame, texts: tuple[tuple[str, str | None], ...]) -> DataFrame:
    """df with its generated columns; the first that cannot be computed is an error, found in one job over all of them."""
    generated = [(c.name, c.type, c.generated) for c in table.columns if c.generated is not None]
    if not generated:
        return df
    known = [(c.name, c.type) for c in table.columns if c.generated is None]
    plain = df.drop(*[g[0] for g in generated])
    for k, (name, _, text) in enumerate(generated):
        try:
            with_generated(plain.limit(0), generated[: k + 1], known, texts)
        except ScriptError as err:
            raise e.LuaColumnGenerationExpressionLoadError(table_name=table.name, column_name=name, expression=text, error=str(err)) from None
    out, checks = with_generated(plain, generated, known, texts)
    firsts = out.agg(*[F.min(F.when(said.isNotNull(), F.col(RID))).alias(f"f{k}") for k, said in checks]).first()
    for k, _ in checks:
        if firsts[f"f{k}"] is None:
            continue
        name, kind, text = generated[k]
        shown = [n for n, _ in known] + [g[0] for g in generated[:k]]
        from .functions.numbers import as_text

        row = out.where(F.col(RID) == firsts[f"f{k}"]).select(F.col(f"__said_{k}").alias("said"), F.array(*[as_text(table.column(n).type, F.col(n)) for n in shown] or [F.lit("")]).alias("shown")).first()
        at = {"table_name": table.name, "column_name": name, "input_row_fields": shown, "input_row_values": list(row["shown"]) if shown else [], "expression": text}
        if row["said"]["kind"] == "error":
            raise e.LuaColumnGenerationExpressionComputeError(**at, error=row["said"]["err"])
        raise e.LuaColumnGenerationExpressionComputeTypeMismatch(**at, computed_value=row["said"]["txt"], error=f"Computed column expects lua expression to evaluate to type {EXPECTED[kind]}, got {row['said']['kind']}")
    return out.select(RID, *table.names)


def build(
    spark: SparkSession, program: Program, data_modules: Mapping[str, Callable[[], modules.Rows]] | None = None, inputs: Mapping[str, DataFrame] | None = None, check: bool = True,
) -> Database:
    """Tables from a program; inputs are DataFrames whose rows come after a table's literals."""
    machine = scripts.run_scripts(program.scripts)
    catalog = Catalog(program)
    check_exclusive(program)
    loader = Loader(program, catalog)
    loaded = loader.run()
    if program.scripts:
        for segment in scripts.queued(machine, catalog):
            loader.add_objects(segment)
    for module in program.modules:
        for segment in modules.segments(module, catalog, data_modules or {}):
            loader.add_objects(segment)
    loader.finish()
    db = Database(spark, program, catalog)
    db.edits = loaded.edits
    for t in catalog.tables.values():
        if t.view_sql is not None:
            db.frames[t.name] = tables.from_rows(spark, t, [])
            continue
        rows = loaded.rows[t.name]
        df = tables.from_rows(spark, t, rows)
        if inputs and t.name in inputs:
            own = tables.bound(inputs[t.name], t, len(rows))
            df = df.unionByName(own) if rows else own
        db.frames[t.name] = _generate(spark, t, df, db.scripts)
    views = [t for t in catalog.tables.values() if t.view_sql is not None]
    if views:
        db._register(*db.frames)
        for t in views:
            db.frames[t.name] = view_rows(spark, t, db._sql_tables())
            db._register(t.name)
    if check:
        db.validate()
        db.prove()
    return db


def read_replacements(program: Program, replacements: str | Path | Mapping[str, Any] | None) -> None:
    """{table: [{primary_key, replacements: {column: value}}]}, as a mapping or in a JSON file."""
    if replacements is None:
        return
    found = replacements if isinstance(replacements, Mapping) else json.loads(Path(replacements).read_text(encoding="utf-8"))
    for table, entries in found.items():
        program.replacements.setdefault(table, []).extend((x["primary_key"], x["replacements"]) for x in entries)


def compile_text(spark: SparkSession, text: str, replacements: Mapping[str, Any] | None = None, **options: Any) -> Database:
    program = parse_text(text, Program())
    read_replacements(program, replacements)
    return build(spark, program, **options)


def compile_files(spark: SparkSession, paths: list[str], replacements: str | Path | Mapping[str, Any] | None = None, **options: Any) -> Database:
    """Files in order, as one program; with replacements, its files are rewritten once all checks have passed."""
    program = Program()
    for p in paths:
        load_file(Path(p), program)
    read_replacements(program, replacements)
    db = build(spark, program, **options)
    if db.edits:
        db.write_sources()
    return db


def dump_program(program: Program, path: str) -> None:
    Path(path).write_bytes(pickle.dumps(program))


def load_program(path: str) -> Program:
    """A program that dump_program() has written; only from a place that is trusted."""
    return pickle.loads(Path(path).read_bytes())
