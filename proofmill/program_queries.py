"""Whole programs over the test tables, and the same in SQL: rows from literals, scripts, modules and frames, references, errors, outputs, rules.

Literals and modules take the smallest tables (region, nation), whose size is fixed; everything else comes in as frames.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database, build, compile_files, compile_text, dump_program, load_program
from .operators import datalog
from .operators.validation import Validation
from .plans import errors as e
from .plans import rules
from .plans.catalog import RID
from .plans.ir import Program
from .plans.parser import parse, parse_text
from .sources.staging import Rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small(spark: SparkSession, sf: str, name: str) -> list[tuple]:
    """The rows of region or nation, in order of their keys."""
    df = load(spark, sf, name)
    return [tuple(r) for r in df.orderBy(df.columns[0]).collect()]


def table(db: Database, name: str) -> DataFrame:
    return db.table(name).drop(RID)


def folder(spark: SparkSession) -> str:
    """A place of its own in the shared folder."""
    return Rounds(spark).at


PLACES = """
TABLE region { r_regionkey INT PRIMARY KEY, r_name TEXT }  // five of them
TABLE nation { n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey REF region }
"""


def literals(spark: SparkSession, sf: str) -> str:
    rows = "".join(f'{k}, "{name}";\n' for k, name in small(spark, sf, "region"))
    more = "".join(f'{k}, "{name}", {r}; // row {k}\n' for k, name, r in small(spark, sf, "nation"))
    return f"{PLACES}DATA region {{ {rows} }}\nDATA nation(n_nationkey, n_name, n_regionkey) {{ {more} }}\n"


# rows of programs


@query("program_literals", NATION)
def _(spark, sf):
    return table(compile_text(spark, literals(spark, sf)), "nation")


@query("program_literal_types", "SELECT CAST(n_nationkey AS BIGINT) AS i, n_nationkey / 4.0 AS f, n_nationkey % 2 = 0 AS b, concat(' ', n_name, ' ') AS t FROM nation")
def _(spark, sf):
    rows = "".join(f'{k}, {k / 4}, {str(k % 2 == 0).lower()}, " {name} ";' for k, name, _ in small(spark, sf, "nation"))
    return table(compile_text(spark, f"TABLE t {{ i INT, f FLOAT, b BOOL, t TEXT }} DATA t {{ {rows} }}"), "t")


@query("program_nested_rows", NATION.replace("n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey", "n_name, CAST(n_regionkey AS BIGINT) AS r_regionkey"))
def _(spark, sf):
    """Children stand inside of their parents and take their keys from them."""
    nations = small(spark, sf, "nation")
    inner = lambda r: "".join(f'{k}, "{name}";' for k, name, own in nations if own == r)
    rows = "".join(f'{r}, "{name}" WITH nation {{ {inner(r)} }};' for r, name in small(spark, sf, "region"))
    text = f"TABLE region {{ r_regionkey INT PRIMARY KEY, r_name TEXT }} TABLE nation {{ n_nationkey INT PRIMARY KEY CHILD OF region, n_name TEXT }} DATA region {{ {rows} }}"
    return table(compile_text(spark, text), "nation")


@query("program_nested_objects", NATION)
def _(spark, sf):
    """Objects inside of the row that they refer to; each names its own fields."""
    nations = small(spark, sf, "nation")
    inner = lambda r: ", ".join(f'{{ n_name: "{name}", n_nationkey: {k} }}' for k, name, own in nations if own == r)
    rows = ", ".join(f'{{ r_regionkey: {r}, r_name: "{name}", WITH nation [ {inner(r)} ] }}' for r, name in small(spark, sf, "region"))
    return table(compile_text(spark, f"{PLACES}DATA STRUCT region [ {rows} ]"), "nation")


@query("program_defaults", "SELECT o_orderkey, 'pending' AS status, 'none given' AS prio, CAST(2.5 AS DOUBLE) AS factor, CAST(-7 AS BIGINT) AS n, true AS open FROM orders")
def _(spark, sf):
    text = "TABLE t { o_orderkey INT PRIMARY KEY, status TEXT DEFAULT pending, prio TEXT DETACHED DEFAULT, factor FLOAT DEFAULT 2.5, n INT DETACHED DEFAULT, open BOOL DEFAULT true } DEFAULTS { t.prio none given, t.n -7 }"
    return table(compile_text(spark, text, inputs={"t": load(spark, sf, "orders").select("o_orderkey")}), "t")


@query("program_scripted_rows", "SELECT i AS id, i * i AS square, concat('n', i) AS label, i % 3 = 0 AS third FROM range(1, 201) AS t(i)")
def _(spark, sf):
    text = """
TABLE t { id INT PRIMARY KEY, square INT, label TEXT, third BOOL GENERATED AS { id % 3 == 0 } }
INCLUDE LUA {
    local function row(i) return { id = i, square = i * i, label = "n" .. i } end
    for i = 1, 200 do data("t", row(i)) end
}
"""
    return table(compile_text(spark, text), "t")


@query("program_module_rows", NATION)
def _(spark, sf):
    def rows():
        names = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}
        return {t: [dict(zip(cols, r, strict=True)) for r in small(spark, sf, t)] for t, cols in names.items()}

    return table(compile_text(spark, PLACES + 'DATA MODULE OCAML "places"', data_modules={"places": rows}), "nation")


@query("program_segments", "SELECT k, row_number() OVER (ORDER BY part, k) - 1 AS rid FROM (SELECT 0 AS part, r_regionkey + 1000 AS k FROM region UNION ALL SELECT 1, o_orderkey + 5000 FROM orders)")
def _(spark, sf):
    """Literals in their order, then a frame's rows in theirs: one table with dense row numbers."""
    rows = small(spark, sf, "region")
    first, second = (";".join(str(r[0] + 1000) for r in part) for part in (rows[:2], rows[2:]))
    orders = load(spark, sf, "orders").select((F.col("o_orderkey") + 5000).alias("k")).orderBy("k")
    db = compile_text(spark, f"TABLE t {{ k INT }} DATA t {{ {first} }} DATA t {{ {second} }}", inputs={"t": orders})
    return db.table("t").select("k", F.col(RID).alias("rid"))


@query("program_aggregated_input", "SELECT l_suppkey AS k, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(1 AS BIGINT) AS once FROM lineitem GROUP BY 1")
def _(spark, sf):
    """A frame that comes from a shuffle: each of its rows has a row number of its own."""
    made = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    db = compile_text(spark, "TABLE t { k INT PRIMARY KEY, n INT, q FLOAT, CHECK { n > 0 } }", inputs={"t": made})
    rows = db.table("t")
    places = rows.groupBy(RID).agg(F.count("*").alias("once"))
    return rows.join(places.where(F.col(RID) < rows.count()), RID).select("k", "n", "q", "once")


@query("program_replacements", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THIRD' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 24 THEN 0 ELSE CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation")
def _(spark, sf):
    changes = {"nation": [{"primary_key": "3", "replacements": {"n_name": "THIRD"}}, {"primary_key": "24", "replacements": {"n_regionkey": "0"}}]}
    return table(compile_text(spark, literals(spark, sf), changes), "nation")


def _files(spark: SparkSession, sf: str, top: str) -> Path:
    at = Path(top)
    (at / "sub").mkdir()
    text = literals(spark, sf)
    cut = text.index("DATA region")
    (at / "sub" / "rows.facts").write_text(text[cut:], encoding="utf-8")
    (at / "sub" / "more.lua").write_text('data("region", { r_regionkey = 99, r_name = "added" })', encoding="utf-8")
    (at / "root.facts").write_text('INCLUDE "sub/rows.facts"\nINCLUDE LUA "sub/more.lua"\n' + text[:cut], encoding="utf-8")
    return at


@query("program_files", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 99, 'added'")
def _(spark, sf):
    """Files that include each other, and a script beside them."""
    with tempfile.TemporaryDirectory() as top:
        return table(compile_files(spark, [str(_files(spark, sf, top) / "root.facts")]), "region")


@query("program_write_back", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 5 THEN concat('N', n_nationkey) ELSE n_name END AS n_name FROM nation")
def _(spark, sf):
    """Replacements are written into the program's own files, which are then read again."""
    with tempfile.TemporaryDirectory() as top:
        root = str(_files(spark, sf, top) / "root.facts")
        compile_files(spark, [root], {"nation": [{"primary_key": str(k), "replacements": {"n_name": f"N{k}"}} for k in range(5)]})
        return table(compile_files(spark, [root]), "nation").select("n_nationkey", "n_name")


@query("program_dump", NATION)
def _(spark, sf):
    """A program that is parsed, written, read again and built."""
    with tempfile.TemporaryDirectory() as top:
        dump_program(parse_text(literals(spark, sf), Program()), f"{top}/p")
        return table(build(spark, load_program(f"{top}/p")), "nation")


@query("command_line", NATION)
def _(spark, sf):
    """The shell command: files in, Parquet with row numbers in place of references out; the regions' are their keys."""
    from . import cli

    at = folder(spark)
    with tempfile.TemporaryDirectory() as top:
        root = str(_files(spark, sf, top) / "root.facts")
        if cli.main([root, f"--parquet-output-directory={at}"], spark):
            raise RuntimeError("the command failed")
    return spark.read.parquet(f"{at}/nation").select("n_nationkey", "n_name", "n_regionkey")


@query("matview_bool_arith", "SELECT CAST(p_partkey * CAST(p_size % 2 = 0 AS BIGINT) AS BIGINT) AS even_id, p_size % 2 = 0 AS even, CAST(p_partkey AS VARCHAR) AS said FROM part")
def _(spark, sf):
    """A view over a BOOL column that counts as 0 or 1, and that becomes a BOOL again."""
    text = """
TABLE part { p_partkey INT PRIMARY KEY, p_size INT, even BOOL GENERATED AS { p_size % 2 == 0 } }
MATERIALIZED VIEW v { even_id INT, even BOOL, said TEXT } AS { SELECT p_partkey * even, even, p_partkey FROM part }
"""
    return table(compile_text(spark, text, inputs={"part": load(spark, sf, "part")}), "v")


# references and navigation


TREE = """
TABLE region { r_regionkey INT PRIMARY KEY, r_name TEXT, largest REF CHILD nation }
TABLE nation { n_nationkey INT PRIMARY KEY CHILD OF region, n_name TEXT }
TABLE supplier { s_suppkey INT PRIMARY KEY, home REF FOREIGN CHILD nation }
"""


def tree(spark: SparkSession, sf: str) -> Database:
    nation = load(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    top = nation.groupBy("r_regionkey").agg(F.max("n_nationkey").cast("string").alias("largest"))
    region = load(spark, sf, "region").join(top, "r_regionkey").orderBy("r_regionkey")
    supplier = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("=>", "r_regionkey", "n_nationkey").alias("home"))
    return compile_text(spark, TREE, inputs={"region": region, "nation": nation.orderBy("n_nationkey"), "supplier": supplier})


@query("reference_across_hierarchies", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS home FROM supplier")
def _(spark, sf):
    return tree(spark, sf).pointers("supplier").select("s_suppkey", "home")


@query("reference_to_own_child", "SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey, CAST(max(n_nationkey) AS BIGINT) AS largest FROM nation GROUP BY 1")
def _(spark, sf):
    return tree(spark, sf).pointers("region").select("r_regionkey", "largest")


@query("navigate_parent", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS parent, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS referrers FROM nation")
def _(spark, sf):
    rows = tree(spark, sf).pointers("nation")
    return rows.select("n_nationkey", "parent", F.size("referrers_supplier__home").cast("long").alias("referrers"))


@query("navigate_rows", "SELECT count(*) AS n, count(*) AS seen, max(CASE WHEN n_nationkey = 7 THEN n_name END) AS name, max(CASE WHEN n_nationkey = 24 THEN CAST(n_regionkey AS BIGINT) END) AS region FROM nation")
def _(spark, sf):
    """length, rows_iter, value and row of a database."""
    db = tree(spark, sf)
    said = (db.length("nation"), db.rows_iter("nation").count(), db.value("nation", "n_name", 7), db.row("nation", 24)["r_regionkey"])
    return spark.createDataFrame([said], "n bigint, seen bigint, name string, region bigint")


@query("navigate_metadata", "SELECT * FROM (VALUES ('nation', 'region', 'r_regionkey,n_nationkey', ''), ('region', '', 'r_regionkey', 'nation'), ('supplier', '', 's_suppkey', '')) AS t(name, parent, whole_key, children)")
def _(spark, sf):
    from .plans.catalog import Catalog

    found = Catalog(parse(TREE))
    rows = [(n, t.parent or "", ",".join(t.whole_key), ",".join(found.children(n))) for n, t in found.tables.items()]
    return spark.createDataFrame(rows, "name string, parent string, whole_key string, children string")


# offenders and errors


@query(
    "program_offenders",
    "SELECT 'child key' AS rule, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS k FROM lineitem) WHERE k > 1"
    " UNION ALL SELECT 'parent', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"
    " UNION ALL SELECT 'row check', count(*) FROM lineitem WHERE NOT (l_quantity < 50)"
    " UNION ALL SELECT 'primary key', 0 UNION ALL SELECT 'unique', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem)) UNION ALL SELECT 'finite', 0",
)
def _(spark, sf):
    """Every row that breaks a rule of a program, counted by the kind of rule."""
    text = "TABLE o { l_orderkey INT PRIMARY KEY } TABLE l { l_linenumber INT PRIMARY KEY CHILD OF o, l_partkey INT, l_suppkey INT, l_quantity FLOAT, CHECK { l_quantity < 50 }, UNIQUE(l_partkey, l_suppkey, l_linenumber) }"
    kept = load(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    db = build(spark, parse(text), inputs={"o": kept, "l": load(spark, sf, "lineitem")}, check=False)
    found: Validation = db.validation()
    kinds = spark.createDataFrame([(k, c.name) for k, c in enumerate(found.checks)], "check_no int, rule string")
    counts = found.offenders().groupBy("check_no").agg(F.count("*").alias("n"))
    return kinds.join(counts, "check_no", "left").groupBy("rule").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def _raised(spark: SparkSession, text: str, **options) -> e.ValidationError | None:
    try:
        compile_text(spark, text, **options)
    except e.ValidationError as err:
        return err
    return None


@query("proof_report", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, row_number() OVER (ORDER BY 'n_name' || n_name) AS place FROM nation WHERE n_regionkey = 2")
def _(spark, sf):
    """The rows that a failing proof of rules tells: JSON, whole numbers as floats, in the order of their texts."""
    text = "TABLE nation { n_name TEXT, n_nationkey INT, n_regionkey INT }\nPROOF \"none in two\" NONE EXIST OF nation DATALOG { OUTPUT(Offender) :- t_nation__n_regionkey(2, Offender). }"
    err = _raised(spark, text, inputs={"nation": load(spark, sf, "nation")})
    rows = [json.loads(x) for x in err.offending_columns]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], k) for k, r in enumerate(rows, 1)], "n_nationkey double, n_name string, place bigint")


FAULTS = {
    "charset": ("TABLE t { A INT }", "ColumnNameIsNotLowercase"),
    "child of nothing": ("TABLE t { a INT PRIMARY KEY CHILD OF u }", "NonExistingChildPrimaryKeyTable"),
    "cycle": ("TABLE t { a INT PRIMARY KEY CHILD OF u } TABLE u { b INT PRIMARY KEY CHILD OF t }", "ChildPrimaryKeysLoopDetected"),
    "cells": ("TABLE t { a INT } DATA t { 1, 2 }", "DataTooManyColumns"),
    "exclusive": ("TABLE t { a INT } DATA EXCLUSIVE t { 1 } DATA t { 2 }", "ExclusiveDataDefinedMultipleTimes"),
    "default missing": ("TABLE t { a INT DETACHED DEFAULT }", "DetachedDefaultUndefined"),
    "finite": ("TABLE t { a FLOAT } DATA t { inf }", "NanOrInfiniteFloatNumbersAreNotAllowed"),
    "nested ambiguous": ("TABLE t { a INT PRIMARY KEY } TABLE u { x REF t, y REF t } DATA t { 1 WITH u { } }", None),
    "parent tuple twice": ("TABLE t { a INT PRIMARY KEY } TABLE u { b INT PRIMARY KEY CHILD OF t } DATA t { 1 WITH u { 5; 5 } }", "FoundDuplicateChildPrimaryKeySet"),
    "proof of another table": ('TABLE t { id INT } TABLE u { id INT } PROOF "c" NONE EXIST OF t { SELECT rowid FROM u }', "SqlProofQueryColumnOriginMismatchesExpected"),
    "rules of wrong types": ('TABLE t { id INT } DATA t { 1 } PROOF "c" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id("1", Offender). }', "DatalogProofQueryingFailure"),
    "type": ("TABLE t { a BLOB }", "UnknownColumnType"),
    "unique as a set": ("TABLE t { a INT, b INT, UNIQUE(a, b), UNIQUE(b, a) }", "DuplicateUniqConstraints"),
    "view of a wrong type": ("MATERIALIZED VIEW v { a INT } AS { SELECT 'x' }", "SqlMatViewWrongColumnTypeReturned"),
    "view of too few columns": ("MATERIALIZED VIEW v { a INT, b INT } AS { SELECT 1 }", "SqlMatViewWrongColumnCount"),
    "view that writes": ("MATERIALIZED VIEW v { a INT } AS { DELETE FROM v }", "SqlMatViewStatementQueryException"),
}
FAULTS.pop("nested ambiguous")


@query("program_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[1]}')" for k, v in FAULTS.items()) + ") AS t(fault, error)")
def _(spark, sf):
    """The kinds of errors that faulty programs raise."""
    return spark.createDataFrame([(k, type(_raised(spark, text)).__name__) for k, (text, _) in FAULTS.items()], "fault string, error string")


# outputs


@query("output_json", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def _(spark, sf):
    at = folder(spark)
    compile_text(spark, literals(spark, sf)).write_json(at)
    return spark.read.json(f"{at}/nation")


@query("output_parquet", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS region_row, CAST(n_nationkey AS BIGINT) AS rid FROM nation")
def _(spark, sf):
    """Tables as they are published: row numbers in place of references."""
    at = folder(spark)
    compile_text(spark, literals(spark, sf)).write_parquet(at)
    return spark.read.parquet(f"{at}/nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region_row"), F.col(RID).alias("rid"))


@query("output_typed_module", "SELECT count(*) AS n, max(CASE WHEN n_nationkey = 7 THEN n_name END) AS name, max(CASE WHEN n_nationkey = 7 THEN CAST(n_regionkey AS BIGINT) END) AS region, CAST(5 AS BIGINT) AS children, '' AS written_again, '' AS damaged FROM nation")
def _(spark, sf):
    """A module made for the database reads it: rows by pointers, lists of children. Unchanged tables are not written again, and their checksums hold."""
    import importlib.util

    from .sinks.stores import verify

    at, db = folder(spark), compile_text(spark, literals(spark, sf))
    db.write_parquet(at)
    with tempfile.TemporaryDirectory() as top:
        db.write_module(f"{top}/places.py")
        spec = importlib.util.spec_from_file_location("places", f"{top}/places.py")
        places = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(places)
    made = places.Database(spark, at)
    row = made.nation_row(7)
    said = (made.nation_len(), row.n_name, row.n_regionkey, len(made.region_row(row.n_regionkey).referrers_nation__n_regionkey), ",".join(db.write_parquet(at)), ",".join(verify(spark, at)))
    return spark.createDataFrame([said], "n bigint, name string, region bigint, children bigint, written_again string, damaged string")


@query("output_sqlite", "SELECT CAST(n_nationkey AS BIGINT) + 1 AS row_id, n_name, CAST(3 AS BIGINT) AS indexes FROM nation")
def _(spark, sf):
    """A file of the embedded database: rowids from 1, an index for each column."""
    with tempfile.TemporaryDirectory() as top:
        compile_text(spark, literals(spark, sf)).write_sqlite(f"{top}/d.db")
        with sqlite3.connect(f"{top}/d.db") as db:
            n = db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'index' AND tbl_name = 'nation' AND sql IS NOT NULL").fetchone()[0]
            rows = [(*r, n) for r in db.execute("SELECT rowid, n_name FROM nation")]
    return spark.createDataFrame(rows, "row_id bigint, n_name string, indexes bigint")


# rules


def rule(name: str, text: str, answer: str, columns: list[str], oracle: str, **relations: tuple[str, list[str]]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        given = {}
        for r, (t, cols) in relations.items():
            df = load(spark, sf, t).select(*cols)
            given[r] = df.select(*[F.col(c).cast("bigint").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes]).distinct()
        return datalog.evaluate(spark, rules.read(text), given).relations[answer].toDF(*columns)

    query(name, oracle)(run)


rule(
    "dl_facts", 'kind("1-URGENT", 1). kind("2-HIGH", 1). kind("5-LOW", 3). answer(O, K) :- orders(O, P), kind(P, K).', "answer", ["o", "k"],
    "SELECT o_orderkey AS o, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE 1 END AS BIGINT) AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')", orders=("orders", ["o_orderkey", "o_orderpriority"]),
)


@query("dl_query", "SELECT o_orderkey AS x FROM orders WHERE o_custkey = 7")
def _(spark, sf):
    """A query over given facts: the values of its variables."""
    program = rules.read("owns(C, O) :- orders(O, C). ?- owns(7, X).")
    out = datalog.evaluate(spark, program, {"orders": load(spark, sf, "orders").select("o_orderkey", "o_custkey")})
    return out.query(program.queries[0]).toDF("x")


@query("dl_pragmas", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey > 1")
def _(spark, sf):
    """Declared relations, facts from a file, a dependency, and an output that is read again."""
    at = folder(spark)
    load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(f"{at}/in")
    text = f"""
.assert nation(id: integer, name: string, region: integer).
.infer far(name: string, region: integer).
.fd nation: id --> name.
.input(nation, "{at}/in", "csv").
.output(far, "{at}/out", "json").
far(N, R) :- nation(_, N, R), R > 1.
"""
    datalog.evaluate(spark, rules.read(text))
    return spark.read.json(f"{at}/out")


@query("dl_constraint", "SELECT CASE WHEN EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0) THEN 'violated' ELSE 'holds' END AS negative, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) THEN 'violated' ELSE 'holds' END AS price")
def _(spark, sf):
    """Rules with an empty head: no row may satisfy their bodies."""
    given = {"customer": load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "orders": load(spark, sf, "orders").select("o_custkey", "o_totalprice")}

    def said(text: str) -> str:
        try:
            datalog.evaluate(spark, rules.read(text), given)
        except rules.RuleError as err:
            return "violated" if "constraint" in str(err) else str(err)
        return "holds"

    rows = [(said(":- customer(X, B), orders(X, _), B < 0.0."), said(":- orders(_, P), P < 0.0."))]
    return spark.createDataFrame(rows, "negative string, price string")
