"""Materialized views: a statement's rows, typed, in the order of their texts, with row numbers of their own."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import real_text
from ..plans import errors as e
from ..plans.catalog import Table
from ..plans.sqltext import SqlSyntaxError, Unsupported
from ..sources.tables import after, placed, ranged
from .sql import Query, translate

STORED = {"INT": "INT", "REAL": "FLOAT", "TEXT": "TEXT"}
#: What each stored type may become.
ACCEPTED = {"INT": ("INT", "FLOAT", "TEXT", "BOOL"), "REAL": ("FLOAT", "TEXT"), "TEXT": ("TEXT",)}


def typed(stored: str, wanted: str, c: Column) -> Column:
    if wanted == "TEXT":
        return real_text(c) if stored == "REAL" else c.cast("string")
    if wanted == "FLOAT":
        return c.cast("double")
    return c != 0 if wanted == "BOOL" else c


def from_json(wanted: str, c: Column) -> tuple[Column, Column]:
    """A JSON value as the wanted type, and where it is not of it."""
    kind = {"INT": "bigint", "FLOAT": "double", "TEXT": "string", "BOOL": "bigint"}[wanted]
    value = c.try_cast(kind)
    bad = c.isNotNull() & value.isNull()
    return (value != 0 if wanted == "BOOL" else value), bad


def view_rows(spark: SparkSession, table: Table, tables: dict[str, tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """The rows of a view, numbered. Rows with NULL or a value of a wrong type are errors."""
    sql = table.view_sql or ""
    at = {"table_name": table.name, "sql_expression": sql}
    try:
        query: Query = translate(sql, tables)
    except (SqlSyntaxError, Unsupported) as err:
        raise e.SqlMatViewStatementPrepareException(**at, error=str(err)) from None
    if query.writes:
        raise e.SqlMatViewStatementQueryException(**at, error="attempt to write a readonly database")
    if len(query.outputs) != len(table.columns):
        raise e.SqlMatViewWrongColumnCount(**at, expected_columns=len(table.columns), actual_columns=len(query.outputs))
    if query.params:
        raise e.SqlMatViewStatementInitException(**at, error=f"Wrong number of parameters passed to query. Got 0, needed {query.params}")
    try:
        df = query.run(spark)
    except PySparkException as err:
        raise e.SqlMatViewStatementPrepareException(**at, error=str(err)) from None
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    picked, wrong, kinds = [], [], []
    for i, (o, c) in enumerate(zip(query.outputs, table.columns, strict=True)):
        col = F.col(f"c{i}")
        wrong.append(F.when(col.isNull(), F.struct(F.lit(i).alias("i"), F.lit("").alias("kind"))))
        if o.expr.type == "ANY":
            value, bad = from_json(c.type, col)
            wrong.append(F.when(bad, F.struct(F.lit(i).alias("i"), F.lit("TEXT").alias("kind"))))
            kinds.append("TEXT")
        elif o.expr.type == "NULL":
            value = F.lit(None).cast({"TEXT": "string", "INT": "bigint", "FLOAT": "double", "BOOL": "boolean"}[c.type])
            kinds.append("INT")
        else:
            stored = o.expr.type
            if c.type not in ACCEPTED[stored]:
                wrong.append(F.when(col.isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(STORED[stored]).alias("kind"))))
                value = F.lit(None).cast({"TEXT": "string", "INT": "bigint", "FLOAT": "double", "BOOL": "boolean"}[c.type])
            else:
                value = typed(stored, c.type, col)
            kinds.append(stored)
        picked.append(value.alias(c.name))
    texts = [(real_text(F.col(f"c{i}")) if k == "REAL" else F.col(f"c{i}").cast("string")).alias(f"t{i}") for i, k in enumerate(kinds)]
    keys = [f"t{i}" for i in range(len(kinds))]
    rows = df.select(*picked, *texts, F.coalesce(*wrong).alias("__bad"), F.monotonically_increasing_id().alias("__seen"))
    try:
        staged = placed(ranged(rows, keys), "view")  # the statement runs once, for its checks and for its rows
        first = staged.where("__bad is not null").select("__seen", "__bad").orderBy("__seen").limit(1).collect()
    except PySparkException as err:
        raise e.SqlMatViewStatementQueryException(**at, error=str(err)) from None
    if first:
        found = first[0]["__bad"]
        column = table.columns[found["i"]]
        spot = {"column_name": column.name, "return_row_index": staged.where(F.col("__seen") < first[0]["__seen"]).count() + 1}
        if not found["kind"]:
            raise e.SqlMatViewNullReturnsUnsupported(**at, **spot)
        raise e.SqlMatViewWrongColumnTypeReturned(**at, **spot, actual_column_type=found["kind"], expected_column_type=column.type)
    return after(staged, table.names)
