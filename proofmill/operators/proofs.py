"""Proofs: statements and rules that must find no row of a table."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import errors as e
from ..plans import rules
from ..plans.catalog import RID, Catalog
from ..plans.ir import Proof
from ..plans.sqltext import SqlSyntaxError, Unsupported
from ..sinks.report import pretty
from . import datalog
from .sql import Query, translate

HEADER = "OUTPUT(Offender)"
#: Offending rows that an error tells; Database.proof_offenders() has all of them, as a DataFrame.
SHOWN = 10_000


def sql_offenders(spark: SparkSession, proof: Proof, tables: dict[str, tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """__rid of each offender that the statement returns, repeated if it repeats."""
    at = {"table_name": proof.table, "comment": proof.comment, "proof_expression": proof.text}
    try:
        query: Query = translate(proof.text, tables)
    except (SqlSyntaxError, Unsupported) as err:
        raise e.SqlProofQueryPlanningError(**at, error=str(err)) from None
    if query.writes:
        raise e.SqlProofQueryError(**at, error="attempt to write a readonly database")
    if len(query.outputs) != 1:
        raise e.SqlProofQueryErrorSingleRowIdColumnExpected(**at, error=f"Required output column count is 1, got {len(query.outputs)}")
    out = query.outputs[0]
    if out.name != "rowid":
        raise e.SqlProofQueryErrorSingleRowIdColumnExpected(**at, error=f"Required output column name must be rowid, got {out.name}")
    origin = out.expr.origin or ("NULL", "NULL")
    if origin != (proof.table, "rowid"):
        raise e.SqlProofQueryColumnOriginMismatchesExpected(
            error="Actual column origin table name or origin mistmaches expectations", expected_column_origin_table=proof.table, expected_column_origin_name="rowid",
            actual_column_origin_table=origin[0], actual_column_origin_name=origin[1], comment=proof.comment, proof_expression=proof.text,
        )
    if query.params:
        raise e.SqlProofQueryError(**at, error=f"Wrong number of parameters passed to query. Got 0, needed {query.params}")
    try:
        return query.run(spark).select((F.col("rowid") - 1).alias(RID))
    except PySparkException as err:
        raise e.SqlProofQueryPlanningError(**at, error=str(err)) from None


def rows_of(table: DataFrame, offenders: DataFrame) -> DataFrame:
    """The offenders' rows, as often as they are found."""
    return offenders.join(table, RID)


def check_sql(spark: SparkSession, proofs: list[Proof], catalog: Catalog, frames: dict[str, DataFrame], tables: dict[str, tuple[str, list[tuple[str, str]]]]) -> None:
    for p in proofs:
        if p.table not in catalog.tables:
            raise e.SqlProofTableNotFound(table_name=p.table, comment=p.comment, proof_expression=p.text)
    for p in proofs:
        found = sql_offenders(spark, p, tables)
        numbered = found.withColumn("__n", F.monotonically_increasing_id())
        try:
            rows = rows_of(frames[p.table], numbered).orderBy("__n").limit(SHOWN).drop("__n").collect()
        except PySparkException as err:
            raise e.SqlProofQueryError(table_name=p.table, comment=p.comment, proof_expression=p.text, error=str(err)) from None
        if rows:
            raise e.SqlProofOffendersFound(table_name=p.table, comment=p.comment, proof_expression=p.text, offending_columns=[pretty(catalog[p.table], r) for r in rows])


def edb(catalog: Catalog, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A relation t_<table>__<column>(value, row) for each column; relations that no rule reads cost nothing."""
    return {f"t_{t.name}__{c.name}": frames[t.name].select(F.col(c.name).alias("c0"), F.col(RID).alias("c1")) for t in catalog.tables.values() for c in t.columns}


def datalog_offenders(spark: SparkSession, p: Proof, label: str, program: rules.RuleProgram, catalog: Catalog, relations: dict[str, DataFrame]) -> DataFrame:
    """__rid of each offender that a proof's rules derive. The rules are added to the program, which later proofs also see."""
    at = {"table_name": p.table, "comment": p.comment, "proof_expression": p.text}
    if p.table not in catalog.tables:
        raise e.DatalogProofTableNotFound(**at)
    count = p.text.count(HEADER)
    if not count:
        raise e.DatalogProofOutputRuleNotFound(**at, error=f"Datalog proof must contain output rule for offenders in the format like '{HEADER} :- t_some_table__some_column(ColVal, Offender), ColVal = 7.'")
    if count > 1:
        raise e.DatalogProofTooManyOutputRules(**at, error=f"Only one '{HEADER}' rule may exist in a datalog proof.")
    before = len(program.rules)
    try:
        rules.read(p.text.replace(HEADER, f"{label}(Offender)"), program)
    except (rules.RuleSyntaxError, rules.RuleError) as err:
        raise e.DatalogProofQueryParseError(**at, error=str(err)) from None
    if len(program.rules) == before:
        raise e.DatalogProofNoRulesFound(**at, error=f"No datalog queries found in proof. There must exist one {HEADER} rule in a proof.")
    own = [r for r in program.rules[before:] if r.head and r.head.predicate == label]
    if len(own) != 1 or own[0].head.terms != (rules.Variable("Offender"),):
        raise e.DatalogProofBadOutputRuleFormat(**at, error="There must be only one variable in output rule named Offender.")
    prefix = f"t_{p.table}__"
    if not any(x.atom and x.atom.predicate.startswith(prefix) and x.atom.terms[1:] == (rules.Variable("Offender"),) for x in own[0].body):
        raise e.DatalogProofTableExpectedNotFoundInTheOutputQuery(**at, error=f"Expected term like '{prefix}<column name>(_, Offender)' not found in the output query")
    try:
        return datalog.evaluate(spark, needed(program, label), relations).relations[label].select(F.col("c0").alias(RID))
    except (rules.RuleError, PySparkException) as err:
        raise e.DatalogProofQueryingFailure(**at, error=str(err)) from None


def check_datalog(spark: SparkSession, proofs: list[Proof], catalog: Catalog, frames: dict[str, DataFrame]) -> None:
    program, relations = rules.RuleProgram(), edb(catalog, frames)
    for k, p in enumerate(proofs):
        found = datalog_offenders(spark, p, f"rows_against_{k}", program, catalog, relations)
        try:
            rows = rows_of(frames[p.table], found).orderBy(RID).limit(SHOWN).collect()
        except PySparkException as err:
            raise e.DatalogProofQueryingFailure(table_name=p.table, comment=p.comment, proof_expression=p.text, error=str(err)) from None
        if rows:
            raise e.DatalogProofOffendersFound(table_name=p.table, comment=p.comment, proof_expression=p.text, offending_columns=sorted(pretty(catalog[p.table], r) for r in rows))


def needed(program: rules.RuleProgram, label: str) -> rules.RuleProgram:
    """The part of a program that a predicate depends on."""
    want, todo = set(), [label]
    while todo:
        name = todo.pop()
        if name not in want:
            want.add(name)
            todo += [x.atom.predicate for r in program.rules if r.head and r.head.predicate == name for x in r.body if x.atom]
    return rules.RuleProgram([r for r in program.rules if r.head and r.head.predicate in want], {k: v for k, v in program.facts.items() if k in want}, declared={k: v for k, v in program.declared.items() if k in want})
