"""Row numbers of frames that come from shuffles, and the entry without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofmill.database import build, compile_text
from proofmill.operators.sql import register
from proofmill.operators.views import view_rows
from proofmill.plans import errors as e
from proofmill.plans.catalog import RID, Catalog
from proofmill.plans.parser import parse
from proofmill.sources.tables import numbered, numbered_by

ROOT = Path(__file__).resolve().parent.parent


def dense(df):
    n, apart, low, high = df.agg(F.count("*"), F.countDistinct(RID), F.min(RID), F.max(RID)).first()
    return n == apart and low == 0 and high == n - 1, n


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_aggregated_rows_keep_their_numbers(spark, many_parts):
    grouped = spark.range(600_000).groupBy((F.col("id") % 200_000).alias("k")).agg(F.sum("id").alias("s"), F.max(F.concat(F.lit("x" * 40), "id")).alias("pay"))
    assert dense(numbered(grouped)) == (True, 200_000)
    db = build(spark, parse("TABLE t { k INT PRIMARY KEY, s INT }"), inputs={"t": grouped}, check=False)
    assert dense(db.table("t")) == (True, 200_000)
    assert db.table("t").select(F.countDistinct("k")).first()[0] == 200_000


def test_ranks_of_a_million_rows_with_payload(spark, tmp_path, many_parts):
    made = spark.range(1_000_000).select(F.xxhash64("id").cast("string").alias("k"), F.concat(F.lit("y" * 30), "id").alias("pay"))
    made.write.parquet(f"{tmp_path}/made")
    read = spark.read.parquet(f"{tmp_path}/made")
    ranked = numbered_by(read, ["k"])
    assert dense(ranked) == (True, 1_000_000)
    sample = [r[0] for r in ranked.where("__rid % 1000 = 7").orderBy(RID).select("k").collect()]
    assert sample == sorted(sample)
    catalog = Catalog(parse("MATERIALIZED VIEW v { a INT, b INT } AS { SELECT a, b FROM src }"))
    frame = spark.range(1_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(2)).alias("b"))
    views = register({"src": frame}, "rows_")
    assert dense(view_rows(spark, catalog["v"], {"src": (views["src"], [("a", "INT"), ("b", "INT")])})) == (True, 1_000_000)


def test_equal_rows_are_spread(spark):
    same = spark.range(50_000).select(F.lit("same").alias("k"))
    ranked = numbered_by(same, ["k"])
    assert dense(ranked) == (True, 50_000)


def test_offenders_as_a_frame(spark):
    text = """
TABLE t { id INT PRIMARY KEY }
PROOF "few" NONE EXIST OF t { SELECT rowid FROM t WHERE id > 3 }
PROOF "none at all" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id(X, Offender), X > 7. }
"""
    db = compile_text(spark, text, inputs={"t": spark.range(10)}, check=False)
    assert sorted(r["id"] for r in db.proof_offenders("few").collect()) == [4, 5, 6, 7, 8, 9]
    assert sorted(r["id"] for r in db.proof_offenders("none at all").collect()) == [8, 9]
    with pytest.raises(e.SqlProofOffendersFound) as found:
        db.prove()
    assert "9.0" in str(found.value)


def test_entry_without_corpus_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", ".hypothesis"))
    say = "import __spark_entry__ as s; q = s.queries(); o = s.oracle_sql(); assert set(o) <= set(q) and len(q) > 70 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", say], cwd=to, check=True)
        (to / "corpus_pipeline.py").unlink(missing_ok=True)
