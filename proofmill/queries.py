"""The operators over the test tables, each over whole tables, and the same in SQL. Whole programs are in program_queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import build
from .functions.script_columns import compile_expression, with_generated
from .operators import datalog, keys, navigation
from .operators.proofs import rows_of
from .operators.sql import register, translate
from .operators.views import view_rows
from .plans import rules
from .plans.catalog import RID, Catalog
from .plans.parser import parse
from .sources.tables import from_parquet, numbered_by

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_TYPES = {"string": "TEXT", "int": "INT", "bigint": "INT", "double": "FLOAT", "boolean": "BOOL"}


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """The columns of declarable types, whole numbers as bigint."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes if t in _TYPES])


def statement(spark: SparkSession, sf: str, text: str, names: str, rowids: bool = False) -> DataFrame:
    """Runs SQL of views and proofs over test tables."""
    frames = {n: plain(from_parquet(spark, f"{sf}/{n}.parquet") if rowids else load(spark, sf, n)) for n in names.split()}
    views = register(frames, "q_")
    tables = {n: (views[n], [(c, _TYPES[t]) for c, t in df.dtypes if c != RID]) for n, df in frames.items()}
    return translate(text, tables).run(spark)


def sql_query(name: str, tables: str, text: str, oracle: str | None = None, rowids: bool = False) -> None:
    query(name, oracle or text)(lambda spark, sf: statement(spark, sf, text, tables, rowids))


def rule_query(name: str, relations: dict[str, tuple[str, list[str]]], text: str, answer: str, columns: list[str], oracle: str) -> None:
    """relations: for each the table and the columns that it holds."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        given = {r: plain(load(spark, sf, t).select(*cols)).distinct() for r, (t, cols) in relations.items()}
        out = datalog.evaluate(spark, rules.read(text), given)
        return out.relations[answer].toDF(*columns)

    query(name, oracle)(run)


# proofs


def _proof(spark: SparkSession, sf: str, table: str, text: str, names: str, columns: list[str]) -> DataFrame:
    offenders = statement(spark, sf, text, names, rowids=True).select((F.col("rowid") - 1).alias(RID))
    return rows_of(from_parquet(spark, f"{sf}/{table}.parquet"), offenders).select(*columns)


@query("proof_sql_offenders", "SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.05")
def _(spark, sf):
    return _proof(spark, sf, "lineitem", "SELECT rowid FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.05", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("proof_sql_join_offenders", "SELECT o_orderkey,o_custkey FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0")
def _(spark, sf):
    return _proof(spark, sf, "orders", "SELECT o.rowid FROM orders o JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0", "orders customer", ["o_orderkey", "o_custkey"])


# keys and references


@query("pk_duplicates", "SELECT l_orderkey,l_linenumber,count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def _(spark, sf):
    return keys.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("unique_violations", "SELECT p_name,p_brand,count(*) AS n FROM part GROUP BY 1,2 HAVING count(*)>1")
def _(spark, sf):
    return keys.duplicate_keys(load(spark, sf, "part"), ["p_name", "p_brand"])


@query("unique_first_offender", "SELECT p_partkey,p_name FROM (SELECT *,row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) k FROM part) WHERE k>1 ORDER BY p_partkey LIMIT 1")
def _(spark, sf):
    return keys.first_later_row(load(spark, sf, "part"), ["p_name"], "p_partkey").select("p_partkey", "p_name")


@query("fk_orphans", "SELECT o_orderkey,o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey=o_custkey AND c_mktsegment<>'BUILDING')")
def _(spark, sf):
    kept = load(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    return keys.orphans(load(spark, sf, "orders"), kept, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


@query("fk_pointer", "SELECT c_custkey, n.rid AS nation_rid FROM customer JOIN (SELECT n_nationkey,row_number() OVER (ORDER BY n_nationkey)-1 AS rid FROM nation) n ON c_nationkey=n_nationkey")
def _(spark, sf):
    nation = numbered_by(load(spark, sf, "nation"), ["n_nationkey"])
    return keys.pointers(load(spark, sf, "customer"), nation, [("c_nationkey", "n_nationkey")], "nation_rid").select("c_custkey", "nation_rid")


@query("child_parent_orphans", "SELECT l_orderkey,l_linenumber,l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey AND o_orderstatus='F')")
def _(spark, sf):
    done = load(spark, sf, "orders").where("o_orderstatus = 'F'")
    return keys.orphans(load(spark, sf, "lineitem"), done, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("sibling_scoped_orphans", "SELECT c_custkey,c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=c_nationkey AND s_suppkey=c_custkey%100)")
def _(spark, sf):
    customer = load(spark, sf, "customer").withColumn("agent", F.col("c_custkey") % 100)
    return keys.orphans(customer, load(spark, sf, "supplier"), [("c_nationkey", "s_nationkey"), ("agent", "s_suppkey")]).select("c_custkey", "c_nationkey")


@query("ref_child_path_match", "SELECT c_custkey, concat(n_name,'=>',c_name) AS path FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE n_regionkey=1")
def _(spark, sf):
    customer = load(spark, sf, "customer").join(load(spark, sf, "nation").where("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey"))
    spelled, _ = keys.path_pairs([], "path", ["n_name", "c_name"], customer)
    return spelled.select("c_custkey", F.col("__path").alias("path"))


@query(
    "ref_foreign_child_path_orphans",
    "SELECT s_suppkey, concat(r_name,'=>',n_name) AS path FROM supplier JOIN nation ON n_nationkey=s_nationkey JOIN region ON r_regionkey=n_regionkey"
    " WHERE concat(r_name,'=>',n_name) NOT IN (SELECT concat(r_name,'=>',n_name) FROM nation JOIN region ON r_regionkey=n_regionkey WHERE n_nationkey%2=0)",
)
def _(spark, sf):
    nation = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    supplier = load(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.concat_ws("=>", "r_name", "n_name").alias("path"))
    targets, pairs = keys.path_pairs([], "path", ["r_name", "n_name"], nation.where("n_nationkey % 2 = 0"))
    return keys.orphans(supplier, targets, pairs)


@query("reverse_refs", "SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR),',' ORDER BY s_suppkey),'') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1")
def _(spark, sf):
    out = keys.reverse_lists(load(spark, sf, "nation"), load(spark, sf, "supplier"), "s_nationkey", "suppliers", "s_suppkey", "n_nationkey")
    return out.select("n_nationkey", F.array_join(F.col("suppliers").cast("array<string>"), ",").alias("suppliers"))


@query(
    "parent_sibling_pairs",
    "SELECT o_custkey,o_orderkey,nxt AS next_orderkey FROM (SELECT o_custkey,o_orderkey,o_orderpriority p,lead(o_orderkey) OVER w nxt,lead(o_orderpriority) OVER w np"
    " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE p='1-URGENT' AND np='5-LOW'",
)
def _(spark, sf):
    out = navigation.neighbours(load(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_orderpriority"])
    return out.where("o_orderpriority = '1-URGENT' AND next_o_orderpriority = '5-LOW'").select("o_custkey", "o_orderkey", F.col("next_o_orderkey").alias("next_orderkey"))


@query("key_charset_offenders", "SELECT p_partkey,p_name FROM part WHERE NOT regexp_full_match(p_name,'[a-zA-Z0-9_:-]+')")
def _(spark, sf):
    return keys.charset_offenders(load(spark, sf, "part"), "p_name").select("p_partkey", "p_name")


@query("composite_ref_shape_offenders", "SELECT page_id, CAST(len(string_split(url,'/')) AS INTEGER) AS segments FROM pages WHERE len(string_split(url,'/'))<>5")
def _(spark, sf):
    return keys.shape_offenders(load(spark, sf, "pages"), "url", 5, "/").select("page_id", F.col("__segments").alias("segments"))


@query("finite_float_offenders", "SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id%7=0 THEN CAST('nan' AS DOUBLE) ELSE 1.0 END AS f FROM embeddings) WHERE isnan(f) OR isinf(f)")
def _(spark, sf):
    made = load(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, float("nan")).otherwise(1.0).alias("f"))
    return keys.infinite_offenders(made, "f").select("vec_id")


# expressions


@query("row_check_offenders", "SELECT l_orderkey,l_linenumber,l_partkey FROM lineitem WHERE NOT (l_quantity > 1 AND l_quantity < 50)")
def _(spark, sf):
    items = load(spark, sf, "lineitem")
    check = compile_expression(" l_quantity > 1 and l_quantity < 50 ", [("l_quantity", "FLOAT", F.col("l_quantity"))], (), "BOOL")
    return items.where(check.wrong | ~check.result).select("l_orderkey", "l_linenumber", "l_partkey")


@query("generated_columns", "SELECT p_partkey,CAST(p_size+2 AS BIGINT) AS computed_int,CAST((p_size+2)*3.0 AS DOUBLE) AS computed_float,concat(p_name,'!') AS computed_text,p_size%2=0 AS is_even FROM part")
def _(spark, sf):
    made = [("computed_int", "INT", "p_size + 2"), ("computed_float", "FLOAT", "computed_int * 3.0"), ("computed_text", "TEXT", 'p_name .. "!"'), ("is_even", "BOOL", "p_size % 2 == 0")]
    out, _ = with_generated(load(spark, sf, "part"), made, [("p_size", "INT"), ("p_name", "TEXT")], ())
    return out.select("p_partkey", *[m[0] for m in made])


@query("generated_chain", "SELECT p_partkey, CAST(b*7 AS BIGINT) AS c FROM (SELECT p_partkey,p_size+1 AS b FROM part)")
def _(spark, sf):
    out, _ = with_generated(load(spark, sf, "part"), [("b", "INT", "p_size + 1"), ("c", "INT", "local x = b\nx * 7")], [("p_size", "INT")], ())
    return out.select("p_partkey", "c")


@query("script_udf", "SELECT p_partkey, floor(p_retailprice*10+0.5)/10 AS rounded, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part")
def _(spark, sf):
    scripts = (("function round(x, n) local m = 10^(n or 0) return math.floor(x * m + 0.5) / m end function kind(s) if s > 25 then return 'large' else return 'small' end end", None),)
    out, _ = with_generated(load(spark, sf, "part"), [("rounded", "FLOAT", "round(p_retailprice, 1)"), ("kind", "TEXT", "kind(p_size)")], [("p_retailprice", "FLOAT"), ("p_size", "INT")], scripts)
    return out.select("p_partkey", "rounded", "kind")


@query("script_interpreted", "SELECT p_partkey, array_to_string(list_reverse(string_split(p_brand,'')),'') AS backwards, CAST(length(p_name)-length(replace(p_name,'e','')) AS BIGINT) AS es FROM part")
def _(spark, sf):
    made = [("backwards", "TEXT", "string.reverse(p_brand)"), ("es", "INT", "local n = 0\nfor i = 1, #p_name do if string.sub(p_name, i, i) == 'e' then n = n + 1 end end\nreturn n")]
    out, _ = with_generated(load(spark, sf, "part"), made, [("p_brand", "TEXT"), ("p_name", "TEXT")], ())
    return out.select("p_partkey", "backwards", "es")


@query("replacement_overlay", "SELECT c_custkey, CASE WHEN c_custkey<10 THEN 'REPLACED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, sf):
    changes = spark.range(10).select(F.col("id").alias("c_custkey"), F.lit("REPLACED").alias("c_mktsegment"))
    return keys.overlaid(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), changes, ["c_custkey"], ["c_mktsegment"])


@query("replacement_unused", "SELECT CAST(k AS BIGINT) AS k FROM (SELECT unnest([1,5,999999]) AS k) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    changes = spark.createDataFrame([(1,), (5,), (999999,)], "k bigint")
    return keys.unused(changes, load(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("program_checked", "SELECT c_custkey, c_mktsegment, CAST(n_regionkey AS BIGINT) AS region FROM customer JOIN nation ON n_nationkey=c_nationkey")
def _(spark, sf):
    """A whole program over bound tables: hierarchy, references, checks, a view, proofs."""
    program = parse("""
TABLE region { r_regionkey INT PRIMARY KEY, r_name TEXT, UNIQUE(r_name) }
TABLE nation { n_nationkey INT PRIMARY KEY CHILD OF region, n_name TEXT }
TABLE customer { c_custkey INT PRIMARY KEY, c_nationkey INT, c_mktsegment TEXT, CHECK { c_custkey >= 0 and #c_mktsegment > 0 } }
MATERIALIZED VIEW home { c_custkey INT PRIMARY KEY, c_mktsegment TEXT, region REF region } AS {
  SELECT c_custkey, c_mktsegment, r_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
}
PROOF "every customer has a home" NONE EXIST OF customer { SELECT rowid FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM home) }
PROOF "nations stand in regions" NONE EXIST OF nation DATALOG { OUTPUT(Offender) :- t_nation__r_regionkey(R, Offender), NOT t_region__r_regionkey(R, _). }
""")
    nation = load(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    inputs = {"region": load(spark, sf, "region"), "nation": nation, "customer": load(spark, sf, "customer")}
    return build(spark, program, inputs=inputs).table("home").drop(RID)


# views


@query("matview_basic", "SELECT o_orderkey AS pkey,o_custkey AS ref_key FROM orders")
def _(spark, sf):
    return statement(spark, sf, "SELECT o_orderkey AS pkey, o_custkey AS ref_key FROM orders", "orders")


@query("matview_string_sorted", "SELECT CAST(p_size AS BIGINT) AS p_size, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR))-1 AS rid FROM (SELECT DISTINCT p_size FROM part)")
def _(spark, sf):
    catalog = Catalog(parse("MATERIALIZED VIEW sizes { p_size INT } AS { SELECT DISTINCT p_size FROM part }"))
    frames = {"part": plain(load(spark, sf, "part"))}
    tables = {n: (v, [(c, _TYPES[t]) for c, t in frames[n].dtypes]) for n, v in register(frames, "q_").items()}
    return view_rows(spark, catalog["sizes"], tables).select("p_size", F.col(RID).alias("rid"))


@query("matview_on_matview", "SELECT seg,n*2 AS n2 FROM (SELECT c_mktsegment AS seg,count(*) AS n FROM customer GROUP BY 1)")
def _(spark, sf):
    first = statement(spark, sf, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1", "customer")
    view = register({"counts": first}, "q_")["counts"]
    return translate("SELECT seg, n * 2 AS n2 FROM counts", {"counts": (view, [("seg", "TEXT"), ("n", "INT")])}).run(spark)


# SQL

sql_query("sql_int_division", "part", "SELECT p_partkey, p_size / 7 AS q FROM part", "SELECT p_partkey,CAST(p_size//7 AS BIGINT) AS q FROM part")
sql_query("sql_div_zero_null", "part", "SELECT p_partkey, p_size / (p_size % 3) AS q FROM part", "SELECT p_partkey, CAST(p_size//nullif(p_size%3,0) AS BIGINT) AS q FROM part")
sql_query("sql_like_ci", "part", "SELECT p_partkey FROM part WHERE p_type LIKE '%economy%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%economy%'")
sql_query("sql_glob", "part", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[12]*'")
sql_query("sql_is_not", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT 'P'", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
sql_query("sql_left_join", "nation supplier", "SELECT n_name,s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey")
sql_query(
    "sql_full_join", "region nation", "SELECT r_regionkey,n_nationkey FROM (SELECT * FROM region WHERE r_regionkey<3) FULL JOIN (SELECT * FROM nation WHERE n_regionkey>1) ON r_regionkey=n_regionkey",
    "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey,CAST(n_nationkey AS BIGINT) AS n_nationkey FROM (SELECT * FROM region WHERE r_regionkey<3) FULL JOIN (SELECT * FROM nation WHERE n_regionkey>1) ON r_regionkey=n_regionkey",
)
sql_query("sql_theta_join", "nation", "SELECT a.n_nationkey AS a,b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey<b.n_nationkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS a,CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_nationkey<b.n_nationkey")
sql_query("sql_semi", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)")
sql_query("sql_group_having", "orders", "SELECT o_custkey,count(*) AS n,max(o_totalprice) AS mx FROM orders GROUP BY 1 HAVING count(*)>12")
sql_query("sql_distinct_count", "lineitem", "SELECT l_returnflag,count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
sql_query("sql_filter_agg", "events", "SELECT event_type,count(*) FILTER (WHERE value>5) AS n FROM events GROUP BY 1")
sql_query(
    "sql_total_group_concat", "nation", "SELECT n_regionkey,total(n_nationkey) AS total,group_concat(n_name) AS names FROM nation GROUP BY 1",
    "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey,CAST(sum(n_nationkey) AS DOUBLE) AS total,string_agg(n_name,',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1", rowids=True,
)
sql_query("sql_topk", "orders", "SELECT o_orderkey,o_totalprice FROM orders ORDER BY o_totalprice DESC,o_orderkey LIMIT 10")
sql_query("sql_rank", "customer", "SELECT c_custkey,rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer")
sql_query("sql_lag", "events", "SELECT event_id,lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events")
sql_query("sql_rows_frame", "events", "SELECT event_id,count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
sql_query(
    "sql_groups_frame", "part", "SELECT p_partkey,sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM part",
    "SELECT p_partkey,CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part",
)
_EXCLUDE = "SELECT n_nationkey,{0} OVER (PARTITION BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW){1} AS s FROM nation"
sql_query("sql_exclude_current", "nation", _EXCLUDE.format("sum(n_nationkey)", ""), _EXCLUDE.format("CAST(sum(n_nationkey)", " AS BIGINT)").replace("SELECT n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey"))
sql_query("sql_intersect", "supplier customer", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal<0", "SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal<0")
sql_query("sql_except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT'")
sql_query("sql_recursive_cte", "nation", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM r WHERE n<50) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n+1 FROM r WHERE n<50) SELECT n FROM r")
sql_query(
    "sql_recursive_union", "nation", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT r.a, (r.b + 1) % 5 FROM r) SELECT a, b FROM r",
    "SELECT CAST(n_nationkey AS BIGINT) AS a, b FROM nation, range(5) AS t(b)",
)
sql_query("sql_json_extract", "events", "SELECT event_id,CAST(json_extract(props,'$.k') AS INTEGER) AS k FROM events", "SELECT event_id,CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
sql_query("sql_string_funcs", "part", "SELECT p_partkey,upper(p_name) AS u,length(p_name) AS n,substr(p_brand,7) AS b,replace(p_type,'ECONOMY','E') AS t FROM part")
sql_query("sql_case_truth", "part", "SELECT p_partkey, CASE WHEN p_size % 2 THEN 'odd' ELSE 'even' END AS kind FROM part WHERE p_size - 1", "SELECT p_partkey, CASE WHEN p_size % 2 <> 0 THEN 'odd' ELSE 'even' END AS kind FROM part WHERE p_size <> 1")
sql_query("sql_bare_column", "customer", "SELECT c_nationkey, c_custkey, max(c_custkey) AS top FROM customer GROUP BY c_nationkey", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, max(c_custkey) AS c_custkey, max(c_custkey) AS top FROM customer GROUP BY 1")
sql_query("sql_natural_join", "nation", "SELECT n_nationkey, n_name FROM nation NATURAL JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
sql_query("sql_affinity", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey = '7'", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
sql_query("sql_named_window", "orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql_query("sql_values", "nation", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y'))", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")

sql_query("sql_union_all", "nation region", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql_query("sql_union", "supplier customer", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer", "SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier UNION SELECT c_nationkey FROM customer")
sql_query("sql_compound_order", "supplier customer", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer ORDER BY k DESC LIMIT 5", "SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier UNION SELECT c_nationkey FROM customer ORDER BY k DESC LIMIT 5")
sql_query("sql_cte", "orders customer", "WITH counts AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), top(k) AS (SELECT k FROM counts WHERE n > 12) SELECT c_custkey, c_name FROM customer JOIN top ON k = c_custkey")
sql_query("sql_weak_numbers", "part", "SELECT p_partkey, CAST(p_size || 'abc' AS INTEGER) AS whole, CAST(p_size || '.5kg' AS REAL) AS part FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS whole, CAST(p_size + 0.5 AS DOUBLE) AS part FROM part")
sql_query("sql_quoted_names", "part", 'SELECT "p_partkey" AS "the key" FROM "part" WHERE "p_size" = 7')
sql_query(
    "sql_bits", "part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_size << 2 AS l, p_partkey >> 1 AS r, ~p_size AS c, p_size % 7 AS m FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size NOT IN (7, 9)",
    "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, CAST(p_size AS BIGINT) << 2 AS l, p_partkey >> 1 AS r, ~CAST(p_size AS BIGINT) AS c, CAST(p_size % 7 AS BIGINT) AS m FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size NOT IN (7, 9)",
)
sql_query("sql_real_literals", "part", "SELECT p_partkey, 3.0 / 2 AS x, p_size * 1.5 AS y, 7 / 2 AS z FROM part", "SELECT p_partkey, CAST(1.5 AS DOUBLE) AS x, CAST(p_size * 1.5 AS DOUBLE) AS y, CAST(3 AS BIGINT) AS z FROM part")
sql_query(
    "sql_math_funcs", "part", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice) AS r, max(p_size, 10) AS hi, min(p_size, 10) AS lo FROM part",
    "SELECT p_partkey, CAST(abs(p_size - 25) AS BIGINT) AS a, round(p_retailprice) AS r, CAST(greatest(p_size, 10) AS BIGINT) AS hi, CAST(least(p_size, 10) AS BIGINT) AS lo FROM part",
)
sql_query("sql_typeof", "part", "SELECT p_partkey, typeof(p_size) AS a, typeof(p_name) AS b, typeof(p_retailprice) AS c, typeof(p_size / 2.0) AS d FROM part", "SELECT p_partkey, 'integer' AS a, 'text' AS b, 'real' AS c, 'real' AS d FROM part")
sql_query("sql_json_each", "events", "SELECT event_id, j.key AS name, CAST(j.value AS INTEGER) AS v FROM events, json_each(props) AS j", "SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events")
sql_query("sql_dates", "region", "SELECT r_regionkey, date('2020-02-28', '+2 days') AS d, strftime('%Y-%m', '2021-07-04') AS m FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, '2020-03-01' AS d, '2021-07' AS m FROM region")
sql_query("sql_row_values", "orders customer", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT c_custkey, '1-URGENT' FROM customer WHERE c_acctbal < 0)", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal < 0")
sql_query("sql_right_join", "supplier nation", "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql_query("sql_join_using", "nation", "SELECT n_nationkey, x FROM nation JOIN (SELECT n_nationkey, n_regionkey + 100 AS x FROM nation) USING (n_nationkey)", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey + 100 AS BIGINT) AS x FROM nation")
sql_query("sql_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 3")

# Datalog

rule_query("dl_projection", {"orders": ("orders", ["o_orderkey", "o_custkey"])}, "answer(X) :- orders(_, X).", "answer", ["x"], "SELECT DISTINCT o_custkey AS x FROM orders")
rule_query("dl_const_selection", {"orders": ("orders", ["o_orderkey", "o_orderstatus"])}, 'answer(X) :- orders(X, "P").', "answer", ["x"], "SELECT o_orderkey AS x FROM orders WHERE o_orderstatus='P'")
rule_query("dl_repeated_var", {"customer": ("customer", ["c_custkey", "c_nationkey"])}, "answer(X) :- customer(X, X).", "answer", ["x"], "SELECT DISTINCT c_custkey AS x FROM customer WHERE c_custkey=c_nationkey")
rule_query("dl_comparison", {"part": ("part", ["p_partkey", "p_size"])}, "answer(X) :- part(X, S), S > 45.", "answer", ["x"], "SELECT DISTINCT p_partkey AS x FROM part WHERE p_size>45")
rule_query("dl_regex", {"part": ("part", ["p_partkey", "p_name"])}, 'answer(X) :- part(X, N), N *= "ring$".', "answer", ["x"], "SELECT DISTINCT p_partkey AS x FROM part WHERE regexp_matches(p_name,'ring$')")
rule_query(
    "dl_natural_join", {"supplier": ("supplier", ["s_suppkey", "s_nationkey"]), "nation": ("nation", ["n_nationkey", "n_regionkey"])}, "answer(S, R) :- supplier(S, N), nation(N, R).", "answer", ["s", "r"],
    "SELECT DISTINCT s_suppkey AS s,CAST(n_regionkey AS BIGINT) AS r FROM supplier JOIN nation ON s_nationkey=n_nationkey",
)
_PLACES = {"region": ("region", ["r_regionkey"]), "nation": ("nation", ["n_nationkey"])}
rule_query("dl_theta_join", _PLACES, "answer(R, N) :- region(R), nation(N), N < R.", "answer", ["r", "n"], "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS r,CAST(n_nationkey AS BIGINT) AS n FROM region,nation WHERE n_nationkey<r_regionkey")
rule_query("dl_cartesian", _PLACES, "answer(R, N) :- region(R), nation(N).", "answer", ["r", "n"], "SELECT CAST(r_regionkey AS BIGINT) AS r,CAST(n_nationkey AS BIGINT) AS n FROM region,nation")
_PEOPLE = {"customer": ("customer", ["c_custkey", "c_nationkey", "c_acctbal"]), "supplier": ("supplier", ["s_suppkey", "s_nationkey"])}
rule_query(
    "dl_union", _PEOPLE, "answer(N) :- customer(_, N, B), B < 0. answer(N) :- supplier(_, N).", "answer", ["n"], "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_acctbal<0 UNION SELECT s_nationkey FROM supplier"
)
rule_query(
    "dl_negation", {"customer": ("customer", ["c_custkey"]), "orders": ("orders", ["o_custkey", "o_orderstatus"])}, 'answer(X) :- customer(X), NOT orders(X, "F").', "answer", ["x"],
    "SELECT DISTINCT c_custkey AS x FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')",
)
rule_query("dl_intersection", _PEOPLE, "answer(N) :- customer(_, N, _), supplier(_, N).", "answer", ["n"], "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")


def _edges(name: str, oracle: str, columns: list[str], text: str, answer: str, **relations: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in ("part", "nation"):
            load(spark, sf, t).createOrReplaceTempView(f"edge_{t}")
        given = {r: spark.sql(s) for r, s in relations.items()}
        return datalog.evaluate(spark, rules.read(text), given).relations[answer].toDF(*columns)

    query(name, oracle)(run)


_edges(
    "dl_transitive_closure",
    "WITH RECURSIVE tc(x,y) AS (SELECT p_partkey,p_partkey//2 FROM part WHERE p_partkey>0 UNION SELECT tc.x,p_partkey//2 FROM tc JOIN part ON tc.y=p_partkey WHERE p_partkey>0) SELECT x,y FROM tc",
    ["x", "y"], "tc(X, Y) :- edge(X, Y). tc(X, Z) :- tc(X, Y), edge(Y, Z).", "tc", edge="SELECT p_partkey, p_partkey div 2 FROM edge_part WHERE p_partkey > 0",
)
_edges(
    "dl_recursion_cyclic",
    "WITH RECURSIVE tc(x,y) AS (SELECT CAST(n_nationkey AS BIGINT),CAST((n_nationkey+5)%25 AS BIGINT) FROM nation UNION SELECT tc.x,CAST((n_nationkey+5)%25 AS BIGINT) FROM tc JOIN nation ON tc.y=n_nationkey) SELECT x,y FROM tc",
    ["x", "y"], "tc(X, Y) :- edge(X, Y). tc(X, Z) :- tc(X, Y), tc(Y, Z).", "tc", edge="SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 5) % 25 AS BIGINT) FROM edge_nation",
)
_edges(
    "dl_mutual_recursion",
    "WITH RECURSIVE p(x,y,o) AS (SELECT CAST(n_nationkey AS BIGINT),CAST(n_nationkey+1 AS BIGINT),1 FROM nation WHERE n_nationkey<24 UNION SELECT CAST(n_nationkey AS BIGINT),p.y,1-p.o FROM nation JOIN p ON p.x=n_nationkey+1) SELECT x,y FROM p WHERE o=1",
    ["x", "y"], "odd(X, Y) :- edge(X, Y). odd(X, Z) :- edge(X, Y), even(Y, Z). even(X, Z) :- edge(X, Y), odd(Y, Z).", "odd", edge="SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 1 AS BIGINT) FROM edge_nation WHERE n_nationkey < 24",
)
rule_query(
    "dl_constraint_violations", {"customer": ("customer", ["c_custkey", "c_acctbal"]), "orders": ("orders", ["o_custkey", "o_orderpriority"])}, 'violation(X) :- customer(X, B), orders(X, "1-URGENT"), B < 0.', "violation", ["x"],
    "SELECT DISTINCT c_custkey AS x FROM customer JOIN orders ON o_custkey=c_custkey WHERE c_acctbal<0 AND o_orderpriority='1-URGENT'",
)


@query("dl_proof_offenders", "SELECT p_partkey,p_name FROM part WHERE p_size=7")
def _(spark, sf):
    part = plain(from_parquet(spark, f"{sf}/part.parquet"))
    facts = {"t_part__p_size": part.select("p_size", RID)}
    found = datalog.evaluate(spark, rules.read("proof(Offender) :- t_part__p_size(7, Offender)."), facts).relations["proof"]
    return rows_of(part, found.toDF(RID)).select("p_partkey", "p_name")
