"""Programs that compile, and programs that do not: what they give, and which error they raise."""

import pytest

from proofmill import cli
from proofmill.database import compile_files, compile_text
from proofmill.plans import errors as e
from proofmill.plans.parser import parse

GOOD = {
    "flat reference and default": (
        """
TABLE zone { code TEXT PRIMARY KEY, title TEXT }
TABLE host { name TEXT PRIMARY KEY, zone REF zone, drives INT DEFAULT 1 }
DATA zone { eu, Europe North; us, "United States"; }  // a comment
DATA host(name, zone) { alpha, eu; beta, us }
""",
        {"zone": [{"code": "eu", "title": "Europe North"}, {"code": "us", "title": "United States"}], "host": [{"name": "alpha", "zone": "eu", "drives": 1.0}, {"name": "beta", "zone": "us", "drives": 1.0}]},
    ),
    "nested rows of a child table": (
        """
TABLE host { name TEXT PRIMARY KEY }
TABLE drive { slot TEXT PRIMARY KEY CHILD OF host, size INT }
TABLE part { number INT PRIMARY KEY CHILD OF drive }
DATA host { alpha WITH drive { "/dev/a", 10 WITH part { 1; 2 }; "/dev/b", 20 }; beta }
""",
        {
            "host": [{"name": "alpha"}, {"name": "beta"}], "drive": [{"name": "alpha", "slot": "/dev/a", "size": 10.0}, {"name": "alpha", "slot": "/dev/b", "size": 20.0}],
            "part": [{"name": "alpha", "slot": "/dev/a", "number": 1.0}, {"name": "alpha", "slot": "/dev/a", "number": 2.0}],
        },
    ),
    "nested objects fill a reference": (
        """
TABLE team { id INT PRIMARY KEY }
TABLE member { who TEXT PRIMARY KEY, team REF team }
DATA STRUCT team [ { id: 7, WITH member [ { who: ann }, { who: bob, } ] }, { id: 8 } ]
""",
        {"team": [{"id": 7.0}, {"id": 8.0}], "member": [{"who": "ann", "team": 7.0}, {"who": "bob", "team": 7.0}]},
    ),
    "all types, data before the table": (
        "DATA STRUCT t { s: some text, i: -7, f: 7.5, b: false } TABLE t { s TEXT, i INT, f FLOAT, b BOOL }",
        {"t": [{"s": "some text", "i": -7.0, "f": 7.5, "b": False}]},
    ),
    "detached defaults": (
        "TABLE t { id INT PRIMARY KEY, s TEXT DETACHED DEFAULT, f FLOAT DETACHED DEFAULT } DEFAULTS { t.s hello there, t.f 2.5 } DATA t(id) { 1 }",
        {"t": [{"id": 1.0, "s": "hello there", "f": 2.5}]},
    ),
    "reference to a sibling": (
        """
TABLE host { name TEXT PRIMARY KEY }
TABLE port { number INT PRIMARY KEY CHILD OF host }
TABLE box { label TEXT PRIMARY KEY CHILD OF host }
TABLE opening { title TEXT PRIMARY KEY CHILD OF box, port REF port }
DATA host { a WITH port { 80 } WITH box { web WITH opening { http, 80 } } }
""",
        {"host": [{"name": "a"}], "port": [{"name": "a", "number": 80.0}], "box": [{"name": "a", "label": "web"}], "opening": [{"name": "a", "label": "web", "title": "http", "port": 80.0}]},
    ),
    "paths across and down hierarchies": (
        """
TABLE top { k TEXT PRIMARY KEY, favourite REF CHILD leaf }
TABLE mid { m TEXT PRIMARY KEY CHILD OF top }
TABLE leaf { l TEXT PRIMARY KEY CHILD OF mid }
TABLE note { text TEXT, about REF FOREIGN CHILD leaf }
TABLE remark { r TEXT PRIMARY KEY CHILD OF top, about REF FOREIGN CHILD leaf, whole REF EXPLICIT FOREIGN CHILD leaf }
DATA top { t1, m1=>l1 WITH mid { m1 WITH leaf { l1; l2 } } WITH remark { r1, m1=>l2, t1=>m1=>l1 } }
DATA note { hi, t1=>m1=>l2 }
""",
        {
            "top": [{"k": "t1", "favourite": "m1=>l1"}], "mid": [{"k": "t1", "m": "m1"}], "leaf": [{"k": "t1", "m": "m1", "l": "l1"}, {"k": "t1", "m": "m1", "l": "l2"}],
            "note": [{"text": "hi", "about": "t1=>m1=>l2"}], "remark": [{"k": "t1", "r": "r1", "about": "m1=>l2", "whole": "t1=>m1=>l1"}],
        },
    ),
    "generated columns and checks": (
        """
INCLUDE LUA {
    function rounded(x, places)
        local scale = 10^(places or 0)
        return math.floor(x * scale + 0.5) / scale
    end
}
TABLE t {
    id INT, name TEXT, up INT GENERATED AS { id + 2 }, real FLOAT GENERATED AS { rounded(up * 2.4, 1) }, said TEXT GENERATED AS { name .. " " .. real },
    whole FLOAT GENERATED AS { up * 3 }, even BOOL GENERATED AS { id % 2 == 0 }, back TEXT GENERATED AS { string.reverse(name) },
    CHECK { id > 0 and id < 10 }
    CHECK {
        local ok = string.find(name, "b") ~= nil
        ok or id < 2
    },
    CHECK { do return true end return false }
}
DATA t { 1, ada; 2, bob }
""",
        {
            "t": [
                {"id": 1.0, "name": "ada", "up": 3.0, "real": 7.2, "said": "ada 7.2", "whole": 9.0, "even": False, "back": "ada"},
                {"id": 2.0, "name": "bob", "up": 4.0, "real": 9.6, "said": "bob 9.6", "whole": 12.0, "even": True, "back": "bob"},
            ]
        },
    ),
    "scripted rows": (
        "TABLE t { id INT, s TEXT DEFAULT x } INCLUDE LUA { for i = 1, 3 do data('t', { id = i * 10 }) end data('t', { id = 5, s = 'five' }) }",
        {"t": [{"id": 10.0, "s": "x"}, {"id": 20.0, "s": "x"}, {"id": 30.0, "s": "x"}, {"id": 5.0, "s": "five"}]},
    ),
    "views in chains, typed and sorted by text": (
        """
TABLE s { i INT, b BOOL, f FLOAT, t TEXT }
DATA s { 10, true, 1.5, x; 9, false, 2.0, y; 2, true, 3.25, z }
MATERIALIZED VIEW v { i INT, b BOOL, f FLOAT, t TEXT } AS { SELECT * FROM s }
MATERIALIZED VIEW w { n INT PRIMARY KEY, said TEXT } AS { SELECT i * b, f FROM v WHERE b }
MATERIALIZED VIEW k { f1 FLOAT, f2 BOOL, f3 TEXT, f4 TEXT } AS { SELECT 7, false, true, 7.7 }
""",
        {
            "s": [{"i": 10.0, "b": True, "f": 1.5, "t": "x"}, {"i": 9.0, "b": False, "f": 2.0, "t": "y"}, {"i": 2.0, "b": True, "f": 3.25, "t": "z"}],
            "v": [{"i": 10.0, "b": True, "f": 1.5, "t": "x"}, {"i": 2.0, "b": True, "f": 3.25, "t": "z"}, {"i": 9.0, "b": False, "f": 2.0, "t": "y"}],
            "w": [{"n": 10.0, "said": "1.5"}, {"n": 2.0, "said": "3.25"}], "k": [{"f1": 7.0, "f2": False, "f3": "1", "f4": "7.7"}],
        },
    ),
    "proofs that hold": (
        """
TABLE t { id INT }
DATA t { 1; 2; 3 }
PROOF "none above three" NONE EXIST OF t { SELECT rowid FROM t WHERE id > 3 }
PROOF "no seven" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id(7, Offender). }
""",
        {"t": [{"id": 1.0}, {"id": 2.0}, {"id": 3.0}]},
    ),
}


@pytest.mark.parametrize("name", list(GOOD))
def test_compiles(spark, name):
    text, expected = GOOD[name]
    assert compile_text(spark, text).to_json() == expected


ID = "TABLE t { id INT }\nDATA t { 1; 2; 3 }\n"
KEYED = "TABLE t { id INT PRIMARY KEY }\n"
BAD = {
    "table twice": ("TABLE t { a INT } TABLE t { a INT }", e.TableDefinedTwice(table_name="t")),
    "upper-case table": ("TABLE Tt { a INT }", e.TableNameIsNotLowercase(table_name="Tt")),
    "upper-case column": ("TABLE t { aA INT }", e.ColumnNameIsNotLowercase(table_name="t", column_name="aA")),
    "column twice": ("TABLE t { a INT, a INT }", e.DuplicateColumnNames(table_name="t", column_name="a")),
    "two keys": ("TABLE t { a INT PRIMARY KEY, b INT PRIMARY KEY }", e.MoreThanOnePrimaryKey(table_name="t")),
    "key not first": ("TABLE t { a INT, b INT PRIMARY KEY }", e.PrimaryKeyColumnMustBeFirst(table_name="t", column_name="b")),
    "float key": ("TABLE t { a FLOAT PRIMARY KEY }", e.FloatColumnCannotBePrimaryKey(table_name="t", column_name="a")),
    "boolean key": ("TABLE t { a BOOL PRIMARY KEY }", e.BooleanColumnCannotBePrimaryKey(table_name="t", column_name="a")),
    "unknown type": ("TABLE t { a BLOB }", e.UnknownColumnType(table_name="t", column_name="a", column_type="BLOB")),
    "unknown unique column": ("TABLE t { a INT, UNIQUE(b) }", e.UniqConstraintColumnDoesntExist(table_name="t", column_name="b")),
    "float in unique": ("TABLE t { a FLOAT, UNIQUE(a) }", e.FloatColumnCannotBeInUniqueConstraint(table_name="t", column_name="a")),
    "unique twice": ("TABLE t { a INT, b INT, UNIQUE(a, b), UNIQUE(b, a) }", e.DuplicateUniqConstraints(table_name="t")),
    "column twice in unique": ("TABLE t { a INT, UNIQUE(a, a) }", e.UniqConstraintDuplicateColumn(table_name="t", column_name="a")),
    "reference to nothing": ("TABLE t { a REF u }", e.ForeignKeyTableDoesntExist(referrer_table="t", referrer_column="a", referred_table="u")),
    "reference to no key": ("TABLE u { a INT } TABLE t { a REF u }", e.ForeignKeyTableDoesntHavePrimaryKey(referrer_table="t", referrer_column="a", referred_table="u")),
    "no shared ancestor": (
        "TABLE u { k INT PRIMARY KEY } TABLE v { l INT PRIMARY KEY CHILD OF u } TABLE t { a REF v }",
        e.ForeignKeyTableDoesNotShareCommonAncestorWithRefereeTable(referrer_table="t", referrer_column="a", referred_table="v"),
    ),
    "path to a root": ("TABLE u { k INT PRIMARY KEY } TABLE t { a REF FOREIGN CHILD u }", e.ForeignChildKeyTableDoesntHaveParentTable(referrer_table="t", referrer_column="a", referred_table="u")),
    "not a descendant": ("TABLE u { k INT PRIMARY KEY } TABLE t { a TEXT PRIMARY KEY, b REF CHILD u }", e.ReferredChildKeyTableIsNotDescendantToThisTable(referrer_table="t", referrer_column="b", expected_to_be_descendant_table="u")),
    "child of nothing": ("TABLE t { a INT PRIMARY KEY CHILD OF u }", e.NonExistingChildPrimaryKeyTable(table_name="t", column_name="a", referred_table="u")),
    "loop of parents": ("TABLE t { a INT PRIMARY KEY CHILD OF u } TABLE u { b INT PRIMARY KEY CHILD OF t }", e.ChildPrimaryKeysLoopDetected(table_names=["t", "u", "t"])),
    "names clash": (
        "TABLE u { a INT PRIMARY KEY } TABLE t { a INT PRIMARY KEY CHILD OF u }",
        e.ParentPrimaryKeyColumnNameClashesWithChildColumnName(parent_table="u", parent_column="a", child_table="t", child_column="a"),
    ),
    "bad default": ("TABLE t { a INT DEFAULT x }", e.CannotParseDefaultColumnValue(table_name="t", column_type="INT", column_name="a", the_value="x")),
    "default and generated": ("TABLE t { a INT DEFAULT 1 GENERATED AS { 2 } }", e.DefaultValueAndComputedValueAreMutuallyExclusive(table_name="t", column_name="a")),
    "generated reference": (KEYED + "TABLE u { a REF t GENERATED AS { 2 } }", e.PrimaryOrForeignKeysCannotHaveComputedValue(table_name="u", column_name="a")),
    "default in a view": ("MATERIALIZED VIEW v { a INT DEFAULT 1 } AS { SELECT 1 }", e.MaterializedViewsCannotHaveDefaultColumnExpression(table_name="v", column_name="a")),
    "data for nothing": ("TABLE t { a INT } DATA u { 1 }", e.TargetTableForDataNotFound(table_name="u")),
    "data for a view": ("MATERIALIZED VIEW v { a INT } AS { SELECT 1 } DATA v { 1 }", e.DataInsertionsToMaterializedViewsNotAllowed(table_name="v")),
    "unknown target column": ("TABLE t { a INT } DATA t(b) { 1 }", e.DataTargetColumnNotFound(table_name="t", target_column_name="b")),
    "too many cells": ("TABLE t { a INT } DATA t { 1; 1, 2 }", e.DataTooManyColumns(table_name="t", row_index=2, row_size=2, expected_size=1)),
    "too few cells": ("TABLE t { a INT, b INT } DATA t { 1, 2; 3 }", e.DataTooFewColumns(table_name="t", row_index=2, row_size=1, expected_size=2)),
    "bad cell": ("TABLE t { a TEXT, b INT } DATA t { x, 2; y, z }", e.DataCannotParseDataColumnValue(table_name="t", row_index=2, column_index=2, column_name="b", column_value="z", expected_type="INT")),
    "bad field": ("TABLE t { b INT } DATA STRUCT t { b: z }", e.DataCannotParseDataStructColumnValue(table_name="t", column_name="b", column_value="z", expected_type="INT")),
    "missing column": ("TABLE t { a INT, b INT } DATA t(a) { 1 }", e.DataRequiredNonDefaultColumnValueNotProvided(table_name="t", column_name="b")),
    "field twice": ("TABLE t { a INT } DATA STRUCT t { a: 1, a: 2 }", e.DuplicateStructuredDataFields(table_name="t", duplicated_column="a")),
    "given generated": ("TABLE t { a INT, b INT GENERATED AS { 7 } } DATA t(a, b) { 1, 2 }", e.ComputedColumnCannotBeExplicitlySpecified(table_name="t", column_name="b", compute_expression=" 7 ")),
    "exclusive twice": ("TABLE t { a INT } DATA EXCLUSIVE t { 1 } DATA t { 2 }", e.ExclusiveDataDefinedMultipleTimes(table_name="t")),
    "nested in itself": (KEYED + "DATA t { 1 WITH t { 2 } }", e.ExtraDataRecursiveInsert(parent_table="t", extra_table="t")),
    "nested nowhere": (KEYED + "DATA t { 1 WITH u { 2 } }", e.ExtraDataTableNotFound(parent_table="t", extra_table="u")),
    "nested unrelated": (KEYED + "TABLE u { a INT } DATA t { 1 WITH u { 2 } }", e.ExtraTableHasNoForeignKeysToThisTable(parent_table="t", extra_table="u")),
    "nested ambiguous": (KEYED + "TABLE u { a REF t, b REF t, c INT } DATA t { 1 WITH u { 2 } }", e.ExtraTableMultipleAmbigousForeignKeysToThisTable(parent_table="t", extra_table="u", column_list=["a", "b"])),
    "nested redefines": (KEYED + "TABLE u { a REF t, c INT } DATA t { 1 WITH u(a, c) { 1, 2 } }", e.ExtraTableCannotRedefineReferenceKey(parent_table="t", extra_table="u", column_name="a")),
    "nested without key": ("TABLE t { a INT } DATA t { 1 WITH t { 2 } }", e.ExtraDataParentMustHavePrimaryKey(parent_table="t")),
    "nested in a cycle": (
        "TABLE x { a TEXT PRIMARY KEY, o REF y } TABLE y { b INT PRIMARY KEY, s REF x } DATA x(a, o) { p, 1 WITH y(b) { 1 WITH x(a) { q } } }",
        e.CyclingTablesInContextualInsertsNotAllowed(table_loop=["x", "y", "x"]),
    ),
    "key twice": (KEYED + "DATA t { 1; 2; 1 }", e.DuplicatePrimaryKey(table_name="t", value="1")),
    "orphan": (KEYED + "TABLE u { a REF t } DATA t { 1 } DATA u { 1; 5 }", e.NonExistingForeignKey(table_with_foreign_key="u", foreign_key_column="a", referred_table="t", referred_table_column="id", key_value="5")),
    "child key twice": (KEYED + "TABLE u { a INT PRIMARY KEY CHILD OF t } DATA t { 1 WITH u { 3; 3 } }", e.FoundDuplicateChildPrimaryKeySet(table_name="u", columns="(id, a)", duplicate_values="(1, 3)")),
    "no parent": (KEYED + "TABLE u { a INT PRIMARY KEY CHILD OF t } DATA u { 4, 3 }", e.ParentRecordWithSuchPrimaryKeysDoesntExist(parent_table="t", parent_columns_names_searched="(id)", parent_columns_to_find="(4)")),
    "unique violated": ("TABLE t { a INT, b BOOL, UNIQUE(a, b) } DATA t { 1, true; 1, true }", e.UniqConstraintViolated(table_name="t", tuple_definition="(a, b)", tuple_value="(1, true)")),
    "infinite": ("TABLE t { a FLOAT } DATA t { 1; inf }", e.NanOrInfiniteFloatNumbersAreNotAllowed(table_name="t", column_name="a", column_value="inf", row_index=2)),
    "path with blanks": (
        "TABLE u { k TEXT PRIMARY KEY } TABLE v { l TEXT PRIMARY KEY CHILD OF u } TABLE t { a REF FOREIGN CHILD v } DATA u { x WITH v { y } } DATA t { x =>y }",
        e.ForeignChildKeyReferrerCannotHaveWhitespaceInSegments(referrer_table="t", referrer_column="a", referee_table="v", offending_value="x =>y"),
    ),
    "path too short": (
        "TABLE u { k TEXT PRIMARY KEY } TABLE v { l TEXT PRIMARY KEY CHILD OF u } TABLE t { a REF FOREIGN CHILD v } DATA u { x WITH v { y } } DATA t { y }",
        e.ForeignChildKeyReferrerHasIncorrectSegmentsInCompositeKey(referrer_table="t", referrer_column="a", referee_table="v", expected_segments=2, actual_segments=1, offending_value="y"),
    ),
    "key that no path spells": (
        "TABLE u { k TEXT PRIMARY KEY } TABLE v { l TEXT PRIMARY KEY CHILD OF u } TABLE t { a REF FOREIGN CHILD v } DATA u { \"x y\" WITH v { y } }",
        e.ForeignChildKeyTableStringMustBeAlphanumeric(referred_table="u", offending_column="k", offending_value="x y"),
    ),
    "check fails": (
        "TABLE t { id INT PRIMARY KEY, CHECK { id > 7 } } DATA t { 8; 2 }",
        e.LuaCheckEvaluationFailed(table_name="t", expression=" id > 7 ", column_names=["id"], row_values=["2"], error="Expression check for the row didn't pass."),
    ),
    "check of a wrong type": (
        "TABLE t { id INT PRIMARY KEY, CHECK { id * 3 } } DATA t { 2 }",
        e.LuaCheckEvaluationErrorUnexpectedReturnType(table_name="t", expression=" id * 3 ", column_names=["id"], row_values=["2"], error="Unexpected expression return value, expected boolean, got integer"),
    ),
    "generated text from a number": (
        "TABLE t { id INT, s TEXT GENERATED AS { id + 1 } } DATA t { 1; 2 }",
        e.LuaColumnGenerationExpressionComputeTypeMismatch(
            table_name="t", column_name="s", input_row_fields=["id"], input_row_values=["1"], computed_value="2", expression=" id + 1 ", error="Computed column expects lua expression to evaluate to type string, got integer"
        ),
    ),
    "generated fraction": (
        "TABLE t { id INT, n INT GENERATED AS { id * 1.5 } } DATA t { 2; 1 }",
        e.LuaColumnGenerationExpressionComputeTypeMismatch(
            table_name="t", column_name="n", input_row_fields=["id"], input_row_values=["1"], computed_value="1.5", expression=" id * 1.5 ", error="Computed column expects lua expression to evaluate to type integer, got number"
        ),
    ),
    "generated nothing": (
        "TABLE t { id INT, f FLOAT GENERATED AS { nil } } DATA t { 1 }",
        e.LuaColumnGenerationExpressionComputeTypeMismatch(
            table_name="t", column_name="f", input_row_fields=["id"], input_row_values=["1"], computed_value="nil", expression=" nil ", error="Computed column expects lua expression to evaluate to type number, got nil"
        ),
    ),
    "queued for nothing": ("TABLE t { id INT } INCLUDE LUA { data('u', {}) }", e.LuaDataTableNoSuchTable(expected_insertion_table="u")),
    "queued under a number": ("TABLE t { id INT } INCLUDE LUA { data(123, {}) }", e.LuaDataTableInvalidKeyTypeIsNotString(found_value="integer 123")),
    "queued text": ("TABLE t { id INT } INCLUDE LUA { data('t', 'hi') }", e.LuaDataTableInvalidRecordValue(found_value='string "hi"')),
    "queued bytes": ("TABLE t { id INT } INCLUDE LUA { data(string.char(255, 255), {}) }", e.LuaDataTableInvalidKeyTypeIsNotValidUtf8String(lossy_value="��", bytes=[255, 255])),
    "queued function": ("TABLE t { id INT } INCLUDE LUA { data('t', { id = function() return 1 end }) }", e.LuaDataTableRecordInvalidColumnValue(column_name="id", column_value="*lua function*")),
    "default missing": ("TABLE t { a INT DETACHED DEFAULT }", e.DetachedDefaultUndefined(table="t", column="a")),
    "default twice": ("TABLE t { a INT DETACHED DEFAULT } DEFAULTS { t.a 1, t.a 2 }", e.DetachedDefaultDefinedMultipleTimes(table="t", column="a", expression_a="1", expression_b="2")),
    "default of a wrong type": ("TABLE t { a INT DETACHED DEFAULT } DEFAULTS { t.a x }", e.DetachedDefaultBadValue(table="t", column="a", value="x", expected_type="INT", error="Cannot parse value to expected type for this column")),
    "proof of nothing": (ID + 'PROOF "c" NONE EXIST OF u { SELECT 1 }', e.SqlProofTableNotFound(table_name="u", comment="c", proof_expression=" SELECT 1 ")),
    "proof that is no SQL": (
        ID + 'PROOF "c" NONE EXIST OF t { invalid text here }', e.SqlProofQueryPlanningError(table_name="t", comment="c", proof_expression=" invalid text here ", error='near "invalid": syntax error in  invalid text here  at offset 1')
    ),
    "proof of two columns": (ID + 'PROOF "c" NONE EXIST OF t { SELECT 1, 2 }', e.SqlProofQueryErrorSingleRowIdColumnExpected(table_name="t", comment="c", proof_expression=" SELECT 1, 2 ", error="Required output column count is 1, got 2")),
    "proof of another column": (ID + 'PROOF "c" NONE EXIST OF t { SELECT id FROM t }', e.SqlProofQueryErrorSingleRowIdColumnExpected(table_name="t", comment="c", proof_expression=" SELECT id FROM t ", error="Required output column name must be rowid, got id")),
    "proof of another table": (
        ID + 'TABLE u { id INT } PROOF "c" NONE EXIST OF t { SELECT rowid FROM u }',
        e.SqlProofQueryColumnOriginMismatchesExpected(
            error="Actual column origin table name or origin mistmaches expectations", expected_column_origin_table="t", expected_column_origin_name="rowid", actual_column_origin_table="u", actual_column_origin_name="rowid",
            comment="c", proof_expression=" SELECT rowid FROM u ",
        ),
    ),
    "proof with a parameter": (ID + 'PROOF "c" NONE EXIST OF t { SELECT rowid FROM t WHERE id = ? }', e.SqlProofQueryError(table_name="t", comment="c", proof_expression=" SELECT rowid FROM t WHERE id = ? ", error="Wrong number of parameters passed to query. Got 0, needed 1")),
    "proof that writes": (ID + 'PROOF "c" NONE EXIST OF t { DELETE FROM t }', e.SqlProofQueryError(table_name="t", comment="c", proof_expression=" DELETE FROM t ", error="attempt to write a readonly database")),
    "proof that fails": (
        ID + 'PROOF "c" NONE EXIST OF t { SELECT x.rowid FROM (SELECT rowid, id FROM t) x WHERE id > 1 }',
        e.SqlProofOffendersFound(table_name="t", comment="c", proof_expression=" SELECT x.rowid FROM (SELECT rowid, id FROM t) x WHERE id > 1 ", offending_columns=['{\n  "id": 2.0\n}', '{\n  "id": 3.0\n}']),
    ),
    "rules that fail": (
        ID + 'PROOF "c" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id(V, Offender), V > 1. }',
        e.DatalogProofOffendersFound(table_name="t", comment="c", proof_expression=" OUTPUT(Offender) :- t_t__id(V, Offender), V > 1. ", offending_columns=['{\n  "id": 2.0\n}', '{\n  "id": 3.0\n}']),
    ),
    "rules of wrong types": (
        ID + 'PROOF "c" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id("1", Offender). }',
        e.DatalogProofQueryingFailure(table_name="t", comment="c", proof_expression=' OUTPUT(Offender) :- t_t__id("1", Offender). ', error="A requested operation cannot be performed as the values have incompatible types `integer`, `string`."),
    ),
    "rules in the wrong order": (
        ID + 'PROOF "c" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- t_t__id(Offender, V). }',
        e.DatalogProofTableExpectedNotFoundInTheOutputQuery(table_name="t", comment="c", proof_expression=" OUTPUT(Offender) :- t_t__id(Offender, V). ", error="Expected term like 't_t__<column name>(_, Offender)' not found in the output query"),
    ),
    "rules in a comment": (
        ID + 'PROOF "c" NONE EXIST OF t DATALOG { % OUTPUT(Offender)\n }',
        e.DatalogProofNoRulesFound(table_name="t", comment="c", proof_expression=" % OUTPUT(Offender)\n ", error="No datalog queries found in proof. There must exist one OUTPUT(Offender) rule in a proof."),
    ),
    "view of too few columns": ("MATERIALIZED VIEW v { a INT, b INT } AS { SELECT 1 }", e.SqlMatViewWrongColumnCount(table_name="v", sql_expression=" SELECT 1 ", expected_columns=2, actual_columns=1)),
    "view of nothing": ("MATERIALIZED VIEW v { a INT } AS { SELECT null }", e.SqlMatViewNullReturnsUnsupported(table_name="v", sql_expression=" SELECT null ", column_name="a", return_row_index=1)),
    "view of a wrong type": (
        "MATERIALIZED VIEW v { a INT } AS { SELECT 'hello' }",
        e.SqlMatViewWrongColumnTypeReturned(table_name="v", sql_expression=" SELECT 'hello' ", column_name="a", return_row_index=1, actual_column_type="TEXT", expected_column_type="INT"),
    ),
    "view with a parameter": ("MATERIALIZED VIEW v { a INT } AS { SELECT ? }", e.SqlMatViewStatementInitException(table_name="v", sql_expression=" SELECT ? ", error="Wrong number of parameters passed to query. Got 0, needed 1")),
    "view that writes": ("MATERIALIZED VIEW v { a INT } AS { INSERT INTO v VALUES(1) RETURNING a }", e.SqlMatViewStatementQueryException(table_name="v", sql_expression=" INSERT INTO v VALUES(1) RETURNING a ", error="attempt to write a readonly database")),
    "view with a key twice": (ID + "MATERIALIZED VIEW v { k INT PRIMARY KEY } AS { SELECT id / 2 FROM t }", e.DuplicatePrimaryKey(table_name="v", value="1")),
    "view with an orphan": (
        ID + "TABLE u { k INT PRIMARY KEY } MATERIALIZED VIEW v { r REF u } AS { SELECT id FROM t }",
        e.NonExistingForeignKey(table_with_foreign_key="v", foreign_key_column="r", referred_table="u", referred_table_column="k", key_value="1"),
    ),
}


@pytest.mark.parametrize("name", list(BAD))
def test_refuses(spark, name):
    text, expected = BAD[name]
    with pytest.raises(type(expected)) as found:
        compile_text(spark, text)
    assert found.value == expected


TOLD = {
    "script that cannot be read": ("INCLUDE LUA { this is no script } TABLE t { a INT }", e.LuaSourcesLoadError, "syntax error"),
    "check that cannot be read": ("TABLE t { a INT, CHECK { bozo (() * moo } } DATA t { 0 }", e.LuaCheckExpressionLoadError, "syntax error"),
    "generated from what cannot be read": ("TABLE t { a INT, b TEXT GENERATED AS { not a valid one } } DATA t { 0 }", e.LuaColumnGenerationExpressionLoadError, "syntax error"),
    "generated from a later one": (
        'TABLE t { a INT, b TEXT GENERATED AS { c .. "!" }, c TEXT GENERATED AS { "x" .. a } } DATA t { 1 }', e.LuaColumnGenerationExpressionComputeError, "attempt to concatenate global 'c' (a nil value)",
    ),
    "rules that cannot be read": (ID + 'PROOF "c" NONE EXIST OF t DATALOG { OUTPUT(Offender) :- this is no rule. }', e.DatalogProofQueryParseError, "expected comparison_operator"),
    "corrupt queue": ("TABLE t { a INT } INCLUDE LUA {\n__do_not_refer_to_this_internal_value_in_your_code_dumbo__ = nil\n}", e.LuaDataTableError, "error converting Lua nil to table"),
}


@pytest.mark.parametrize("name", list(TOLD))
def test_refuses_and_tells(spark, name):
    text, kind, part = TOLD[name]
    with pytest.raises(kind) as found:
        compile_text(spark, text)
    assert part in found.value.error


@pytest.mark.parametrize("text", ["TABLE", "TABLE t { }", "DATA t { }", "TABLE t { a INT } garbage", "DATA STRUCT t { }", "PROOF c NONE EXIST OF t { }"])
def test_syntax_errors(text):
    with pytest.raises(e.SourceSyntaxError):
        parse(text)


# files


ROOT = """
  TABLE t { id INT PRIMARY KEY, v1 TEXT, v2 FLOAT }

  DATA t(id, v1, v2) {
    1, " henlo ", 3.14;// a remark
    2, hey, 321;
  }
  DATA STRUCT t [ // another
    { id: 3, v1: "x", v2: 1.5 },
  ]
"""


def test_replacements_rewrite_their_files(spark, tmp_path):
    path = tmp_path / "root.facts"
    path.write_text(ROOT)
    changes = {"t": [{"primary_key": "1", "replacements": {"id": "5", "v2": "3.41"}}, {"primary_key": "2", "replacements": {"v1": " hey!@#))* "}}, {"primary_key": "3", "replacements": {"v1": "yo"}}]}
    db = compile_files(spark, [str(path)], changes)
    expected = {"t": [{"id": 5.0, "v1": " henlo ", "v2": 3.41}, {"id": 2.0, "v1": " hey!@#))* ", "v2": 321.0}, {"id": 3.0, "v1": "yo", "v2": 1.5}]}
    assert db.to_json() == expected
    assert path.read_text() == ROOT.replace('1, " henlo ", 3.14', '5, " henlo ", 3.41').replace("2, hey", '2, " hey!@#))* "').replace('v1: "x"', 'v1: "yo"')
    assert compile_files(spark, [str(path)]).to_json() == expected


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({"u": [{"primary_key": "1", "replacements": {}}]}, e.ReplacementsTargetTableDoesntExist(table="u")),
        ({"t": [{"primary_key": "1", "replacements": {"x": "1"}}]}, e.ReplacementsColumnNotFound(table="t", replacement_primary_key="1", column_not_found="x", available_columns=["id", "v1", "v2"])),
        ({"t": [{"primary_key": "1=>2", "replacements": {}}]}, e.ReplacementsUnexpectedKeySegmentCount(table="t", replacement_primary_key="1=>2", segments=["1", "2"], expected_segments=1, segment_separator="=>")),
        ({"t": [{"primary_key": "9", "replacements": {"v1": "a"}}]}, e.ReplacementNeverUsed(table="t", replacement_primary_key="9", replacement_uses=0, replacement_columns=["v1"], replacement_values=["a"])),
        ({"t": [{"primary_key": "1", "replacements": {}}, {"primary_key": "1", "replacements": {}}]}, e.ReplacementsDuplicatePrimaryKeyDetected(table="t", replacement_primary_key="1")),
    ],
)
def test_replacements_refused(spark, changes, expected):
    with pytest.raises(type(expected)) as found:
        compile_text(spark, ROOT, changes)
    assert found.value == expected


def test_files_include_each_other(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "root.facts").write_text('INCLUDE "sub/more.facts"\nINCLUDE LUA "sub/rows.lua"\nINCLUDE DATA { DATA t { 1, x } }\nTABLE t { id INT, folder TEXT }')
    (tmp_path / "sub" / "more.facts").write_text("DATA t { 2, y }")
    (tmp_path / "sub" / "rows.lua").write_text("data('t', { id = 3, folder = SOURCE_DIR })")
    rows = compile_files(spark, [str(tmp_path / "root.facts")]).to_json()["t"]
    assert rows == [{"id": 2.0, "folder": "y"}, {"id": 1.0, "folder": "x"}, {"id": 3.0, "folder": str(tmp_path / "sub")}]
    (tmp_path / "twice.facts").write_text('INCLUDE "sub/more.facts" INCLUDE "sub/more.facts"')
    with pytest.raises(e.FailureReadingExternalFile):
        compile_files(spark, [str(tmp_path / "twice.facts")])


def test_modules_make_rows(spark, tmp_path):
    text = 'TABLE t { id INT PRIMARY KEY, even BOOL GENERATED AS { id % 2 == 0 } } TABLE u { n INT PRIMARY KEY CHILD OF t, f FLOAT DEFAULT 1.5 } DATA MODULE OCAML "rows"'
    expected = {"t": [{"id": 1.0, "even": False}, {"id": 2.0, "even": True}], "u": [{"id": 2.0, "n": 9.0, "f": 1.5}]}
    made = {"t": [{"id": 1}, {"id": 2}], "u": [{"id": 2, "n": 9}]}
    assert compile_text(spark, text, data_modules={"rows": lambda: made}).to_json() == expected
    (tmp_path / "rows").mkdir()
    (tmp_path / "root.facts").write_text(text)
    with pytest.raises(e.OCamlDataModuleExecutionExitCodeNonZero):
        compile_files(spark, [str(tmp_path / "root.facts")])
    from proofmill.sources.modules import BEGIN, END

    (tmp_path / "rows" / "main.py").write_text(f"import json\nprint('noise', '{BEGIN}', json.dumps({made!r}), '{END}')")
    assert compile_files(spark, [str(tmp_path / "root.facts")]).to_json() == expected
    with pytest.raises(e.OCamlDataModuleTableDoesntExist):
        compile_text(spark, text, data_modules={"rows": lambda: {"z": []}})
    with pytest.raises(e.OCamlDataModuleBadColumnOutput):
        compile_text(spark, text, data_modules={"rows": lambda: {"t": [{"id": [1]}]}})


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.facts").write_text("TABLE t { id INT PRIMARY KEY }\nDATA t { 1; 2 }")
    (tmp_path / "b.facts").write_text("DATA t { 3 }")
    out = [f"--{k}={tmp_path / v}" for k, v in (("parquet-output-directory", "p"), ("json-output-directory", "j"), ("sqlite-output-file", "s.db"), ("dump-source-file", "d.program"))]
    assert cli.main([str(tmp_path / "a.facts"), str(tmp_path / "b.facts"), *out], spark) == 0
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "p" / "t")).collect()) == [1, 2, 3]
    assert spark.read.json(str(tmp_path / "j" / "t")).count() == 3
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        assert db.execute("SELECT rowid, id FROM t ORDER BY 1").fetchall() == [(1, 1), (2, 2), (3, 3)]
    assert cli.main([str(tmp_path / "d.program"), str(tmp_path / "a.facts")], spark) == 1
    assert "included more than once" in capsys.readouterr().err


def test_navigation(spark):
    db = compile_text(spark, GOOD["reference to a sibling"][0])
    row = db.pointers("opening").first()
    assert (row["title"], row["port"], row["parent"]) == ("http", 0, 0)
    assert db.pointers("host").first()["children_box"] == [0]
    assert db.pointers("port").first()["referrers_opening__port"] == [0]
    assert db.row("port", 0) == {"name": "a", "number": 80} and db.value("box", "label", 0) == "web" and db.length("host") == 1
    assert db.sql("SELECT count(*) AS n FROM port, box").first()["n"] == 1
    assert db.offenders().count() == 0
