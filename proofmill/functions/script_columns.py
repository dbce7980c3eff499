"""Expressions of the scripting language over rows.

An expression becomes a Column wherever its meaning can be kept: arithmetic, comparison, logic, concatenation, common library functions,
locals, branches, and calls of functions that only return an expression of their arguments. Anything else is interpreted in
Arrow batches on the executors. There, each task has globals of its own: what an expression writes into globals is not seen by other tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .script import Function, Machine, Node, ScriptError, Table, as_returning, read, truthy, type_name, value_text

#: Names of types in messages, by declared type.
EXPECTED = {"TEXT": "string", "INT": "integer", "FLOAT": "number", "BOOL": "boolean"}
OUTCOME = "kind string, num double, txt string, flag boolean, err string"


class Untranslatable(Exception):
    """The expression has to be interpreted."""


@dataclass
class Value:
    """kind: num, str, bool, nil, or maybe (a number or nil); known: its Python value if constant."""

    kind: str
    col: Column | None = None
    known: Any = None
    constant: bool = False


NIL = Value("nil", None, None, True)


def constant(v: Any) -> Value:
    if v is None:
        return NIL
    if isinstance(v, bool):
        return Value("bool", F.lit(v), v, True)
    if isinstance(v, float):
        return Value("num", F.lit(v), v, True)
    try:
        return Value("str", F.lit(v.decode()), v, True)
    except UnicodeDecodeError:
        raise Untranslatable from None


def number_as_text(x: Column) -> Column:
    """A double with 14 significant digits, as scripts write it."""
    shown = F.format_string("%.14g", x)
    shown = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    whole = F.when((x == F.rint(x)) & (F.abs(x) < 1e14), F.when(x == 0, F.lit("0")).otherwise(x.cast("bigint").cast("string"))).otherwise(shown)
    return F.when(F.isnan(x), "nan").when(x == math.inf, "inf").when(x == -math.inf, "-inf").otherwise(whole)


class Translator:
    """Chunks to Columns. fields: the row's values by name; machine: what scripts have defined."""

    def __init__(self, fields: dict[str, Value], machine: Machine):
        self.fields, self.machine, self.depth = fields, machine, 0

    def chunk(self, nodes: list[Node], scope: dict[str, Value]) -> Value:
        for i, n in enumerate(nodes):
            if n.kind == "local":
                values = [self.value(x, scope) for x in n.b]
                if any(x.kind in ("call", "more") for x in n.b) and len(n.b) < len(n.a):
                    raise Untranslatable
                scope = scope | {name: values[k] if k < len(values) else NIL for k, name in enumerate(n.a)}
            elif n.kind == "return":
                if len(n.a) > 1:
                    raise Untranslatable
                return self.value(n.a[0], scope) if n.a else NIL
            elif n.kind == "do" and n.a and n.a[-1].kind == "return":
                return self.chunk(n.a, scope)
            elif n.kind == "if":
                rest = nodes[i + 1 :]
                out = self.chunk([*n.b, *([] if n.b and n.b[-1].kind == "return" else rest)], scope)
                for test, body in reversed(n.a):
                    arm = self.chunk([*body, *([] if body and body[-1].kind == "return" else rest)], scope)
                    out = self.choose(self.truth(self.value(test, scope)), arm, out)
                return out
            else:
                raise Untranslatable
        return NIL

    @staticmethod
    def choose(test: Value, yes: Value, no: Value) -> Value:
        if test.constant:
            return yes if test.known else no
        if yes.kind != no.kind or yes.kind in ("nil", "maybe"):
            raise Untranslatable
        return Value(yes.kind, F.when(test.col, yes.col).otherwise(no.col))

    @staticmethod
    def truth(v: Value) -> Value:
        if v.kind == "bool":
            return v
        if v.kind == "maybe":
            return Value("bool", v.col.isNotNull())
        return constant(v.kind != "nil")

    def value(self, n: Node, scope: dict[str, Value]) -> Value:
        kind = n.kind
        if kind == "constant":
            return constant(n.a)
        if kind == "single":
            return self.value(n.a, scope)
        if kind == "name":
            if n.a in scope:
                return scope[n.a]
            if n.a in self.fields:
                return self.fields[n.a]
            v = self.machine.globals.get(n.a)
            if v is None or isinstance(v, (bool, float, bytes)):
                return constant(v)
            raise Untranslatable
        if kind == "unary":
            v = self.value(n.b, scope)
            if n.a == "not":
                t = self.truth(v)
                return constant(not t.known) if t.constant else Value("bool", ~t.col)
            if n.a == "-" and v.kind == "num":
                return constant(-v.known) if v.constant else Value("num", -v.col)
            if n.a == "#" and v.kind == "str":
                return Value("num", F.octet_length(v.col).cast("double"))
            raise Untranslatable
        if kind == "binary":
            return self.binary(n.a, n.b, n.c, scope)
        if kind == "call":
            return self.call(n, scope)
        if kind == "method" and self.machine.globals.get("string") is not None:
            return self.library(("string", n.b), [self.value(x, scope) for x in (n.a, *n.c)])
        if kind == "index":
            return self.path(n)
        raise Untranslatable

    def path(self, n: Node) -> Value:
        """A constant in a table that scripts have filled."""
        keys = []
        while n.kind == "index" and n.b.kind == "constant":
            keys.insert(0, n.b.a)
            n = n.a
        at = self.machine.globals.get(n.a) if n.kind == "name" and n.a not in self.fields else None
        for k in keys:
            at = at.get(k) if isinstance(at, Table) else None
        if at is None or not isinstance(at, (bool, float, bytes)):
            raise Untranslatable
        return constant(at)

    def binary(self, op: str, left: Node, right: Node, scope: dict[str, Value]) -> Value:
        a = self.value(left, scope)
        if op in ("and", "or"):
            t = self.truth(a)
            if t.constant:
                return self.value(right, scope) if t.known == (op == "and") else a
            b = self.value(right, scope)
            if a.kind != "bool":
                raise Untranslatable
            if b.kind == "bool":
                return Value("bool", a.col & b.col if op == "and" else a.col | b.col)
            raise Untranslatable
        b = self.value(right, scope)
        if op in ("==", "~="):
            if "maybe" in (a.kind, b.kind) or "nil" in (a.kind, b.kind):
                if a.kind == b.kind == "maybe":
                    same = Value("bool", a.col.eqNullSafe(b.col))
                elif "maybe" in (a.kind, b.kind):
                    m, o = (a, b) if a.kind == "maybe" else (b, a)
                    if o.kind not in ("nil", "num"):
                        same = constant(False)
                    else:
                        same = Value("bool", m.col.isNull() if o.kind == "nil" else m.col.eqNullSafe(o.col))
                else:
                    same = constant(a.kind == b.kind)
            elif a.kind != b.kind:
                same = constant(False)
            else:
                same = Value("bool", a.col == b.col)
                if a.kind == "num":
                    same = Value("bool", (a.col == b.col) & ~F.isnan(a.col))
            if op == "==":
                return same
            return constant(not same.known) if same.constant else Value("bool", ~same.col)
        if op == "..":
            parts = [v.col if v.kind == "str" else number_as_text(v.col) if v.kind == "num" else None for v in (a, b)]
            if None in [p if p is None else 0 for p in parts]:
                raise Untranslatable
            return Value("str", F.concat(*parts))
        if op in ("<", ">", "<=", ">="):
            if a.kind != b.kind or a.kind not in ("num", "str"):
                raise Untranslatable
            out = {"<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[op]
            if a.kind == "num":  # a NaN is greater than all in SQL, and nothing here
                out = out & ~F.isnan(a.col) & ~F.isnan(b.col)
            return Value("bool", out)
        if a.kind != "num" or b.kind != "num":
            raise Untranslatable
        return Value("num", self.arithmetic(op, a, b))

    @staticmethod
    def arithmetic(op: str, a: Value, b: Value) -> Column:
        x, y = a.col, b.col
        if op in ("+", "-", "*"):
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        if op == "/":
            if b.constant and b.known:
                return x / y
            endless = F.when((x == 0) | F.isnan(x), F.lit(math.nan)).when(x > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
            return F.when(y == 0, endless).otherwise(F.try_divide(x, y))
        if op == "%":
            if b.constant and b.known and b.known > 0:
                return F.when(F.abs(x) == math.inf, F.lit(math.nan)).otherwise(F.pmod(x, y))
            raise Untranslatable
        if op == "^" and b.constant and b.known == math.floor(b.known):
            return F.pow(x, y)
        raise Untranslatable

    def call(self, n: Node, scope: dict[str, Value]) -> Value:
        args = [self.value(x, scope) for x in n.b]
        if n.a.kind == "index" and n.a.a.kind == "name" and n.a.b.kind == "constant":
            if n.a.a.a in scope or n.a.a.a in self.fields:
                raise Untranslatable
            return self.library((n.a.a.a, value_text(n.a.b.a)), args)
        if n.a.kind != "name" or n.a.a in scope or n.a.a in self.fields:
            raise Untranslatable
        f = self.machine.globals.get(n.a.a)
        if isinstance(f, Function):
            if f.more or (f.scope is not None and self._holds(f)) or self.depth > 20:
                raise Untranslatable
            inner = {name: args[i] if i < len(args) else NIL for i, name in enumerate(f.names)}
            self.depth += 1
            try:
                return self.chunk(f.body, inner)
            finally:
                self.depth -= 1
        if f is self.machine.globals.get("tostring") and n.a.a == "tostring" and len(args) == 1:
            if args[0].kind == "num":
                return Value("str", number_as_text(args[0].col))
            if args[0].kind == "str":
                return args[0]
            if args[0].kind == "bool":
                return Value("str", args[0].col.cast("string"))
        raise Untranslatable

    @staticmethod
    def _holds(f: Function) -> bool:
        at = f.scope
        while at is not None:
            if at.names:
                return True
            at = at.outer
        return False

    def library(self, which: tuple[str, str], args: list[Value]) -> Value:
        held = self.machine.globals.get(which[0])
        if not isinstance(held, Table) or not callable(held.get(which[1].encode())) or isinstance(held.get(which[1].encode()), Function):
            raise Untranslatable
        kinds = [a.kind for a in args]
        cols = [a.col for a in args]
        if which[0] == "math" and kinds and set(kinds) == {"num"}:
            one = len(args) == 1
            if which[1] in ("floor", "ceil") and one:
                done = F.floor(cols[0]) if which[1] == "floor" else F.ceil(cols[0])
                return Value("num", F.when(F.abs(cols[0]) < 2.0**52, done.cast("double")).otherwise(cols[0]))
            if which[1] == "abs" and one:
                return Value("num", F.abs(cols[0]))
            if which[1] == "sqrt" and one:
                return Value("num", F.sqrt(cols[0]))
            if which[1] in ("min", "max"):
                return args[0] if one else Value("num", F.least(*cols) if which[1] == "min" else F.greatest(*cols))
        if which[0] == "string" and kinds[:1] == ["str"]:
            if which[1] == "len" and len(args) == 1:
                return Value("num", F.octet_length(cols[0]).cast("double"))
            if which[1] in ("upper", "lower") and len(args) == 1:
                small, big = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                return Value("str", F.translate(cols[0], *((small, big) if which[1] == "upper" else (big, small))))
            if which[1] == "rep" and kinds == ["str", "num"] and args[1].constant:
                return Value("str", F.repeat(cols[0], max(0, int(args[1].known))))
            if which[1] == "find" and len(args) >= 2 and args[1].constant and isinstance(args[1].known, bytes):
                plain = len(args) == 4 and args[3].constant and truthy(args[3].known) and args[2].constant and args[2].known == 1.0
                if plain or (len(args) == 2 and not set(args[1].known) & set(b"^$()%.[]*+-?")):
                    before = F.octet_length(F.substring_index(cols[0], args[1].known.decode(), 1)) if args[1].known else F.lit(0)
                    return Value("maybe", F.when(F.contains(cols[0], cols[1]), (before + 1).cast("double")))
        raise Untranslatable


@functools.lru_cache(maxsize=64)
def machine_of(scripts: tuple[tuple[str, str | None], ...]) -> Machine:
    """Globals after the scripts (text, folder) have run."""
    machine = Machine()
    for text, folder in scripts:
        if folder is not None:
            machine.globals["SOURCE_DIR"] = folder.encode()
        machine.run(read(text))
    return machine


def to_script(v: Any) -> Any:
    if isinstance(v, str):
        return v.encode()
    if v is None or isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
        return v if isinstance(v, bool) else float(v)
    return float(v)


def evaluated(scripts: tuple[tuple[str, str | None], ...], text: str, names: list[str], columns: list[Column]) -> Column:
    """The outcome of interpreting the expression on each row: OUTCOME."""

    @F.pandas_udf(OUTCOME)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, chunk = machine_of(scripts), read(as_returning(text))
        for frame in frames:
            out = []
            for row in zip(*[frame[c] for c in frame.columns], strict=True) if names else [()] * len(frame):
                for name, v in zip(names, row, strict=False):
                    machine.globals[name] = to_script(v)
                try:
                    out.append(outcome(machine.run(chunk)))
                except ScriptError as err:
                    out.append(("error", None, None, None, str(err)))
            for name in names:
                machine.globals.pop(name, None)
            done = pd.DataFrame(out, columns=["kind", "num", "txt", "flag", "err"])
            done["num"] = done["num"].astype(float)
            done["flag"] = done["flag"].astype(object)
            yield done

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)] or [F.lit(0).alias("none")]))


def outcome(v: Any) -> tuple:
    kind = type_name(v)
    if kind in ("integer", "number"):
        return kind, v, value_text(v), None, None
    return kind, None, value_text(v), v if kind == "boolean" else None, None


def field_value(kind: str, c: Column) -> Value:
    return Value({"TEXT": "str", "BOOL": "bool"}.get(kind, "num"), c if kind in ("TEXT", "BOOL") else c.cast("double"))


@dataclass
class Compiled:
    """result: the value as the wanted type; wrong: where it is none of it; said: OUTCOME of the rows that are wrong."""

    result: Column
    wrong: Column
    said: Column
    native: bool


def _said(kind: Column | str, num: Column | None = None, txt: Column | None = None, flag: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (num if num is not None else none("double")).alias("num"), (txt if txt is not None else none("string")).alias("txt"), (flag if flag is not None else none("boolean")).alias("flag"), none("string").alias("err"))


def compile_expression(text: str, fields: list[tuple[str, str, Column]], scripts: tuple[tuple[str, str | None], ...], wanted: str, native: bool = True) -> Compiled:
    """fields: name, declared type and Column of each value of the row; wanted: a declared type. ScriptError if the text cannot be read."""
    chunk = read(as_returning(text))
    try:
        if not native:
            raise Untranslatable
        v = Translator({n: field_value(t, c) for n, t, c in fields}, machine_of(scripts)).chunk(chunk, {})
        if v.kind == "maybe":
            raise Untranslatable
        if v.kind == "nil":
            said = _said("nil", txt=F.lit("nil"))
        elif v.kind == "num":
            whole = (v.col == F.rint(v.col)) & (F.abs(v.col) < 2.0**63)
            said = _said(F.when(whole, "integer").otherwise("number"), v.col, F.when(whole, v.col.cast("decimal(38,0)").cast("string")).otherwise(v.col.cast("string")))
        else:
            said = _said("string" if v.kind == "str" else "boolean", None, v.col.cast("string"), v.col if v.kind == "bool" else None)
        of_kind = {"TEXT": "str", "BOOL": "bool", "INT": "num", "FLOAT": "num"}[wanted] == v.kind
        if not of_kind:
            none = F.lit(None).cast({"TEXT": "string", "INT": "bigint", "FLOAT": "double", "BOOL": "boolean"}[wanted])
            return Compiled(none, F.lit(True), said, True)
        if wanted == "INT":
            fits = (v.col == F.rint(v.col)) & (F.abs(v.col) < 2.0**63)
            return Compiled(F.when(fits, v.col.cast("bigint")), ~fits, said, True)
        return Compiled(v.col, F.lit(False), said, True)
    except Untranslatable:
        pass
    used = _names(chunk)
    machine = machine_of(scripts)
    if any(isinstance(machine.globals.get(n), Function) for n in used):
        used = {n for n, _, _ in fields}  # a function may read any of the row's values
    mine = [(n, c) for n, _, c in fields if n in used]
    return _from_outcome(evaluated(scripts, text, [n for n, _ in mine], [c for _, c in mine]), wanted)


def _names(x: Any) -> set[str]:
    if isinstance(x, Node):
        return ({x.a} if x.kind == "name" else set()) | _names(x.a) | _names(x.b) | _names(x.c)
    if isinstance(x, (list, tuple)):
        return set().union(*map(_names, x)) if x else set()
    return set()


def with_generated(df: DataFrame, columns: list[tuple[str, str, str]], known: list[tuple[str, str]], scripts: tuple[tuple[str, str | None], ...]) -> tuple[DataFrame, list[tuple[int, Column]]]:
    """df with the generated columns (name, type, expression), each of which may use known ones and earlier ones.

    Also, for each that could be wrong, its number and the column that says where and how; these are columns of df named __said_N, null where all is well.
    """
    fields = [(n, t, F.col(n)) for n, t in known]
    checks = []
    for k, (name, kind, text) in enumerate(columns):
        c = compile_expression(text, fields, scripts, kind)
        if not c.native:  # once, not for each use of its parts
            df = df.withColumn(f"__out_{k}", c.said)
            said = F.col(f"__out_{k}")
            c = _from_outcome(said, kind)
        df = df.withColumn(name, c.result)
        df = df.withColumn(f"__said_{k}", F.when(c.wrong, c.said))
        if not c.native:
            df = df.drop(f"__out_{k}")
        checks.append((k, F.col(f"__said_{k}")))
        fields.append((name, kind, F.col(name)))
    return df, checks


def _from_outcome(said: Column, wanted: str) -> Compiled:
    kind, num = said["kind"], said["num"]
    result, kinds = {
        "TEXT": (said["txt"], ("string",)), "BOOL": (said["flag"], ("boolean",)), "INT": (num.cast("bigint"), ("integer",)),
        "FLOAT": (F.coalesce(num, F.lit(math.nan)), ("integer", "number")),  # a batch of pandas knows no NaN beside null
    }[wanted]
    return Compiled(F.when(kind.isin(*kinds), result), ~kind.isin(*kinds), said, False)
