"""Datalog on DataFrames: each rule a join tree, each recursive component a semi-naive loop or doubled steps, components in order of their dependence.

Relations are sets: rows are distinct. A relation's columns are named c0, c1, ...
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Atom, Constant, Literal, Rule, RuleError, RuleProgram, Term, Variable
from ..sources.staging import Rounds
from .fixpoint import single, unseen, walks

_KINDS = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "boolean": "boolean"}
_DECLARED = {"string": "string", "integer": "bigint", "boolean": "boolean", "float": "double"}
_VALUES = {bool: "boolean", int: "integer", float: "float", str: "string"}


def _mismatch(a: str, b: str) -> RuleError:
    return RuleError(f"A requested operation cannot be performed as the values have incompatible types `{a}`, `{b}`.")


def check_safe(rule: Rule) -> None:
    """Each variable of the head, of a negated atom and of a comparison must stand in an atom of the body that is not negated."""
    bound = rule.variables()
    head = {t.name for t in rule.head.terms if isinstance(t, Variable)} if rule.head else set()
    for x in rule.body:
        if x.atom is None:
            needed = {t.name for t in (x.left, x.right) if isinstance(t, Variable)}
        elif x.negative:
            needed = {t.name for t in x.atom.terms if isinstance(t, Variable) and t.name != "_"}
        else:
            continue
        head |= needed
    if loose := sorted(head - bound):
        raise RuleError(f"the rule is not safe: {', '.join(loose)} is bound by no atom of its body")


def strata(rules: list[Rule]) -> list[list[str]]:
    """Defined predicates by strongly connected component, each after those that it needs; RuleError if a negation stands in a cycle."""
    needs: dict[str, set[tuple[str, bool]]] = {}
    for r in rules:
        if r.head:
            needs.setdefault(r.head.predicate, set()).update((x.atom.predicate, x.negative) for x in r.body if x.atom)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w, _ in sorted(needs[v]):
            if w not in needs:
                continue
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            at = stack.index(v)
            out.append(sorted(stack[at:]))
            del stack[at:]

    for v in sorted(needs):
        if v not in index:
            visit(v)
    for group in out:
        for v in group:
            if bad := [w for w, negative in needs[v] if negative and w in group]:
                raise RuleError(f"the program is not stratified: {v} depends on the negation of {bad[0]}, which depends on {v}")
    return out


@dataclass(frozen=True)
class Chain:
    """p(A, Z) :- p(A, Y), rest(Y, Z), with any number of terms in any order, where rest knows nothing of A: rows of p go from place to place."""

    places: dict[int, tuple[str, str]]  # terms of p: the variables of rest that are there before the step and after it
    rest: Rule
    own: bool  # p starts with the steps themselves


def _shape(literals: tuple[Literal, ...], first: list[str]) -> list[Literal]:
    """The literals with variables by numbers: those of first, then others as they come."""
    codes = {v: str(i) for i, v in enumerate(first)}

    def term(t: Term | None) -> Term | None:
        return Variable(codes.setdefault(t.name, str(len(codes)))) if isinstance(t, Variable) and t.name != "_" else t

    return [Literal(Atom(x.atom.predicate, tuple(map(term, x.atom.terms))) if x.atom else None, x.negative, x.op, term(x.left), term(x.right)) for x in literals]


def chain(name: str, rules: list[Rule], given: bool) -> Chain | None:
    """What the recursion of a predicate is a chain of, if its only recursive rule is of that form. given: the predicate also has rows of its own."""
    recursive = [r for r in rules if any(x.atom and x.atom.predicate == name for x in r.body)]
    if len(recursive) != 1:
        return None
    rule = recursive[0]
    at = next(i for i, x in enumerate(rule.body) if x.atom and x.atom.predicate == name)
    before, after = rule.body[at].atom.terms, rule.head.terms
    names = [[t.name for t in side if isinstance(t, Variable) and t.name != "_"] for side in (before, after)]
    if any(len(set(x)) < len(after) for x in names) or len(before) != len(after):
        return None
    rest = Rule(rule.head, rule.body[:at] + rule.body[at + 1 :])
    places = {i: (a, b) for i, (a, b) in enumerate(zip(*names, strict=True)) if a != b}
    stay = {a for i, a in enumerate(names[0]) if i not in places}
    froms, tos = [a for a, _ in places.values()], [b for _, b in places.values()]
    used = {t.name for x in rest.body for t in (x.atom.terms if x.atom else (x.left, x.right)) if isinstance(t, Variable)}
    if not places or set(froms) & set(tos) or stay & used or not {*froms, *tos} <= rest.variables():
        return None
    pair = len(after) == 2 and len(places) == 1
    if any(x.atom and x.atom.predicate == name for x in rest.body):  # p(A, Z) :- p(A, Y), p(Y, Z): steps are what p starts with
        placed = pair and [Variable(v) for v in (froms + tos if 1 in places else tos + froms)]
        return Chain(places, rest, True) if placed and len(rest.body) == 1 and list(rest.body[0].atom.terms) == placed else None
    starts = [r for r in rules if r is not rule]
    own = False
    if pair and not given and len(starts) == 1 and all(isinstance(t, Variable) for t in starts[0].head.terms):
        (to,) = places
        ends = [starts[0].head.terms[i].name for i in (1 - to, to)]
        own = len(set(ends)) == 2 and _shape(starts[0].body, ends) == _shape(rest.body, froms + tos)
    return Chain(places, rest, own)


@dataclass
class Evaluator:
    spark: SparkSession
    relations: dict[str, DataFrame]  # extensional ones; derived ones are added

    def relation(self, name: str, arity: int) -> DataFrame:
        if name not in self.relations:
            raise RuleError(f"the relation {name} is not known")
        df = self.relations[name]
        if len(df.columns) != arity:
            raise RuleError(f"the relation {name} has {len(df.columns)} attributes, not {arity}")
        return df.toDF(*[f"c{i}" for i in range(arity)])

    def matched(self, atom: Atom, df: DataFrame) -> DataFrame:
        """A column for each variable of the atom."""
        tests: list[Column] = []
        places: dict[str, str] = {}
        for (name, kind), t in zip(df.dtypes, atom.terms, strict=True):
            if isinstance(t, Constant):
                have = _VALUES[type(t.value)]
                want = _KINDS.get(kind, kind)
                if have != want and {have, want} != {"integer", "float"}:
                    raise _mismatch(want, have)
                tests.append(df[name] == F.lit(t.value))
            elif t.name != "_":
                if t.name in places:
                    tests.append(df[name] == df[places[t.name]])
                else:
                    places[t.name] = name
        if tests:
            df = df.where(reduce(Column.__and__, tests))
        return df.select(*[F.col(c).alias(v) for v, c in places.items()]) if places else df.limit(1).select(F.lit(1).alias("__found"))

    @staticmethod
    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns and c != "__found"]
        b = b.drop("__found") if "__found" in a.columns and "__found" in b.columns else b
        kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
        for c in shared:
            x, y = _KINDS.get(kinds_a[c], kinds_a[c]), _KINDS.get(kinds_b[c], kinds_b[c])
            if x != y and {x, y} != {"integer", "float"}:
                raise _mismatch(x, y)
        return a.join(b, shared) if shared else a.crossJoin(b)

    def compared(self, x: Literal, df: DataFrame) -> Column:
        kinds = dict(df.dtypes)

        def side(t: Term) -> tuple[Column, str]:
            if isinstance(t, Constant):
                return F.lit(t.value), _VALUES[type(t.value)]
            return F.col(t.name), _KINDS.get(kinds[t.name], kinds[t.name])

        (a, ka), (b, kb) = side(x.left), side(x.right)
        if ka != kb and {ka, kb} != {"integer", "float"}:
            raise _mismatch(ka, kb)
        if x.op == "*=":
            if ka != "string":
                raise _mismatch("string", ka)
            out = F.call_function("regexp_like", a, b)
        else:
            if ka == "boolean" and x.op not in ("=", "!="):
                raise RuleError(f"booleans have no order for {x.op}")
            out = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]
        return ~out if x.negative else out

    def body(self, rule: Rule, replaced: dict[int, DataFrame] | None = None) -> DataFrame:
        """Bindings of the body's variables. replaced: relations to take at some places of the body instead."""
        out: DataFrame | None = None
        todo = list(rule.body)
        positive = [(k, x) for k, x in enumerate(todo) if x.atom and not x.negative]
        first = [kx for kx in positive if replaced and kx[0] in replaced]
        rest = first + [kx for kx in positive if kx not in first]
        bound: set[str] = set()
        while rest:  # an atom that shares a variable with what is bound comes before one that does not
            at = next((i for i, (_, x) in enumerate(rest) if bound & {t.name for t in x.atom.terms if isinstance(t, Variable)}), 0)
            k, x = rest.pop(at)
            df = replaced[k] if replaced and k in replaced else self.relation(x.atom.predicate, len(x.atom.terms))
            found = self.matched(x.atom, df)
            out = found if out is None else self.joined(out, found)
            bound |= {t.name for t in x.atom.terms if isinstance(t, Variable) and t.name != "_"}
        if out is None:
            out = self.spark.range(1).select(F.lit(1).alias("__found"))
        for x in todo:
            if x.atom is None:
                out = out.where(self.compared(x, out))
        for x in todo:
            if x.atom and x.negative:
                found = self.matched(x.atom, self.relation(x.atom.predicate, len(x.atom.terms)))
                shared = [c for c in found.columns if c in out.columns and c != "__found"]
                out = out.join(found, shared, "left_anti") if shared else out.join(found, F.lit(True), "left_anti")
        return out

    def head(self, rule: Rule, bindings: DataFrame) -> DataFrame:
        cols = [F.lit(t.value) if isinstance(t, Constant) else F.col(t.name) for t in rule.head.terms]
        return bindings.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])

    def run(self, rules: list[Rule]) -> None:
        """Derives all defined predicates."""
        for r in rules:
            check_safe(r)
        defined = [r for r in rules if r.head]
        for group in strata(rules):
            mine = [r for r in defined if r.head.predicate in group]
            if any(x.atom and x.atom.predicate in group for r in mine for x in r.body):
                self._loop(group, mine)
            else:
                parts = [self.head(r, self.body(r)) for r in mine]
                if group[0] in self.relations:
                    parts.insert(0, self.relation(group[0], len(mine[0].head.terms)))
                self.relations[group[0]] = self._union(parts).distinct()

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        for p in parts[1:]:
            for (_, a), (_, b) in zip(parts[0].dtypes, p.dtypes, strict=True):
                x, y = _KINDS.get(a, a), _KINDS.get(b, b)
                if x != y and {x, y} != {"integer", "float"}:
                    raise _mismatch(x, y)
        return reduce(DataFrame.union, parts)

    def _loop(self, group: list[str], rules: list[Rule]) -> None:
        """Semi-naive rounds over predicates that depend on each other: each rule once for each place in it that a predicate of the group takes, where only the last round's new rows stand."""
        rounds = Rounds(self.spark)
        arity = {r.head.predicate: len(r.head.terms) for r in rules}
        inside = lambda x: x.atom is not None and x.atom.predicate in group
        seeds: dict[str, list[DataFrame]] = {p: [] for p in group}
        for p in group:
            if p in self.relations:
                seeds[p].append(self.relation(p, arity[p]))
        for r in rules:
            if not any(map(inside, r.body)):
                seeds[r.head.predicate].append(self.head(r, self.body(r)))
        delta: dict[str, DataFrame] = {}
        names: dict[str, list[str]] = {p: [] for p in group}
        like: dict[str, DataFrame] = {}
        todo = [p for p in group if seeds[p]]
        if not todo:
            raise RuleError(f"the recursion of {', '.join(group)} has no start")
        for p in todo:
            like[p] = self._union(seeds[p]).distinct()
            delta[p] = rounds.keep(like[p], f"{p}_0")
            names[p].append(f"{p}_0")
        if len(group) == 1 and (found := self._chained(rounds, group[0], rules, delta[group[0]])) is not None:
            self.relations[group[0]] = found
            return
        for k in range(1, 1_000_000):
            known = {p: rounds.read(like[p], *names[p]) for p in group if names[p]}
            self.relations |= known
            found: dict[str, list[DataFrame]] = {}
            for r in rules:
                if any(x.atom and not x.negative and inside(x) and x.atom.predicate not in known for x in r.body):
                    continue
                for place, x in enumerate(r.body):
                    if inside(x) and x.atom.predicate in delta:
                        found.setdefault(r.head.predicate, []).append(self.head(r, self.body(r, {place: delta[x.atom.predicate]})))
            fresh: dict[str, DataFrame] = {}
            for p, parts in found.items():
                new = self._union(parts).distinct()
                if p in known:
                    new = unseen(new, known[p])  # new rows are distinct already
                like.setdefault(p, new)
                new = rounds.keep(new, f"{p}_{k}")
                if not new.isEmpty():
                    fresh[p] = new
                    names[p].append(f"{p}_{k}")
            if not fresh:
                return
            delta = fresh

    def _chained(self, rounds: Rounds, name: str, rules: list[Rule], start: DataFrame) -> DataFrame | None:
        """The predicate's rows, if they go from place to place in a single way."""
        form = chain(name, rules, name in self.relations)
        if form is None:
            return None
        places = {f"c{i}": (f"from{i}", f"next{i}") for i in form.places}
        froms, tos = [a for a, _ in places.values()], [b for _, b in places.values()]
        if form.own:
            stays = next(c for c in start.columns if c not in places)
            step = start.select(F.col(stays).alias(froms[0]), F.col(*places).alias(tos[0]))
        else:
            variables = [*(a for a, _ in form.places.values()), *(b for _, b in form.places.values())]
            step = self.body(form.rest).select(*[F.col(v).alias(c) for v, c in zip(variables, froms + tos, strict=True)])
        kinds, here = dict(step.dtypes), dict(start.dtypes)
        if any({kinds[a], kinds[b]} != {here[c]} for c, (a, b) in places.items()):
            return None
        if not form.own:
            step = rounds.keep(step.distinct(), f"{name}_steps_0")
        return walks(rounds, f"{name}_0", start, step, places, form.own) if single(step, froms, tos) else None

    def query(self, atom: Atom) -> DataFrame:
        """The atom's variables, each once, in their order."""
        return self.matched(atom, self.relation(atom.predicate, len(atom.terms))).distinct()


def facts(spark: SparkSession, rows: list[tuple], declared: list[tuple[str, str]] | None) -> DataFrame:
    if declared is None:
        declared = [(f"c{i}", _VALUES[type(v)]) for i, v in enumerate(rows[0])]
    for row in rows:
        for v, (_, kind) in zip(row, declared, strict=True):
            if _VALUES[type(v)] != kind and (kind, _VALUES[type(v)]) != ("float", "integer"):
                raise _mismatch(kind, _VALUES[type(v)])
    schema = ", ".join(f"c{i} {_DECLARED[kind]}" for i, (_, kind) in enumerate(declared))
    return spark.createDataFrame([tuple(float(v) if kind == "float" else v for v, (_, kind) in zip(row, declared, strict=True)) for row in rows], schema)


def read_facts(spark: SparkSession, path: str, kind: str, declared: list[tuple[str, str]]) -> DataFrame:
    """Facts of a file: csv (no header), json (arrays or objects, a line each) or parquet."""
    names = [n for n, _ in declared]
    schema = ", ".join(f"`{n}` {_DECLARED[k]}" for n, k in declared)
    if kind == "csv":
        df = spark.read.schema(schema).csv(path)
    elif kind == "json":
        df = spark.read.schema(schema).json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path).select(*names)
    else:
        raise RuleError(f"the format {kind} is not known")
    return df.toDF(*[f"c{i}" for i in range(len(names))])


def write_facts(df: DataFrame, path: str, kind: str, names: list[str]) -> None:
    out = df.toDF(*names).write.mode("overwrite")
    if kind not in ("csv", "json", "parquet", "txt"):
        raise RuleError(f"the format {kind} is not known")
    getattr(out, "csv" if kind == "txt" else kind)(path)


def violated_dependencies(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Values of the left columns that stand beside more than one value of the right ones."""
    return df.groupBy(*left).agg(F.min(F.struct(*right)).alias("lo"), F.max(F.struct(*right)).alias("hi")).where("lo <> hi").select(*left)


def evaluate(spark: SparkSession, program: RuleProgram, relations: dict[str, DataFrame] | None = None, folder: str = "") -> Evaluator:
    """All relations of a program: given ones, facts, inputs, derived ones. Outputs are written; constraints and dependencies are checked."""
    given = {k: v.toDF(*[f"c{i}" for i in range(len(v.columns))]) for k, v in (relations or {}).items()}
    for name, path, kind in program.inputs:
        if name not in program.declared:
            raise RuleError(f".input of {name}, which is not declared")
        at = path if re.match(r"^(\w+:|/)", path) else f"{folder}{path}"
        given[name] = read_facts(spark, at, kind, program.declared[name])
    for name, rows in program.facts.items():
        new = facts(spark, rows, program.declared.get(name))
        given[name] = given[name].union(new).distinct() if name in given else new.distinct()
    out = Evaluator(spark, given)
    for name, declared in program.declared.items():
        if name not in given and not any(r.head and r.head.predicate == name for r in program.rules):
            given[name] = spark.createDataFrame([], ", ".join(f"c{i} {_DECLARED[k]}" for i, (_, k) in enumerate(declared)))
    out.run(program.rules)
    for name, left, right in program.dependencies:
        names = [n for n, _ in program.declared.get(name, [])]
        places = [[f"c{int(x) - 1 if x.isdigit() else names.index(x)}" for x in side] for side in (left, right)]
        if set(places[0]) & set(places[1]):
            raise RuleError(f"an attribute of {name} depends on itself")
        if not violated_dependencies(out.relations[name], *places).isEmpty():
            raise RuleError(f"the functional dependency of {name} on {', '.join(left)} is violated")
    for r in program.rules:
        if r.head is None and not out.body(r).isEmpty():
            raise RuleError("a constraint is violated")
    for name, path, kind in program.outputs:
        df = out.relations[name]
        names = [n for n, _ in program.declared.get(name, [(c, "") for c in df.columns])]
        write_facts(df, path if re.match(r"^(\w+:|/)", path) else f"{folder}{path}", kind, names)
    return out
