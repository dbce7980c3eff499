"""The catalog: tables with their hierarchies and references worked out, from declarations alone (no rows)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import errors as e
from .ir import ColumnDecl, DetachedDefault, Program, TableDecl

TYPES = ("TEXT", "INT", "FLOAT", "BOOL")
SPARK_TYPES = {"TEXT": "string", "INT": "bigint", "FLOAT": "double", "BOOL": "boolean"}
PATH = "=>"
RID = "__rid"

# Column names that are taken, whole and as beginnings, and their order in messages.
RESERVED_BEGINNINGS = ("children_", "referrers_")
RESERVED = ("rowid", "parent", "children_", "referrers_", "method", "while", "if", "do", "for", "let", "continue", "break", "class", "object", "struct", "enum", "with")


def parse_value(kind: str, text: str) -> object:
    """A literal as a Python value; ValueError if it is not of that type."""
    if kind == "TEXT":
        return text
    if kind == "BOOL":
        if text not in ("true", "false"):
            raise ValueError(text)
        return text == "true"
    if kind == "INT":
        if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(2**63) <= int(text) < 2**63:
            raise ValueError(text)
        return int(text)
    if not re.fullmatch(r"[+-]?(?:inf|infinity|nan|[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?)", text, re.IGNORECASE):
        raise ValueError(text)
    return float(text)


@dataclass
class Column:
    name: str
    type: str
    key: str = ""  # "", "primary", "child" (primary key of a child table) or "inherited" (an ancestor's key)
    ancestor: str | None = None  # of an inherited key
    reference: str = ""  # as in ColumnDecl
    target: str | None = None
    default: object = None
    has_default: bool = False
    generated: str | None = None
    restricted: bool = False

    @property
    def required(self) -> bool:
        return not self.has_default and self.generated is None


@dataclass
class Reference:
    """How a column points to a row of another table: equal ancestors on both sides, and the target's columns spelled in the value."""

    table: str
    column: str
    target: str
    kind: str
    shared: list[tuple[str, str]]  # (column here, column there)
    path: list[str]  # columns of the target, in the order of the value's segments


@dataclass
class Table:
    name: str
    columns: list[Column]
    uniques: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    view_sql: str | None = None
    parent: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def own_key(self) -> Column | None:
        return next((c for c in self.columns if c.key in ("primary", "child")), None)

    @property
    def inherited(self) -> list[Column]:
        return [c for c in self.columns if c.key == "inherited"]

    @property
    def whole_key(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in self.columns)


class Catalog:
    def __init__(self, program: Program):
        self.tables: dict[str, Table] = {}
        self.references: list[Reference] = []
        declared: set[str] = set()
        for decl in program.tables:
            if decl.name in declared:
                raise e.TableDefinedTwice(table_name=decl.name)
            declared.add(decl.name)
            self._check(decl)
            self.tables[decl.name] = self._declare(decl)
        self._check_parents()
        self._inherit()
        self._plain_references()
        self._child_references()
        self._foreign_child_references()
        self._defaults([d for block in program.defaults for d in block], program.tables)
        for t in self.tables.values():
            self._check_uniques(t)

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def ancestors(self, name: str) -> list[str]:
        """Names of the tables above this one, root first."""
        out, at = [], self.tables[name].parent
        while at:
            out.insert(0, at)
            at = self.tables[at].parent
        return out

    def children(self, name: str) -> list[str]:
        return [t.name for t in self.tables.values() if t.parent == name]

    # one table

    @staticmethod
    def _check(t: TableDecl) -> None:
        if t.name != t.name.lower():
            raise e.TableNameIsNotLowercase(table_name=t.name)
        for c in t.columns:
            at = {"table_name": t.name, "column_name": c.name}
            if c.name != c.name.lower():
                raise e.ColumnNameIsNotLowercase(**at)
            if c.name.startswith(RESERVED_BEGINNINGS) or c.name in RESERVED:
                raise e.ColumnNameIsReserved(**at, reserved_names=list(RESERVED))
        keys = [i for i, c in enumerate(t.columns) if c.primary]
        if len(keys) > 1:
            raise e.MoreThanOnePrimaryKey(table_name=t.name)
        if keys and keys[0]:
            raise e.PrimaryKeyColumnMustBeFirst(table_name=t.name, column_name=t.columns[keys[0]].name)
        for c in t.columns:
            if not c.reference and c.type_name not in TYPES:
                raise e.UnknownColumnType(table_name=t.name, column_name=c.name, column_type=c.type_name)

    @staticmethod
    def _identifier(name: str) -> str:
        if not re.fullmatch("[a-z0-9_]+", name):
            raise e.InvalidDBIdentifier(identifier=name)
        return name

    def _declare(self, t: TableDecl) -> Table:
        columns = []
        for c in t.columns:
            at = {"table_name": t.name, "column_name": c.name}
            if t.view_sql is not None and (c.default is not None or c.detached):
                raise e.MaterializedViewsCannotHaveDefaultColumnExpression(**at)
            if t.view_sql is not None and c.generated is not None:
                raise e.MaterializedViewsCannotHaveComputedColumnExpression(**at)
            columns.append(self._column(t.name, c))
        for names in t.uniques:
            if again := [n for i, n in enumerate(names) if n in names[:i]]:
                raise e.UniqConstraintDuplicateColumn(table_name=t.name, column_name=again[0])
            for n in names:
                self._identifier(n)
        parent = next((c.child_of for c in t.columns if c.child_of), None)
        return Table(self._identifier(t.name), columns, list(t.uniques), list(t.checks), t.view_sql, parent)

    def _column(self, table: str, c: ColumnDecl) -> Column:
        at = {"table_name": table, "column_name": self._identifier(c.name)}
        if c.primary and (c.default is not None or c.detached):
            raise e.PrimaryKeysCannotHaveDefaultValue(**at)
        if (c.primary or c.reference) and c.generated is not None:
            raise e.PrimaryOrForeignKeysCannotHaveComputedValue(**at)
        kind = "TEXT" if c.reference else c.type_name
        if c.primary and kind == "FLOAT":
            raise e.FloatColumnCannotBePrimaryKey(**at)
        if c.primary and kind == "BOOL":
            raise e.BooleanColumnCannotBePrimaryKey(**at)
        if c.generated is not None and (c.default is not None or c.detached):
            raise e.DefaultValueAndComputedValueAreMutuallyExclusive(**at)
        key = "child" if c.child_of else "primary" if c.primary else ""
        out = Column(c.name, kind, key, None, c.reference, c.type_name if c.reference else None, generated=c.generated)
        if c.default is not None:
            out.has_default, out.default = True, c.default  # read once the type is certain, see _defaults()
            if not c.reference:
                try:
                    out.default = parse_value(kind, c.default)
                except ValueError:
                    raise e.CannotParseDefaultColumnValue(**at, column_type=kind, the_value=c.default) from None
        return out

    # hierarchies

    def _check_parents(self) -> None:
        for t in self.tables.values():
            if t.parent:
                at = {"table_name": t.name, "column_name": t.own_key.name, "referred_table": t.parent}
                if t.parent not in self.tables:
                    raise e.NonExistingChildPrimaryKeyTable(**at)
                if not self.tables[t.parent].own_key:
                    raise e.ParentTableHasNoPrimaryKey(**at)
        for t in self.tables.values():
            seen, up = [t.name], t.parent
            while up:
                if up in seen:
                    raise e.ChildPrimaryKeysLoopDetected(table_names=[*seen, up])
                seen.append(up)
                up = self.tables[up].parent

    def _inherit(self) -> None:
        above = {t.name: [(a, self.tables[a].own_key) for a in self.ancestors(t.name)] for t in self.tables.values()}
        for t in self.tables.values():
            for a, key in reversed(above[t.name]):
                if clash := t.column(key.name):
                    raise e.ParentPrimaryKeyColumnNameClashesWithChildColumnName(parent_table=a, parent_column=key.name, child_table=t.name, child_column=clash.name)
        for t in self.tables.values():
            t.columns = [Column(k.name, k.type, "inherited", a) for a, k in above[t.name]] + t.columns

    # references

    def _plain_references(self) -> None:
        """A plain reference takes the type of its target's key, which may be a reference itself."""
        pending = []
        for t in self.tables.values():
            for c in t.columns:
                if c.reference != "ref":
                    continue
                at = {"referrer_table": t.name, "referrer_column": c.name, "referred_table": c.target}
                if c.target not in self.tables:
                    raise e.ForeignKeyTableDoesntExist(**at)
                there = self.tables[c.target]
                if not there.own_key:
                    raise e.ForeignKeyTableDoesntHavePrimaryKey(**at)
                shared = []
                if there.inherited:
                    mine, theirs = self.ancestors(t.name), self.ancestors(there.name)
                    if not set(mine) & set(theirs):
                        raise e.ForeignKeyTableDoesNotShareCommonAncestorWithRefereeTable(**at)
                    for a, b in zip(t.inherited, there.inherited, strict=False):
                        if a.ancestor != b.ancestor:
                            break
                        shared.append((a.name, b.name))
                pending.append((c, there.own_key))
                self.references.append(Reference(t.name, c.name, c.target, "ref", shared, [there.own_key.name]))
        for _ in range(len(pending) + 1):
            for c, key in pending:
                c.type = key.type
        for t in self.tables.values():
            for c in t.inherited:
                c.type = self.tables[c.ancestor].own_key.type

    def _restrict(self, table: str, but: set[str]) -> None:
        for c in self.tables[table].columns:
            if c.key in ("primary", "child") or c.ancestor in but:
                c.restricted = True

    def _child_references(self) -> None:
        found = [(t, c) for t in self.tables.values() for c in t.columns if c.reference == "child"]
        for t, c in found:
            if c.target not in self.tables:
                raise e.ForeignKeyTableDoesntExist(referrer_table=t.name, referrer_column=c.name, referred_table=c.target)
            there = self.tables[c.target]
            at = next((i for i, k in enumerate(there.columns) if k.ancestor == t.name), None)
            if at is None:
                raise e.ReferredChildKeyTableIsNotDescendantToThisTable(referrer_table=t.name, referrer_column=c.name, expected_to_be_descendant_table=c.target)
            shared = [(k.name, k.name) for k in there.columns[: at + 1]]
            path = [k.name for k in there.columns[at + 1 :] if k.key in ("inherited", "child")]
            self.references.append(Reference(t.name, c.name, c.target, "child", shared, path))
        targets = {c.target for _, c in found}
        for name in targets:
            self._restrict(name, targets)

    def _foreign_child_references(self) -> None:
        found = [(t, c) for t in self.tables.values() for c in t.columns if c.reference.endswith("foreign child")]
        targets: set[str] = set()
        for t, c in found:
            at = {"referrer_table": t.name, "referrer_column": c.name, "referred_table": c.target}
            if c.target not in self.tables:
                raise e.ForeignKeyTableDoesntExist(**at)
            there = self.tables[c.target]
            if not there.inherited:
                raise e.ForeignChildKeyTableDoesntHaveParentTable(**at)
            mine, theirs = self.ancestors(t.name), self.ancestors(c.target)
            common = 0
            if not c.reference.startswith("explicit"):
                while common < min(len(mine), len(theirs)) and mine[common] == theirs[common]:
                    common += 1
            if common and len(mine) >= len(theirs):
                raise e.ForeignChildKeyTableIsHigherOrEqualInAncestryThanTheReferrer(**at)
            shared = [(k.name, k.name) for k in there.inherited[:common]]
            path = [k.name for k in there.inherited[common:]] + [there.own_key.name]
            self.references.append(Reference(t.name, c.name, c.target, "foreign child", shared, path))
            targets |= {c.target, *theirs[common:]}
        for name in targets:
            self._restrict(name, targets)

    # defaults and uniqueness

    def _defaults(self, detached: list[DetachedDefault], decls: list[TableDecl]) -> None:
        for t in self.tables.values():
            for c in t.columns:
                if c.reference and c.has_default:
                    try:
                        c.default = parse_value(c.type, str(c.default))
                    except ValueError:
                        raise e.CannotParseDefaultColumnValue(table_name=t.name, column_type=c.type, column_name=c.name, the_value=c.default) from None
        given: dict[tuple[str, str], str] = {}
        for d in detached:
            at = {"table": d.table, "column": d.column}
            if self._identifier(d.table) not in self.tables:
                raise e.DetachedDefaultNonExistingTable(**at, expression=d.value)
            c = self.tables[d.table].column(self._identifier(d.column))
            if c is None:
                raise e.DetachedDefaultNonExistingColumn(**at, expression=d.value)
            if (d.table, d.column) in given:
                raise e.DetachedDefaultDefinedMultipleTimes(**at, expression_a=given[d.table, d.column], expression_b=d.value)
            given[d.table, d.column] = d.value
            if c.has_default:
                shown = str(c.default).lower() if isinstance(c.default, bool) else str(c.default)
                raise e.DetachedDefaultDefinedForColumnAlreadyHavingDefaultValue(**at, hardcoded_default_value=shown, detached_default_value=d.value)
            try:
                c.default, c.has_default = parse_value(c.type, d.value), True
            except ValueError:
                raise e.DetachedDefaultBadValue(**at, value=d.value, expected_type=c.type, error="Cannot parse value to expected type for this column") from None
        for decl in decls:
            for c in decl.columns:
                if c.detached and (decl.name, c.name) not in given:
                    raise e.DetachedDefaultUndefined(table=decl.name, column=c.name)

    @staticmethod
    def _check_uniques(t: Table) -> None:
        names = t.names
        if again := [n for i, n in enumerate(names) if n in names[:i]]:
            raise e.DuplicateColumnNames(table_name=t.name, column_name=again[0])
        seen: list[set[str]] = []
        for unique in t.uniques:
            for n in unique:
                at = {"table_name": t.name, "column_name": n}
                if not (c := t.column(n)):
                    raise e.UniqConstraintColumnDoesntExist(**at)
                if c.type == "FLOAT":
                    raise e.FloatColumnCannotBeInUniqueConstraint(**at)
            if set(unique) in seen:
                raise e.DuplicateUniqConstraints(table_name=t.name)
            seen.append(set(unique))
