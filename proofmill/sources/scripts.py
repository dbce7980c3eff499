"""Rows that scripts queue."""

from __future__ import annotations

from ..functions.script import QUEUE, Machine, ScriptError, Table, described, value_text
from ..functions.script_columns import machine_of
from ..plans import errors as e
from ..plans.catalog import Catalog
from ..plans.ir import Object, Objects, Script, Span


def texts(scripts: list[Script]) -> tuple[tuple[str, str | None], ...]:
    return tuple((s.text, s.folder) for s in scripts)


def run_scripts(scripts: list[Script]) -> Machine:
    done: list[Script] = []
    for s in scripts:
        done.append(s)
        try:
            machine_of(texts(done))
        except ScriptError as err:
            raise e.LuaSourcesLoadError(error=str(err), source_file=s.path) from None
    return machine_of(texts(scripts))


def _name(v: object, bad: type[e.ValidationError], not_text: type[e.ValidationError]) -> str:
    if not isinstance(v, bytes):
        raise not_text(found_value=described(v))
    try:
        return v.decode()
    except UnicodeDecodeError:
        raise bad(lossy_value=v.decode("utf-8", "replace"), bytes=list(v)) from None


def queued(machine: Machine, catalog: Catalog) -> list[Objects]:
    """A segment for each table that scripts have queued rows for."""
    queue = machine.globals.get(QUEUE)
    if not isinstance(queue, Table):
        raise e.LuaDataTableError(error=f"error converting Lua {described(queue)} to table")
    out = []
    for key, rows in queue.items.items():
        name = _name(key, e.LuaDataTableInvalidKeyTypeIsNotValidUtf8String, e.LuaDataTableInvalidKeyTypeIsNotString)
        if not isinstance(rows, Table):
            raise e.LuaDataTableInvalidTableValue(found_value=described(rows))
        if name not in catalog.tables:
            raise e.LuaDataTableNoSuchTable(expected_insertion_table=name)
        objects = []
        for row in rows.sequence():
            if not isinstance(row, Table):
                raise e.LuaDataTableInvalidRecordValue(found_value=described(row))
            cells = []
            for column, v in row.items.items():
                column = _name(column, e.LuaDataTableRecordInvalidColumnNameUtf8String, e.LuaDataTableInvalidRecordColumnNameValue)
                if not isinstance(v, (bool, float, bytes)):
                    raise e.LuaDataTableRecordInvalidColumnValue(column_name=column, column_value=described(v))
                cells.append((column, Span(value_text(v))))
            objects.append(Object(tuple(cells)))
        out.append(Objects(name, tuple(objects), scripted=True))
    return out
