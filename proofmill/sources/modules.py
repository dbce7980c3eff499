"""Rows that modules make: Python callables, or programs that write JSON between two marks."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from ..plans import errors as e
from ..plans.catalog import Catalog
from ..plans.ir import Module, Object, Objects, Span

BEGIN, END = "--- rows begin ---", "--- rows end ---"
Rows = Mapping[str, Iterable[Mapping[str, Any]]]


def cell(v: Any) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, str)):
        return str(v)
    return repr(v) if isinstance(v, float) else None


def run_program(path: Path, shown: str) -> Rows:
    """A folder with a program main.py, run on the driver; what it prints between BEGIN and END is an object of tables, each a list of rows."""
    if path.is_file():
        raise e.OCamlDataModulePathIsFileAndNotDirectory(path=shown, explanation="a module is a folder")
    try:
        done = subprocess.run([sys.executable, "main.py"], cwd=path, capture_output=True, text=True, env=os.environ, check=False)
    except OSError as err:
        raise e.OCamlDataModuleExecutionFailed(path=shown, error=str(err)) from None
    if done.returncode:
        raise e.OCamlDataModuleExecutionExitCodeNonZero(path=shown, exit_code=done.returncode, stdout=done.stdout, stderr=done.stderr)
    _, found, rest = done.stdout.partition(BEGIN)
    body, ended, _ = rest.partition(END)
    if not found or not ended:
        raise e.OCamlDataModuleNoDataEmitted(path=shown, stdout=done.stdout, stderr=done.stderr)
    try:
        return json.loads(body)
    except ValueError as err:
        raise e.OCamlDataModuleCannotParseInput(path=shown, parsing_errpr=str(err)) from None


def segments(module: Module, catalog: Catalog, callables: Mapping[str, Callable[[], Rows]]) -> list[Objects]:
    rows = callables[module.path]() if module.path in callables else run_program(Path(module.folder or ".") / module.path, module.path)
    if not isinstance(rows, Mapping):
        raise e.OCamlDataModuleCannotParseInput(path=module.path, parsing_errpr="an object of tables is expected")
    out = []
    for name, items in rows.items():
        if name not in catalog.tables:
            raise e.OCamlDataModuleTableDoesntExist(path=module.path, non_existing_table=name)
        objects = []
        for item in items:
            cells = []
            for k, v in item.items():
                if (text := cell(v)) is None:
                    raise e.OCamlDataModuleBadColumnOutput(path=module.path, table=name, row_key=k, row_value=json.dumps(v, default=str), explanation="only texts, numbers and booleans are values")
                cells.append((k, Span(text)))
            objects.append(Object(tuple(cells)))
        out.append(Objects(name, tuple(objects), scripted=True))
    return out


def row_factories(catalog: Catalog) -> dict[str, Callable[..., dict[str, Any]]]:
    """For each table a function that makes a row of its columns, by name; it refuses unknown columns and the lack of required ones."""

    def make(name: str) -> Callable[..., dict[str, Any]]:
        table = catalog[name]

        def row(**values: Any) -> dict[str, Any]:
            known = {c.name for c in table.columns if c.generated is None}
            if strange := sorted(set(values) - known):
                raise TypeError(f"{name} has no column {strange[0]} that can be given")
            if missing := [c.name for c in table.columns if c.required and c.name not in values]:
                raise TypeError(f"{name} needs {missing[0]}")
            return values

        row.__name__ = name
        return row

    return {name: make(name) for name in catalog.tables}
