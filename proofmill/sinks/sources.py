"""Edits of a program's own sources: replaced values, with all else as it stands, comments included."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

from ..plans.ir import Program
from ..plans.parser import _GAP, _WORD
from ..sources.literals import Edit

_PLAIN = re.compile(f"{_WORD.pattern}(?:{_GAP.pattern}{_WORD.pattern})*")


def written(value: str, quoted: bool) -> str:
    """A value as it may stand in a source."""
    if quoted or _PLAIN.fullmatch(value):
        return value
    return f'"{value}"' if '"' not in value else f"'{value}'"


def edited(program: Program, edits: list[Edit]) -> dict[str, str]:
    """The new text of each file that changes, by path."""
    by_source: dict[int, list[Edit]] = defaultdict(list)
    for x in edits:
        by_source[x.source].append(x)
    out = {}
    for number, own in by_source.items():
        source = program.sources[number]
        if source.folder is None:
            continue
        text = source.text
        for x in sorted(own, key=lambda x: -x.start):
            low = source.origin[x.start]
            high = source.origin[x.end - 1] + 1 if x.end > x.start else low
            quoted = text[low - 1 : low] in ("'", '"') and low > 0 and text[low - 1] == text[high : high + 1]
            text = text[:low] + written(x.value, quoted) + text[high:]
        out[source.path] = text
    return out


def write_back(program: Program, edits: list[Edit]) -> list[str]:
    """Writes the files that change; their paths."""
    changed = edited(program, edits)
    for path, text in changed.items():
        Path(path).write_text(text, encoding="utf-8")
    return sorted(changed)
