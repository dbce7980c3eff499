"""How values are written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real_text(x: Column) -> Column:
    """The shortest digits of a double that give it back, never with an exponent, and without a point if it is whole."""
    shown = x.cast("string")
    part = lambda k: F.regexp_extract(shown, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    sign, frac, power = part(1), F.regexp_replace(part(3), "0+$", ""), part(4)
    digits, n = F.concat(part(2), frac), F.length(frac)
    power = F.when(power == "", F.lit(0)).otherwise(F.try_to_number(power, F.lit("S999")).cast("int"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(sign, digits, F.repeat(F.lit("0"), power - n))
    cut = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(40)))
    with_power = F.when(power < 0, small).when(power >= n, whole).otherwise(cut)
    return F.when(shown.contains("E"), with_power).when(shown == "Infinity", "inf").when(shown == "-Infinity", "-inf").otherwise(F.regexp_replace(shown, r"\.0$", ""))


def as_text(kind: str, x: Column) -> Column:
    """A value of a declared type as text."""
    return real_text(x) if kind == "FLOAT" else x.cast("string")
