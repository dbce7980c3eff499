"""Keys and references as DataFrame operators: each validator returns the rows that break its rule.

Nothing here broadcasts by force or gathers a key's rows in one task: duplicates come from partial aggregates, and joins
are left to the planner, which broadcasts sides it knows to be small and splits skewed ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import PATH, RID


def duplicate_keys(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def later_rows(df: DataFrame, keys: list[str], order: str = RID) -> DataFrame:
    """Rows whose keys an earlier row has."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    firsts = firsts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__first")
    same = [df[k] == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return df.join(firsts, [*same, df[order] > F.col("__first")]).select(*df.columns)


def first_later_row(df: DataFrame, keys: list[str], order: str = RID) -> DataFrame:
    """The first row whose keys an earlier row has, or none."""
    return later_rows(df, keys, order).orderBy(order).limit(1)


def _on(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [child[a] == parent[b] for a, b in pairs])


def orphans(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of child that no row of parent matches, on pairs of columns (here, there)."""
    return child.join(parent.select(*dict.fromkeys(b for _, b in pairs)), _on(child, parent, pairs), "left_anti")


def pointers(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]], name: str = "pointer", rid: str = RID) -> DataFrame:
    """child with the row number of the parent row it matches; null where there is none."""
    there = parent.select(*[parent[b].alias(f"__t{i}") for i, (_, b) in enumerate(pairs)], parent[rid].alias(name))
    same = reduce(Column.__and__, [child[a] == there[f"__t{i}"] for i, (a, _) in enumerate(pairs)])
    return child.join(there, same, "left").select(*child.columns, name)


def path_pairs(shared: list[tuple[str, str]], column: str, path: list[str], parent: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """parent with the text that a path to it has in __path, and the pairs of columns to join on."""
    spelled = F.concat_ws(PATH, *[parent[c].cast("string") for c in path])
    return parent.withColumn("__path", spelled), [*shared, (column, "__path")]


def reverse_lists(parent: DataFrame, child: DataFrame, pointer: str, name: str, value: str = RID, rid: str = RID) -> DataFrame:
    """Each parent row number with the ascending list of the child values that point to it; an empty list where none does."""
    lists = child.where(child[pointer].isNotNull()).groupBy(child[pointer].alias("__p")).agg(F.sort_array(F.collect_list(value)).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parent.select(rid).join(lists, F.col(rid) == F.col("__p"), "left").select(rid, F.coalesce(name, empty).alias(name))


def charset_offenders(df: DataFrame, column: str) -> DataFrame:
    """Keys that a path cannot spell: texts with other characters than letters, digits, _, : and -; negative numbers."""
    if dict(df.dtypes)[column] == "string":
        return df.where(~df[column].rlike("^[a-zA-Z0-9_:-]+$"))
    return df.where(df[column] < 0)


def shape_offenders(df: DataFrame, column: str, segments: int, separator: str = PATH) -> DataFrame:
    """Paths with blanks around a segment, or with another number of segments (in __segments; -1: blanks)."""
    parts = F.split(df[column], "\\Q" + separator + "\\E")
    padded = F.exists(parts, lambda p: p.rlike("^\\s|\\s$"))
    found = df.withColumn("__segments", F.when(padded, F.lit(-1)).otherwise(F.size(parts)))
    return found.where(F.col("__segments") != segments)


def infinite_offenders(df: DataFrame, column: str) -> DataFrame:
    """Rows with NaN or an infinity."""
    return df.where(F.isnan(df[column]) | (F.abs(df[column]) == float("inf")))


def overlaid(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns' values from the row of changes with the same keys, where that row has one."""
    new = changes.select(*[changes[k].alias(f"__k{i}") for i, k in enumerate(keys)], *[changes[c].alias(f"__new_{c}") for c in columns])
    same = reduce(Column.__and__, [df[k] == new[f"__k{i}"] for i, k in enumerate(keys)])
    return df.join(new, same, "left").select(*[F.coalesce(F.col(f"__new_{c}"), df[c]).alias(c) if c in columns else df[c] for c in df.columns])


def unused(changes: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes whose keys df lacks."""
    return orphans(changes, df, [(k, k) for k in keys])
