"""Navigation: row pointers to parents and referred rows, and ascending lists of children and referrers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import RID, Catalog, Reference
from . import keys


def reference_pointer(catalog: Catalog, frames: dict[str, DataFrame], r: Reference) -> DataFrame:
    """The referring table with `pointer`, the row number that the reference points to."""
    there = frames[r.target]
    if r.kind == "ref":
        pairs = [*r.shared, (r.column, r.path[0])]
    else:
        there, pairs = keys.path_pairs(r.shared, r.column, r.path, there)
    return keys.pointers(frames[r.table], there, pairs)


def parent_pointer(catalog: Catalog, frames: dict[str, DataFrame], table: str) -> DataFrame:
    parent = catalog[table].parent
    return keys.pointers(frames[table], frames[parent], [(k, k) for k in catalog[parent].whole_key])


def with_pointers(catalog: Catalog, frames: dict[str, DataFrame], table: str) -> DataFrame:
    """A table as it is published: its own columns, a row number in place of each reference (and `parent`), and the lists children_X and referrers_X__Y.

    Keys of ancestors are left out: they are the parent's.
    """
    t = catalog[table]
    out = frames[table].select(RID, *[c.name for c in t.columns if c.key != "inherited"])
    for r in catalog.references:
        if r.table == table:
            found = reference_pointer(catalog, frames, r).select(F.col(RID).alias("__r"), F.col("pointer").alias(f"__{r.column}"))
            out = out.join(found, out[RID] == found["__r"], "left").drop("__r").withColumn(r.column, F.col(f"__{r.column}")).drop(f"__{r.column}")
    if t.parent:
        found = parent_pointer(catalog, frames, table).select(F.col(RID).alias("__r"), F.col("pointer").alias("parent"))
        out = out.join(found, out[RID] == found["__r"], "left").drop("__r")
    for child in catalog.children(table):
        out = out.join(keys.reverse_lists(frames[table], parent_pointer(catalog, frames, child), "pointer", f"children_{child}"), RID)
    for r in catalog.references:
        if r.target == table:
            out = out.join(keys.reverse_lists(frames[table], reference_pointer(catalog, frames, r), "pointer", f"referrers_{r.table}__{r.column}"), RID)
    return out


def neighbours(df: DataFrame, group: str, order: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """df with the columns of the row that follows within the group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(order)
    return df.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in columns])
