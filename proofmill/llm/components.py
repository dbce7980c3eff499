"""Connected components by least labels and pointer jumping, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (its least reachable node), for the nodes of links(a, b)."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = scratch.stage(both, f"{name}_links")
    labels = scratch.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}_0")
    for turn in range(1, 100):
        told = both.join(labels.withColumnsRenamed({"node": "a", "component": "c"}), "a").groupBy(F.col("b").alias("node")).agg(F.min("c").alias("c"))
        near = labels.join(told, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        near = scratch.stage(near, f"{name}_near{turn}")
        jump = near.select(F.col("node").alias("c"), F.col("c").alias("further"))
        new = scratch.stage(near.join(jump, "c").select("node", "old", F.col("further").alias("component")), f"{name}_{turn}")
        still = new.where("old <> component").limit(1).count()
        scratch.drop(f"{name}_near{turn}", f"{name}_{turn - 1}")
        labels = new.select("node", "component")
        if not still:
            return labels
    raise RuntimeError("the components did not settle")
