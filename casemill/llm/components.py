"""Connected components by alternating star contractions, each step a join and a map-side minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang the larger neighbours of a node on the least node around it. Small: the node and its smaller ones."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("v_least")).select(
        F.col("u").alias("of"), F.least("u", "v_least").alias("least")
    )
    met = both.join(least, F.col("u") == F.col("of"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = met.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select(F.col("of"), F.col("least"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node that has an edge to another.

    A node may have any share of the edges: minima are combined before they move, and AQE splits the
    join's hot partitions. Each round is written to the shared folder, so lineage stays short.
    """
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    flat, before = settled(flat, "edges"), None
    while True:
        flat = settled(_star(_star(flat, large=True), large=False), "edges")
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                flat.select("v", "v").distinct()
            )
        before = now
