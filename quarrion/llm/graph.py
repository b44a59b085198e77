"""Connected components over edge tables: alternating large-star and small-star steps.

Every step is a grouped minimum (which combines before it shuffles) and a join that Spark may split where a node has
very many neighbours; no component is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.common import stored

MOST_STEPS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (or its smaller ones and itself) to the least node among it and them."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: the least node reachable.  ``edges`` has bigint columns a and b.

    Loops and repeated edges do no harm, edges with a null end are ignored, no edges give no rows.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = stored(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MOST_STEPS):
        now = stored(_stars(_stars(now, True), False), "edges")
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
