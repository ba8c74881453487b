"""Connected components by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (node, comp): nodes of a component, and only those, share comp, which is one of them.

    Each step moves every node to the least node among itself and its
    neighbours, and edges with it; what became a loop goes. A star is done in
    one step, a component of n nodes in about log n. Steps are tables in the
    shared folder; nothing but whether edges are left reaches the driver.
    """
    left = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    placed = None
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u").alias("least")), F.struct(F.col("v").alias("node"), F.col("u").alias("least")))).alias("x"))
        moved = materialise(ends.select("x.*").groupBy("node").agg(F.min("least").alias("to")), "moved")
        if placed is None:
            placed = moved.select("node", F.col("to").alias("comp"))
        else:
            step = moved.select(F.col("node").alias("comp"), "to")
            placed = placed.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        a = moved.select(F.col("node").alias("u"), F.col("to").alias("to_u"))
        b = moved.select(F.col("node").alias("v"), F.col("to").alias("to_v"))
        after = left.join(a, "u").join(b, "v").where("to_u <> to_v")
        left = materialise(after.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "edges")
        if left.isEmpty():
            return materialise(placed, "components")
