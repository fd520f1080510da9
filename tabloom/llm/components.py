"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import write_table

ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """A label per node of ``edges`` (columns a, b, both long): columns node, label.

    Nodes share a label exactly if a path joins them. Each round every node moves
    to the neighbour (or itself) that comes first in an order drawn for the
    round, and edges move with their ends, so the graph shrinks by a constant
    share whatever its shape. Each round's tables are written, which cuts the
    lineage and lets a join split the rows of a node with very many neighbours.
    Loops and repeated edges change nothing; no edges, no rows.
    """
    left = write_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moved: DataFrame | None = None
    for turn in range(ROUNDS):
        if left.isEmpty():
            break
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), F.col("b")).alias("h"), F.col("b").alias("n")))
        steps = both.groupBy("a").agg(first.alias("f"))
        own = F.struct(F.xxhash64(F.lit(turn), F.col("a")).alias("h"), F.col("a").alias("n"))
        steps = write_table(steps.select(F.col("a").alias("node"), F.least(own, F.col("f"))["n"].alias("to")), "steps")
        if moved is None:
            moved = steps.withColumnRenamed("to", "label")
        else:
            moved = write_table(
                moved.join(steps, F.col("label") == steps["node"], "left").select(moved["node"], F.coalesce("to", "label").alias("label")),
                "labels",
            )
        ends_a, ends_b = (steps.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        onward = left.join(ends_a, "a").join(ends_b, "b").where("to_a <> to_b")
        left = write_table(onward.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components not found in {ROUNDS} rounds")
    if moved is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return moved
