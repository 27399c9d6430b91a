"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import maybe_broadcast, written, written_counted

MAX_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``links(a, b)``; equal roots are one component.

    Each round every node moves to the neighbour (or itself) that comes first in a
    scattered order of that round, and links are carried over to the places moved to.
    The order changes per round, so a long chain shrinks by a constant share each time.
    A node with very many links is only ever a partial minimum; its joins have one row per
    node on the other side, which is sent along where its counted rows are few and which adaptive
    execution may split otherwise. Every table is written
    to shared storage; the driver sees row counts only. Self links and repeats are
    harmless; an empty table gives an empty result.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    edges, seen = written_counted(both, "cc-links")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                    .withColumn("root", F.col("node")), "cc-nodes")
    for turn in range(MAX_ROUNDS):
        if not seen["rows"]:
            return nodes
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("o"), F.col(c).alias("n"))
        sides = edges.select(F.col("a").alias("from"), order("b").alias("to")).union(
            edges.select(F.col("b"), order("a")))
        moves, known = written_counted(sides.groupBy("from").agg(F.min("to").alias("to")).select(
            "from", F.least("to", order("from")).getField("n").alias("to")), "cc-moves")
        moves = maybe_broadcast(moves, known["rows"])
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(moves.withColumnRenamed("from", end), end).drop(end).withColumnRenamed("to", end)
        nodes = written(nodes.join(moves.withColumnRenamed("from", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "cc-nodes")
        edges, seen = written_counted(moved.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    raise RuntimeError(f"links remain after {MAX_ROUNDS} rounds")
