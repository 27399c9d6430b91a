"""Partitions from a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..state import maybe_broadcast, written, written_counted
from .ward import GROUP, Tree, steps_column


def top_merges(tree: Tree, count: int) -> DataFrame:
    """The last ``count`` merges of each tree, ``top`` = 1 for the root.

    Spark limits each partition to ``count`` rows per tree before the shuffle, so a
    tree's merges are never gathered.
    """
    last_first = Window.partitionBy(*GROUP).orderBy(
        F.col("height").desc(), F.col("round").desc(), F.col("left").desc())
    return tree.merges.withColumn("top", F.row_number().over(last_first)).where(F.col("top") <= count)


def _unit_rows(tree: Tree) -> DataFrame:
    return tree.units.select("scenario", F.explode(steps_column(tree.alpha_steps)).alias("alpha_step"), "unit")


def _follow(merges, start):
    """Cluster id after replaying an array of merges in order."""
    return F.aggregate(merges, start, lambda cid, m: F.when(cid == m["right"], m["left"]).otherwise(cid))


def _roots(tree: Tree, k_max: int) -> DataFrame:
    """Each unit's cluster at the ``k_max`` cut, with the last merges ``top`` (root last).

    Every vanished id points to the id that took it in, so the pointers form a
    forest; following them in doubling steps takes log2(depth) joins. A unit that
    has reached a root is ``open`` no more and joins no further, so the few roots
    that many units share are no join keys of later steps.
    """
    top = written(top_merges(tree, k_max - 1), "top")
    trees = tree.trees
    lower = tree.merges.join(maybe_broadcast(top.select(*GROUP, "right"), trees * k_max),
                             [*GROUP, "right"], "left_anti").select(
        *GROUP, F.col("right").alias("unit"), F.col("left").alias("to"))
    at = _unit_rows(tree).join(lower, [*GROUP, "unit"], "left").select(
        *GROUP, "unit", F.coalesce("to", "unit").alias("cid"), F.col("to").isNotNull().alias("open"))
    count = {"moved": F.count_if(F.col("cid") != F.col("unit")), "left": F.count_if(F.col("open"))}
    at, seen = written_counted(at, "roots", **count)
    while seen["left"]:
        pointers = at.where(F.col("cid") != F.col("unit")).select(
            *GROUP, F.col("unit").alias("cid"), F.col("cid").alias("to"), F.col("open").alias("further"))
        hop = at.where("open").join(maybe_broadcast(pointers, seen["moved"]), [*GROUP, "cid"], "left").select(
            *GROUP, "unit", F.coalesce("to", "cid").alias("cid"), F.coalesce("further", F.lit(False)).alias("open"))
        at, seen = written_counted(at.where("not open").unionByName(hop), "roots", **count)
    # At most k_max - 1 merges per tree, in the order they happen.
    last = top.groupBy(*GROUP).agg(F.reverse(F.sort_array(F.collect_list(
        F.struct("top", "left", "right")))).alias("top"))
    return at.drop("open").join(maybe_broadcast(last, trees * k_max), GROUP, "left")


def cut_tree(tree: Tree, ks: list[int]) -> DataFrame:
    """labels(scenario, alpha_step, k, unit, cluster) for every requested number of clusters.

    Clusters are numbered in the order of their first unit. A k above the unit
    count has no partition and gives no rows.
    """
    base = _roots(tree, max(ks))
    n = F.create_map(*[F.lit(x) for kv in tree.sizes.items() for x in kv])[F.col("scenario")]
    k = F.explode(F.filter(F.array(*[F.lit(int(v)) for v in ks]), lambda v: v <= n)).alias("k")
    rows = base.select(*GROUP, "unit", "cid", "top", k)
    # A cut at k leaves the last k - 1 merges out; their right ids, and the root, are its clusters.
    done = F.size("top") - F.col("k") + 1
    cid = F.coalesce(_follow(F.slice("top", 1, F.greatest(done, F.lit(0))), F.col("cid")), "cid")
    rows = rows.select(*GROUP, "k", "unit", "top", done.alias("done"), cid.alias("cid"))
    open_ids = F.slice("top", F.greatest("done", F.lit(0)) + 1, F.size("top"))
    before = F.size(F.filter(open_ids, lambda m: m["right"] < F.col("cid")))
    # The root's id is the smallest unit of all, so it always comes first.
    root = F.element_at("top", -1)["left"]
    number = F.when(F.col("top").isNull() | (F.col("cid") == root), 1).otherwise(before + 2)
    return rows.select(*GROUP, "k", "unit", number.cast("int").alias("cluster"))
