"""Problem 4: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.operators.pointers import resolve_pointers
from memloom.operators.skew import skew_join
from memloom.session import materialize

CHILD_RELS = ("defines", "contains")


def node_parents(nodes: DataFrame) -> DataFrame:
    """(node, parent): each distinct node id with its parent, null where it has none.

    The parent is the topic of the heaviest ``part_of`` entry that names an existing node (the first
    in the array among equals; a null weight is the lightest); failing that, the smallest existing node whose ``edges``
    name it with one of ``CHILD_RELS``. Null ids, null arrays, null topics and names of absent nodes
    count for nothing; repeated rows of a node add their entries and change nothing if they are alike.
    """
    rows = nodes.where(F.col("id").isNotNull())
    ids = materialize(rows.select(F.col("id").alias("node")).distinct(), "ids")
    there = ids.select(F.col("node").alias("parent"))
    up = rows.select(F.col("id").alias("node"), F.posexplode("part_of").alias("pos", "e")).select("node", "pos", F.col("e.topic").alias("parent"), F.col("e.w").alias("w")).where(F.col("parent").isNotNull())
    up = skew_join(up, there, ["parent"], "left_semi")
    weight = F.coalesce("w", F.lit(float("-inf")))
    heaviest = up.groupBy("node").agg(F.max_by("parent", F.struct(weight, -F.col("pos"), "parent")).alias("by_part"))
    down = rows.select(F.col("id").alias("parent"), F.explode("edges").alias("e")).where(F.col("e.rel").isin(*CHILD_RELS)).select(F.col("e.to").alias("node"), "parent").where(F.col("node").isNotNull())
    named = down.groupBy("node").agg(F.min("parent").alias("by_edge"))
    return ids.join(heaviest, "node", "left").join(named, "node", "left").select("node", F.coalesce("by_part", "by_edge").alias("parent"))


def hierarchy(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """(node_id, parent_id, root_id, depth[, path]) of every distinct node.

    Built by pointer doubling. Roots have depth 0 and a null parent. Where going up never ends, root_id is
    the empty string, depth -1 and path null. An empty table gives an empty result.
    """
    links = materialize(node_parents(nodes), "parents")
    found = resolve_pointers(links, "node", "parent", with_path)
    out = found.join(links, "node")
    return out.select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth", *(["path"] if with_path else []))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every node below every node, one row each.

    Unrolled from the paths, so a node with any number of descendants never becomes one row. Nodes in or below a
    cycle have no path and are left out here; ``hierarchy`` names them.
    """
    paths = hierarchy(nodes, with_path=True).where("depth > 0")
    steps = paths.select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return steps.where("pos < depth").select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))
