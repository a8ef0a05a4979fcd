"""The graph as relations: vertices, edges and memberships of the nested node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def vertices(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per node id with the columns asked for; rows delivered twice count once, null ids not at all."""
    return nodes.where(F.col("id").isNotNull()).select("id", *columns).dropDuplicates(["id"])


def edges(nodes: DataFrame) -> DataFrame:
    """(src, pos, rel, dst, w, coact, last_used, origin): the edges with a target, in the order the node has them. pos counts from 0."""
    one = vertices(nodes, "edges").select(F.col("id").alias("src"), F.posexplode("edges").alias("pos", "e"))
    return one.select("src", "pos", F.col("e.rel").alias("rel"), F.col("e.to").alias("dst"), F.col("e.w").alias("w"), F.col("e.coact").alias("coact"), F.col("e.last_used").alias("last_used"), F.col("e.origin").alias("origin")).where(F.coalesce("dst", F.lit("")) != "")


def memberships(nodes: DataFrame) -> DataFrame:
    """(src, pos, topic, w): the memberships with a topic."""
    one = vertices(nodes, "part_of").select(F.col("id").alias("src"), F.posexplode("part_of").alias("pos", "e"))
    return one.select("src", "pos", F.col("e.topic").alias("topic"), F.col("e.w").alias("w")).where(F.coalesce("topic", F.lit("")) != "")
