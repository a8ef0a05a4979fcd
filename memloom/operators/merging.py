"""Merging of edges and memberships: each variant keeps what its caller needs to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from memloom.operators.skew import skew_join


def strongest_edges(edges: DataFrame) -> DataFrame:
    """(src, rel, dst, w, coact): one edge for each (src, rel, dst), the greatest weight and the sum of coact; self edges are dropped, nulls count as 0."""
    return edges.where("dst is not null and dst <> src").groupBy("src", "rel", "dst").agg(F.max(F.coalesce("w", F.lit(0.0))).alias("w"), F.sum(F.coalesce("coact", F.lit(0))).alias("coact"))


def refreshed_edges(edges: DataFrame, order: str) -> DataFrame:
    """(src, rel, dst, w, coact): the greatest weight, but the coact of the first edge in ``order``: what was learned is neither added to nor lost."""
    return edges.where("dst is not null").groupBy("src", "rel", "dst").agg(F.max(F.coalesce("w", F.lit(0.0))).alias("w"), F.coalesce(F.min_by("coact", F.struct(order, "coact")), F.lit(0)).alias("coact"))


def within_simplex(memberships: DataFrame, by: str = "src") -> DataFrame:
    """Weights scaled down to a sum of 1 where a node's exceed it, then rounded to 4 digits; others stay as they are."""
    total = F.sum("w").over(Window.partitionBy(by))
    return memberships.withColumn("w", F.when(total > 1, F.round(F.col("w") / total, 4)).otherwise(F.col("w")))


def strongest_memberships(memberships: DataFrame) -> DataFrame:
    return within_simplex(memberships.groupBy("src", "topic").agg(F.max(F.coalesce("w", F.lit(0.0))).alias("w")))


def latest_memberships(memberships: DataFrame, order: str) -> DataFrame:
    """The last stated weight of each topic wins."""
    return within_simplex(memberships.groupBy("src", "topic").agg(F.max_by(F.coalesce("w", F.lit(0.0)), order).alias("w")))


def redirected(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with targets replaced by ``moves`` (old, new), then merged as ``strongest_edges`` does."""
    to = skew_join(edges, moves.select(F.col("old").alias("dst"), "new"), ["dst"], "left")
    return strongest_edges(to.select("src", "rel", F.coalesce("new", "dst").alias("dst"), "w", "coact"))


def merged_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """The node table after merging ``moves`` (old, new): old nodes go, their edges and memberships come to the new ones, and whatever pointed at them points there.

    ``new`` must be what is left in the end, an id that no row has as ``old``. Nodes that a move touches keep one edge for each (rel, dst), the greatest weight and the sum
    of coact, and none to themselves; surviving nodes keep the strongest membership of each topic, within the simplex. All other nodes stay as they are.
    """
    one = nodes.where("id is not null").dropDuplicates(["id"])
    moves = moves.select("old", "new").distinct()
    to = lambda df, c: df.join(moves.select(F.col("old").alias(c), F.col("new").alias(f"_{c}")), c, "left").withColumn(f"{c}_moved", F.col(f"_{c}").isNotNull()).withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    e = to(to(one.select(F.col("id").alias("src"), F.posexplode("edges").alias("pos", "e")).select("src", "pos", "e", F.col("e.to").alias("dst")), "src"), "dst")
    m = to(to(one.select(F.col("id").alias("src"), F.posexplode("part_of").alias("pos", "p")).select("src", "pos", "p", F.col("p.topic").alias("topic")), "src"), "topic")
    kept = moves.select(F.col("new").alias("id")).distinct()
    touched = kept.unionByName(e.where("dst_moved").select(F.col("src").alias("id"))).unionByName(m.where("topic_moved").select(F.col("src").alias("id"))).distinct()
    stays = F.struct("src_moved", "pos")
    edge = e.where("coalesce(dst, '') not in ('', src)").join(touched.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("src", "e.rel", "dst").agg(
        F.min(stays).alias("at"), F.min_by("e", stays).alias("e"), F.max("e.w").alias("w"), F.sum(F.coalesce("e.coact", F.lit(0))).cast("int").alias("coact"), F.count(F.lit(1)).alias("n")
    )
    same = F.col("n") == 1
    kind = dict(one.dtypes)
    edge = edge.select("src", "at", F.struct("rel", F.col("dst").alias("to"), F.when(same, F.col("w")).otherwise(F.coalesce("w", F.lit(0.0))).alias("w"), F.when(same, F.col("e.coact")).otherwise(F.col("coact")).alias("coact"), "e.last_used", "e.origin").alias("x"))
    edge = edge.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs")).select("id", F.col("xs.x").cast(kind["edges"]).alias("_edges"))
    member = m.where("coalesce(topic, '') <> ''").join(touched.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.select(F.col("id").alias("src"), F.lit(True).alias("kept")), "src", "left")
    combined = strongest_memberships(member.where("kept").select("src", "topic", "p.w"))
    member = member.where("kept is null").select("src", "topic", "p.w").unionByName(combined.select("src", "topic", "w"))
    member = member.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("topic", "w"))).cast(kind["part_of"]).alias("_part_of"))
    rows = one.join(moves.select(F.col("old").alias("id")), "id", "left_anti").join(touched.withColumn("_touched", F.lit(True)), "id", "left").join(edge, "id", "left").join(member, "id", "left")
    new = lambda c: F.when(F.col("_touched"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*[new(c) if c in ("edges", "part_of") else c for c in nodes.columns])
