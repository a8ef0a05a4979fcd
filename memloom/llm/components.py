"""Problem 1: consolidating pairwise matches into groups by low-diameter decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.skew import hot_keys, skew_join
from memloom.session import discard, materialize, measured, rows_of

#: Rate of the exponential shifts: an edge is cut with a probability of about 1 - exp(-BETA) a level.
BETA = 0.4
#: Growth over joins stops after this many steps; whatever is not reached in time stays an edge between clusters, for the next level.
RADIUS = 8
#: A graph of at most this many edges is decomposed in one task (16 bytes an edge), by the same recursion.
LOCAL_EDGES = 2_000_000


def _shift(v: Column, level: int, beta: float) -> Column:
    """An exponential shift that depends on the vertex and the level only, so a repeated task draws it again."""
    uniform = (F.pmod(F.xxhash64(v, F.lit(level), F.lit(20)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(uniform) / F.lit(beta)


def _clusters(edges: DataFrame, level: int, beta: float, radius: int) -> DataFrame:
    """(v, c): each end of ``edges`` with the centre it is assigned to, the u of greatest shift(u) - distance(u, v).

    That is the cluster which reaches v first if u starts to grow shift(u) earlier than others. Offers are
    combined before the shuffle, so a vertex of any degree receives one row from each task. Growth ends when no vertex changes hands, after ``radius`` steps at most.
    """
    arcs = materialize(edges.select(F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("t")), F.struct(F.col("y").alias("s"), F.col("x").alias("t")))).alias("e")).select("e.s", "e.t"), "arcs")
    hubs = hot_keys(arcs, ["s"])
    state = arcs.select(F.col("s").alias("v")).distinct().select("v", F.struct(_shift(F.col("v"), level, beta).alias("score"), F.col("v").alias("c")).alias("best"))
    state = materialize(state, "state")
    for _ in range(radius):
        far = state.where("best.score >= 1").select(F.col("v").alias("s"), F.struct((F.col("best.score") - 1).alias("score"), F.col("best.c").alias("c")).alias("best"))
        offers = skew_join(arcs, far, ["s"], hot=hubs).select(F.col("t").alias("v"), "best", F.lit(None).cast("double").alias("was"))
        own = state.select("v", "best", F.col("best.score").alias("was"))
        # Written at each step: a plan that held the steps before would double with each of them.
        grown = own.unionByName(offers).groupBy("v").agg(F.max("best").alias("best"), F.max("was").alias("was"))
        grown = materialize(grown, "state", moved=F.count_if(F.col("best.score") > F.col("was")))
        discard(state)
        state = grown
        if not measured(grown)["moved"]:
            break
    discard(arcs)
    return state.select("v", F.col("best.c").alias("c"))


def decomposed(x: np.ndarray, y: np.ndarray, beta: float = BETA, seed: int = 20) -> tuple[np.ndarray, list[float]]:
    """For vertices 0 … the number of the cluster that holds each in the end, and the share of edges cut in each level.

    The same recursion over arrays: shifts, growth until no vertex changes hands, contraction to super-vertices, edges between clusters to the next level, assignments composed.
    """
    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    whole, cut, rng = np.arange(n), [], np.random.default_rng(seed)
    while len(x):
        s, t = np.concatenate([x, y]), np.concatenate([y, x])
        score, centre = rng.exponential(1 / beta, n), np.arange(n)
        while True:
            grown = score.copy()
            np.maximum.at(grown, t, score[s] - 1)
            moved = grown > score
            if not moved.any():
                break
            at = moved[t] & (score[s] - 1 == grown[t])
            taken = np.full(n, -1)
            np.maximum.at(taken, t[at], centre[s[at]])
            centre = np.where(moved, taken, centre)
            score = grown
        names, centre = np.unique(centre, return_inverse=True)
        whole, n = centre[whole], len(names)
        x, y = centre[x], centre[y]
        between = x != y
        cut.append(float(between.mean()))
        pair = np.unique(np.minimum(x, y)[between].astype(np.int64) * n + np.maximum(x, y)[between])
        x, y = pair // n, pair % n
    return whole, cut


def _local(edges: pd.DataFrame) -> pd.DataFrame:
    names, codes = np.unique(np.concatenate([edges["x"].to_numpy(), edges["y"].to_numpy()]), return_inverse=True)
    whole, _ = decomposed(codes[: len(edges)], codes[len(edges) :])
    centre = np.zeros(whole.max() + 1, names.dtype)
    centre[whole] = names
    return pd.DataFrame({"v": names, "c": centre[whole]})


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", beta: float = BETA, radius: int = RADIUS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(record_id, group_id): every record that a pair links to another one, with the smallest id of its group.

    Pairs with a null end and pairs of a record with itself link nothing; direction and repetition
    do not matter; other columns are ignored. An empty table gives an empty result. Ids keep their type.

    Low-diameter decomposition: every vertex draws an exponential shift and the clusters grow from
    these staggered starts; each cluster then becomes one vertex, parallel edges are merged, and the
    edges between clusters are decomposed again until none is left. The assignments of the levels
    are composed from the last to the first. A level keeps at most about 1 - exp(-beta) of the edges,
    so the levels grow with the logarithm of the number of edges, not with the length of chains. Each level is made by joins while more than ``local_edges`` counted edges are left; fewer are finished
    by the same recursion within one task.
    Ids are replaced by numbers once, at the start; joins that a hub could unbalance go by ``skew_join``.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    links = materialize(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("x"), hi.alias("y")).distinct(), "links")
    ids = links.select(F.explode(F.array("x", "y")).alias("record_id")).distinct()
    numbers = materialize(ids.withColumn("v", F.monotonically_increasing_id()), "numbers")
    edges = links
    for end in ("x", "y"):
        edges = skew_join(edges, numbers.select(F.col("record_id").alias(end), F.col("v").alias(f"{end}_")), [end]).drop(end).withColumnRenamed(f"{end}_", end)
    edges = materialize(edges, "edges")
    levels: list[DataFrame] = []
    while rows_of(edges):
        if rows_of(edges) <= local_edges:
            levels.append(materialize(edges.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_local, "v long, c long"), "local"))
            break
        levels.append(_clusters(edges, len(levels), beta, radius))
        nxt = edges
        for end in ("x", "y"):
            nxt = skew_join(nxt, levels[-1].select(F.col("v").alias(end), F.col("c").alias(f"{end}_")), [end]).drop(end).withColumnRenamed(f"{end}_", end)
        nxt = nxt.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        nxt = materialize(nxt, "edges")
        discard(edges)
        edges = nxt
    if not levels:
        return numbers.select("record_id", F.col("record_id").alias("group_id"))
    whole = levels[-1]
    for level in reversed(levels[:-1]):
        up = whole.select(F.col("v").alias("c"), F.col("c").alias("up"))
        whole = materialize(skew_join(level, up, ["c"], "left").select("v", F.coalesce("up", "c").alias("c")), "whole")
    named = materialize(whole.join(numbers, "v"), "named")
    least = named.groupBy("c").agg(F.min("record_id").alias("group_id"))
    return skew_join(named, least, ["c"]).select("record_id", "group_id")
