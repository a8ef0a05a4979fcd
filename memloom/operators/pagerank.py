"""Conductance and personalized PageRank, for any number of teleport vectors at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from memloom.operators.skew import BROADCAST_ROWS, hot_keys, skew_join, small_side
from memloom.session import discard, materialize, measured, rows_of

#: Up to this many arcs the whole transition matrix fits one task (24 bytes an arc) and a kernel iterates there.
KERNEL_ARCS = 2_000_000
#: Teleport entries a kernel task takes at a time.
KERNEL_CELLS = 20_000_000


def conductance(edges: DataFrame, memberships: DataFrame, ids: DataFrame, priors: dict, default: float, edge_w: float, part_w: float) -> DataFrame:
    """(u, v, c): the symmetric conductance between nodes, the sum of weight times relation prior over all edges and memberships, in both directions.

    A missing relation counts as relates_to, a missing weight as its default; self loops, targets that are no node, and
    terms that are not above 0 are left out.
    """
    prior = F.create_map(*[F.lit(x) for p in priors.items() for x in p])
    of = lambda rel: F.coalesce(F.element_at(prior, rel), F.lit(default))
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), (F.coalesce("w", F.lit(edge_w)) * of(F.coalesce("rel", F.lit("relates_to")))).alias("c"))
    m = memberships.select(F.col("src").alias("u"), F.col("topic").alias("v"), (F.coalesce("w", F.lit(part_w)) * F.lit(priors.get("part_of", default))).alias("c"))
    both = e.unionByName(m).where("u <> v and c > 0")
    for end in ("u", "v"):
        both = skew_join(materialize(both, "terms"), ids.select(F.col("id").alias(end)), [end], "left_semi")
    arcs = both.select(F.explode(F.array(F.struct("u", "v", "c"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "c"))).alias("a")).select("a.*")
    return arcs.groupBy("u", "v").agg(F.sum("c").alias("c"))


def transition(arcs: DataFrame) -> DataFrame:
    """(u, v, p): conductance as a share of what leaves u."""
    arcs = arcs if rows_of(arcs) is not None else materialize(arcs, "conductance")
    out = arcs.groupBy("u").agg(F.sum("c").alias("s"))
    return skew_join(arcs, out, ["u"]).select("u", "v", (F.col("c") / F.col("s")).alias("p"))


def _kernel(damping: float, rounds: int, tolerance: float):
    def run(arcs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        ids = pd.Index(pd.unique(pd.concat([arcs["u"], arcs["v"], start["id"]], ignore_index=True)))
        cases = pd.Index(start["case_id"].unique())
        u, v, w = ids.get_indexer(arcs["u"]), ids.get_indexer(arcs["v"]), arcs["p"].to_numpy()
        order = np.argsort(v, kind="stable")
        u, v, w = u[order], v[order], w[order]
        firsts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.array([], int)
        dead = ~np.isin(np.arange(len(ids)), u)
        frames = []
        for c in cases:
            mine = start[start["case_id"] == c]
            p = np.zeros(len(ids))
            p[ids.get_indexer(mine["id"])] = mine["mass"].to_numpy()
            p /= p.sum()
            pi = p
            for _ in range(rounds):
                new = (1 - damping + damping * pi[dead].sum()) * p
                if len(v):
                    new[v[firsts]] += damping * np.add.reduceat(w * pi[u], firsts)
                moved, pi = np.abs(new - pi).sum(), new
                if moved < tolerance:
                    break
            at = np.flatnonzero(pi > 0)
            frames.append(pd.DataFrame({"case_id": c, "id": ids[at], "mass": pi[at]}))
        return pd.concat(frames) if frames else pd.DataFrame({"case_id": [], "id": [], "mass": []})

    return run


def personalized_pagerank(teleport: DataFrame, steps: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, engine: str = "auto") -> DataFrame:
    """(case_id, id, mass): the mass of each node that a case's teleport reaches; it sums to 1 over a case.

    ``teleport`` (case_id, id, mass) need not be normalised; masses not above 0 are left out and a case without any has no rows.
    ``steps`` is ``transition``'s result. Nodes without a step give their mass back to the teleport. Iteration stops
    after ``rounds``, and for each case as soon as its masses moved by less than ``tolerance`` in a round.

    ``engine``: ``join`` iterates by joins, for graphs of any size and all cases at once; ``kernel``
    iterates in one task per block of cases; ``auto`` takes the kernel while the counted arcs stay within ``KERNEL_ARCS``. Both stop by the same rule.
    """
    start = materialize(teleport.where("mass > 0 and id is not null").groupBy("case_id", "id").agg(F.sum("mass").alias("mass")), "given")
    total = small_side(start.groupBy("case_id").agg(F.sum("mass").alias("total")), "totals")
    start = start.join(total, "case_id").select("case_id", "id", (F.col("mass") / F.col("total")).alias("mass"))
    start = materialize(start, "teleport")
    steps = steps if rows_of(steps) is not None else materialize(steps, "steps")
    if engine == "kernel" or (engine == "auto" and rows_of(steps) <= KERNEL_ARCS):
        blocks = max(1, min(start.select("case_id").distinct().count(), int(rows_of(start) * 8 // KERNEL_CELLS) + start.sparkSession.sparkContext.defaultParallelism))
        part = F.pmod(F.xxhash64("case_id"), F.lit(blocks)).cast("int")
        # Each block of cases gets the arcs, which are few, once.
        taken = [r[0] for r in start.select(part.alias("block")).distinct().collect()]
        spread = steps.withColumn("block", F.explode(F.array(*map(F.lit, taken)).cast("array<int>")))
        kind = dict(start.dtypes)["case_id"]
        return spread.groupBy("block").cogroup(start.withColumn("block", part).groupBy("block")).applyInPandas(_kernel(damping, rounds, tolerance), f"case_id {kind}, id string, mass double")
    hubs = hot_keys(steps, ["u"])
    sources = steps.select(F.col("u").alias("id")).distinct()
    pi, given, settled = start, start, []
    for _ in range(rounds):
        # A hub's rows meet those of all cases: they are salted.
        flow = skew_join(steps, pi.select("case_id", F.col("id").alias("u"), "mass"), ["u"], hot=hubs, keys=0)
        flow = flow.groupBy("case_id", F.col("v").alias("id")).agg((F.sum(F.col("mass") * F.col("p")) * damping).alias("mass"))
        dead = small_side(pi.join(sources, "id", "left_anti").groupBy("case_id").agg(F.sum("mass").alias("dead")), "dead")
        back = given.join(dead, "case_id", "left").select("case_id", "id", (F.col("mass") * ((1 - damping) + damping * F.coalesce("dead", F.lit(0.0)))).alias("mass"))
        before = pi.select("case_id", "id", F.lit(0.0).alias("mass"), F.col("mass").alias("old"))
        new = flow.unionByName(back).withColumn("old", F.lit(0.0)).unionByName(before).groupBy("case_id", "id").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old"))
        new = materialize(new, "pi")
        if pi is not start:
            discard(pi)
        pi = new
        if tolerance > 0:
            moved = new.groupBy("case_id").agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("d")).withColumn("open", F.col("d") >= tolerance)
            moved = materialize(moved, "moved", open=F.count_if("open"))
            still = measured(moved)["open"]
            if still < rows_of(moved):
                mark = F.broadcast(moved) if rows_of(moved) <= BROADCAST_ROWS else moved
                settled.append(materialize(new.join(mark.where("not open").select("case_id"), "case_id", "left_semi"), "settled"))
                going = mark.where("open").select("case_id")
                pi = materialize(new.join(going, "case_id", "left_semi"), "pi")
                given = materialize(given.join(going, "case_id", "left_semi"), "given")
            if not still:
                break
    for part in settled:
        pi = pi.unionByName(part, allowMissingColumns=True)
    return pi.where("mass > 0").select("case_id", "id", "mass")
