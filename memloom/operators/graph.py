"""Graph operators: components, reachability, degrees, isolated nodes, and graph metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from memloom.operators.skew import hot_keys, skew_join
from memloom.session import discard, materialize, measured, rows_of


#: Up to this many arcs a whole graph fits one task, which then takes all its rounds at once.
KERNEL_ARCS = 2_000_000


def resolved(edges: DataFrame, ids: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges whose target is a node; self loops stay."""
    return skew_join(edges, ids.select(F.col("id").alias(dst)), [dst], "left_semi")


def dangling(edges: DataFrame, ids: DataFrame, dst: str = "dst") -> DataFrame:
    """The edges whose target is no node; a null target is none."""
    named = skew_join(edges, ids.select(F.col("id").alias(dst), F.lit(True).alias("_there")), [dst], "left")
    return named.where("_there is null").drop("_there")


def _least_labels(arcs: pd.DataFrame) -> pd.DataFrame:
    names, codes = np.unique(np.concatenate([arcs["s"].to_numpy(object), arcs["t"].to_numpy(object)]), return_inverse=True)
    s, t = codes[: len(arcs)], codes[len(arcs) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, t, label[s])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return pd.DataFrame({"id": names, "label": names[label]})
        label = new


def min_labels(pairs: DataFrame, ids: DataFrame, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(id, component): each id with the smallest id it is linked to directly or through others; its own where it is alone.

    ``pairs`` (x, y) in any direction; ends that are no id are ignored. Each round every vertex hears the smallest label of its neighbours,
    all that carry a label take the smallest that any of them heard, and each then takes its label's label, so that long chains fold up in about logarithmically many rounds.
    Graphs of at most ``kernel_arcs`` counted arcs take these rounds within one task.
    """
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("t")), F.struct(F.col("y").alias("s"), F.col("x").alias("t")))).alias("e")).select("e.s", "e.t").where("s <> t").distinct()
    for end in ("s", "t"):
        both = materialize(skew_join(both, ids.select(F.col("id").alias(end)), [end], "left_semi"), "arcs")
    if rows_of(both) <= kernel_arcs:
        linked = both.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_least_labels, "id string, label string")
        return ids.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
    hubs = hot_keys(both, ["s"])
    current = materialize(ids.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        heard = skew_join(both, current.select(F.col("id").alias("s"), "label"), ["s"], hot=hubs).select(F.col("t").alias("id"), "label", F.lit(None).cast("string").alias("old"))
        lower = materialize(current.select("id", "label", F.col("label").alias("old")).unionByName(heard).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), "lower")
        # A label is itself a vertex; what it hears reaches all that carry it.
        hooked = lower.groupBy(F.col("old").alias("id")).agg(F.min("label").alias("label")).withColumn("old", F.lit(None).cast("string"))
        taken = materialize(lower.unionByName(hooked).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), "taken")
        at = taken.select("id", F.col("label").alias("at"), "old")
        crowd = hot_keys(at, ["at"]) if rows_of(taken) > 100_000 else None
        jumped = skew_join(at, taken.select(F.col("id").alias("at"), F.col("label").alias("next")), ["at"], hot=crowd).select("id", F.least("at", "next").alias("label"), "old")
        jumped = materialize(jumped, "labels", moved=F.count_if(F.col("label") != F.col("old")))
        for done in (current, lower, taken):
            discard(done)
        current = jumped
        if not measured(jumped)["moved"]:
            return current.select("id", F.col("label").alias("component"))


def _reach(steps: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
    names = pd.Index(pd.unique(pd.concat([steps["src"], steps["dst"], roots["root"]], ignore_index=True)))
    src, dst = names.get_indexer(steps["src"]), names.get_indexer(steps["dst"])
    dst = dst[np.argsort(src, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))])
    out = []
    for root in names.get_indexer(roots["root"]):
        seen = np.zeros(len(names), bool)
        seen[root] = True
        front = np.array([root])
        while len(front):
            size = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            front = np.unique(dst[at])
            front = front[~seen[front]]
            seen[front] = True
        seen[root] = False
        got = np.flatnonzero(seen)
        out.append(pd.DataFrame({"root": names[root], "id": names[got]}))
    return pd.concat(out) if out else pd.DataFrame({"root": pd.Series(dtype=object), "id": pd.Series(dtype=object)})


def reachable(roots: DataFrame, steps: DataFrame, barrier: DataFrame | None = None, kernel_arcs: int = KERNEL_ARCS) -> DataFrame:
    """(root, id): what each of ``roots`` (id) reaches over ``steps`` (src, dst), itself left out; nodes of ``barrier`` (id) are neither entered nor passed.

    Grown from the roots: each round takes one step from what the round before found and keeps what is new, so nothing but the result is ever made, and circles end by themselves. The rounds are
    the greatest distance from a root. Where there are at most ``kernel_arcs`` counted steps, blocks of roots are grown each in a task of its own that has all steps.
    """
    if barrier is not None:
        steps = skew_join(steps, barrier.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), ["dst"], "left").where("_in is null").drop("_in")
    steps = materialize(steps.select("src", "dst").where("src <> dst").distinct(), "steps")
    if rows_of(steps) <= kernel_arcs:
        blocks = steps.sparkSession.sparkContext.defaultParallelism
        block = F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int").alias("block")
        from_ = materialize(roots.select(F.col("id").alias("root")).where("root is not null").distinct().select("root", block), "roots")
        taken = [r[0] for r in from_.select("block").distinct().collect()]
        spread = steps.withColumn("block", F.explode(F.array(*map(F.lit, taken)).cast("array<int>")))
        return spread.groupBy("block").cogroup(from_.groupBy("block")).applyInPandas(_reach, "root string, id string")
    hubs = hot_keys(steps, ["src"])
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("id")).distinct()
    found = [materialize(start, "reached")]
    while rows_of(found[-1]):
        further = skew_join(steps, found[-1].withColumnRenamed("id", "src"), ["src"], hot=hubs, keys=0).select("root", F.col("dst").alias("id")).distinct()
        found.append(materialize(further.join(reduce(DataFrame.unionByName, found), ["root", "id"], "left_anti"), "reached"))
        if len(found) > 16:  # few tables to compare with, however many rounds
            found = [materialize(reduce(DataFrame.unionByName, found[:-1]), "reached"), found[-1]]
    out = reduce(DataFrame.unionByName, found)
    return out.where("root <> id")


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree): how often a node ends a resolved edge; parallel edges and self loops count at each end."""
    ends = resolved(edges, ids).select(F.explode(F.array("src", "dst")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolated(edges: DataFrame, memberships: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with no resolved edge in either direction and no resolved membership; a self loop links nothing."""
    links = resolved(edges.select("src", "dst"), ids).unionByName(resolved(memberships.select("src", F.col("topic").alias("dst")), ids)).where("src <> dst")
    return ids.join(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")
