"""Pointer doubling: from single steps (node, parent) to the root of every node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from memloom.operators.skew import HOT_ROWS, hot_keys, skew_join
from memloom.session import discard, materialize, measured, rows_of


def resolve_pointers(links: DataFrame, node: str = "node", parent: str = "parent", with_path: bool = False) -> DataFrame:
    """Root, depth and state of every node; with ``with_path`` also the nodes from the root down.

    ``links`` has one row per node; other columns are ignored. Returns (node, root, depth, state[,
    path]) with state

    * ``ok``: the way up ends at a node whose parent is null; depth counts the steps to it, 0 at the root;
    * ``orphan``: the way up ends at a parent that is no node; root is that absent parent, depth the steps to it;
    * ``cycle``: the way up never ends; root null, depth -1, path null. A node that is its own parent is a cycle.

    Null nodes are dropped, of repeated nodes one row counts (the smallest parent; a null parent only
    if there is no other). An empty table gives an empty result.

    Each round joins the unresolved pointers with the table of the round before, which doubles the
    distance jumped and joins path segments. Depths leave no gaps, so a round that resolves nothing
    proves that only cycles are left: the rounds are log2 of the greatest depth, plus one or two.
    Many nodes may point at one ancestor, so the joins go by ``skew_join``.
    """
    key = links.select(F.col(node).alias("node"), F.col(parent).alias("ptr")).where(F.col("node").isNotNull()).groupBy("node").agg(F.min("ptr").alias("ptr"))
    base = materialize(key, "ptr")
    at_root = F.col("ptr").isNull()
    start = base.select(
        "node", F.coalesce("ptr", "node").alias("ptr"), F.when(at_root, 0).otherwise(1).alias("hops"), at_root.alias("done"), F.lit("ok").alias("state"),
        *([F.array("node").alias("seg")] if with_path else []),
    )
    known = base.select(F.col("node").alias("ptr"), F.lit(True).alias("there"))
    # A pointer to no node is an orphan's: settled before the first jump.
    start = skew_join(start, known, ["ptr"], "left", hot=hot_keys(base, ["ptr"]))
    lost = F.col("there").isNull()
    start = start.select("node", "ptr", "hops", (F.col("done") | lost).alias("done"), F.when(lost, "orphan").otherwise("ok").alias("state"), *(["seg"] if with_path else []))
    count = lambda df: materialize(df, "ptr", done=F.count_if("done"))
    current, settled = count(start), []
    while True:
        settled.append(current.where("done"))
        if measured(current)["done"] == rows_of(current):
            break
        unresolved = current.where(~F.col("done"))
        open_rows = rows_of(current) - measured(current)["done"]
        jump = reduce(DataFrame.unionByName, [*settled, unresolved])
        jump = jump.select(F.col("node").alias("ptr"), F.col("ptr").alias("to"), F.col("hops").alias("more"), F.col("done").alias("ended"), F.col("state").alias("as"), *([F.col("seg").alias("up")] if with_path else []))
        nxt = skew_join(unresolved.drop("done", "state"), jump, ["ptr"], hot=hot_keys(unresolved, ["ptr"]) if open_rows > HOT_ROWS else None)
        nxt = count(nxt.select("node", F.col("to").alias("ptr"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ended").alias("done"), F.col("as").alias("state"), *([F.concat("up", "seg").alias("seg")] if with_path else [])))
        if not measured(nxt)["done"]:
            discard(nxt)
            break
        current = nxt
    out = reduce(DataFrame.unionByName, settled).select(
        "node", F.col("ptr").alias("root"), F.col("hops").alias("depth"), "state", *([F.col("seg").alias("path")] if with_path else [])
    )
    # What no round resolved is in or below a cycle: it is still open in the last table written.
    left = current.where(~F.col("done"))
    none = F.lit(None)
    return out.unionByName(left.select("node", none.cast(dict(base.dtypes)["node"]).alias("root"), F.lit(-1).alias("depth"), F.lit("cycle").alias("state"), *([none.cast(f"array<{dict(base.dtypes)['node']}>").alias("path")] if with_path else [])))
