"""Learning from use: pair counts, outcome-gated weights, salience, and what compaction may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.pointers import resolve_pointers
from memloom.operators.skew import self_pairs
from memloom.plans import config


def usage_pairs(sessions: DataFrame) -> DataFrame:
    """(outcome, a, b): the unordered pairs a < b of items used in one session with an outcome. ``sessions``: (session, outcome, item), nulls dropped."""
    used = sessions.where("session is not null and outcome is not null and item is not null").distinct()
    keyed = used.select(F.struct("session", "outcome").alias("key"), "outcome", "item")
    return self_pairs(keyed, "key", "item").select(F.col("a.outcome").alias("outcome"), F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct()


def pair_counts(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(a, b, n): how often an unordered pair occurs; pairs of one item with itself and null ends are left out."""
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def fold_weights(edges: DataFrame, seen: DataFrame, rewarded: DataFrame, punished: DataFrame, rate: float, decay: float, prune: float, default: float, learn: bool = True) -> DataFrame:
    """The edges with what use taught: (…edge columns, w, coact).

    ``seen`` (a, b, n) adds to coact always. Weights change only if ``learn`` is on and there is an outcome at all: a rewarded pair moves up by ``rate`` of its headroom,
    a punished one down by ``rate`` of its weight, in that order if both; a pair seen but neither used up nor down fades by ``decay``. The result is clamped to
    [0, 1], rounded to 4 digits, and edges below ``prune`` are dropped.
    """
    learn = learn and not (rewarded.isEmpty() and punished.isEmpty())
    e = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    e = e.join(seen.select("a", "b", F.col("n").alias("_n")), ["a", "b"], "left")
    e = e.join(rewarded.select("a", "b", F.lit(True).alias("_up")).distinct(), ["a", "b"], "left").join(punished.select("a", "b", F.lit(True).alias("_down")).distinct(), ["a", "b"], "left")
    e = e.withColumn("coact", F.coalesce("coact", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    if learn:
        w = F.coalesce("w", F.lit(default))
        up = F.when(F.col("_up"), w + rate * (1 - w)).otherwise(w)
        down = F.when(F.col("_down"), up - rate * up).otherwise(up)
        faded = F.when(F.col("_n").isNotNull() & F.col("_up").isNull() & F.col("_down").isNull(), down - decay).otherwise(down)
        e = e.withColumn("w", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), faded)), 4)).where(F.col("w") >= prune)
    return e.drop("a", "b", "_n", "_up", "_down")


def salience(now: Column, settings: dict) -> Column:
    """How much a node is worth keeping, from its columns type, updated, coact, degree, top_degree and grounded (rounded to 3 digits)."""
    kind = F.when(F.lower("type").isin(*settings["protect"]), 1.0).otherwise(0.4)
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(F.substring("updated", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))) / 86400.0
    recent = F.coalesce(F.greatest(F.lit(0.0), 1 - age / max(settings["stale_days"] * 4, 1)), F.lit(0.5))
    often = F.least(F.lit(1.0), F.coalesce("coact", F.lit(0)) / 10.0)
    bridge = F.when(F.col("top_degree") > 0, F.col("degree") / F.col("top_degree")).otherwise(0.0)
    ground = F.when(F.col("grounded"), 1.0).otherwise(0.4)
    return F.round(0.30 * kind + 0.20 * recent + 0.20 * often + 0.20 * bridge + 0.10 * ground, 3)


def source_rank(kind: Column, provenance: Column) -> Column:
    """How authoritative a node is when two contradict each other."""
    ranks = F.create_map(*[F.lit(x) for p in config.SOURCE_RANKS.items() for x in p])
    return F.when(F.lower(kind).isin(*config.RULING_TYPES), 4).otherwise(F.coalesce(F.element_at(ranks, F.lower(provenance)), F.lit(2)))


def survivors(merges: DataFrame, protected: DataFrame) -> DataFrame:
    """(drop_id, survivor): what remains of each merged id after all ``merges`` (keep_id, drop_id) in any order.

    Protected ids are never dropped; of several merges of an id the smallest keep_id counts; chains are followed by pointer doubling; ids that merge in a circle survive all.
    """
    one = merges.where("keep_id is not null and drop_id is not null and keep_id <> drop_id").join(protected.select(F.col("id").alias("drop_id")), "drop_id", "left_anti")
    one = one.groupBy(F.col("drop_id").alias("node")).agg(F.min("keep_id").alias("parent"))
    roots = one.select(F.col("parent").alias("node")).distinct().join(one.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"))
    found = resolve_pointers(one.unionByName(roots), "node", "parent")
    return found.where("depth > 0 and state = 'ok'").select(F.col("node").alias("drop_id"), F.col("root").alias("survivor"))


def applied_items(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, outcome, items, summary, confidence) of derivation ``items`` (seq, id, type, summary, content_sha, confidence) against ``nodes`` (id, source_hash, summary, confidence).

    An item whose hash is not the node's is skipped_stale, one for an unknown id creates the node if it has a type and else is skipped_missing; the rest update. Of the
    items that take effect the later ones win field by field where they say something; confidence is clamped to [0, 1] and 0.7 if nothing states it. Null ids are dropped.
    """
    rows = items.where("id is not null").join(nodes.select("id", F.col("source_hash").alias("hash"), F.col("summary").alias("old"), F.col("confidence").alias("sure"), F.lit(True).alias("known")), "id", "left")
    outcome = (
        F.when(F.col("known").isNull(), F.when(F.col("type").isNotNull(), "created").otherwise("skipped_missing"))
        .when(F.col("content_sha").isNotNull() & ~F.col("content_sha").eqNullSafe(F.col("hash")), "skipped_stale")
        .otherwise("updated")
    )
    rows = rows.withColumn("outcome", outcome)
    takes = ~F.col("outcome").startswith("skipped")
    latest = lambda c: F.max_by(F.when(takes, F.col(c)), F.when(takes & F.col(c).isNotNull(), F.struct("seq", c)))
    out = rows.groupBy("id", "outcome").agg(F.count(F.lit(1)).alias("items"), F.coalesce(latest("summary"), F.max("old")).alias("summary"), F.coalesce(latest("confidence"), F.max("sure"), F.lit(0.7)).alias("confidence"))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))


def gate(gold: DataFrame, before: DataFrame, after: DataFrame, least: float) -> DataFrame:
    """(case_id, k, hop_gold, recall_before, recall_after, hop_recall_before, hop_recall_after, lost, recall_delta, hop_recall_delta, status) of packs ``before`` and ``after`` (case_id, id) against ``gold`` (case_id, id, hop).

    ``gold`` and the part of it beyond the reach of words (``hop``) are those of the baseline. ``lost``: gold that was in the pack and no longer is. The deltas are of the means over the
    cases, to 4 digits; a case without hop gold has no part in the second. ``status`` is rejected if a delta is below ``least``, else ok, and is the same for all cases.
    """
    rows = gold.join(before.select("case_id", "id", F.lit(True).alias("b")).distinct(), ["case_id", "id"], "left").join(after.select("case_id", "id", F.lit(True).alias("a")).distinct(), ["case_id", "id"], "left")
    share = lambda c, of: F.count_if(F.col(c) & of) / F.nullif(F.count_if(of), F.lit(0))
    every, hop = F.lit(True), F.col("hop")
    cases = rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("k"), F.count_if("hop").alias("hop_gold"), share("b", every).alias("recall_before"), share("a", every).alias("recall_after"), share("b", hop).alias("hop_recall_before"), share("a", hop).alias("hop_recall_after"),
        F.array_sort(F.collect_list(F.when(F.col("b") & F.col("a").isNull(), F.col("id")))).alias("lost"),
    )
    change = lambda c: F.round(F.avg(f"{c}_after") - F.avg(f"{c}_before"), 4).alias(f"{c}_delta")
    total = cases.agg(change("recall"), change("hop_recall")).withColumn("status", F.when((F.col("recall_delta") < least) | F.coalesce(F.col("hop_recall_delta") < least, F.lit(False)), "rejected").otherwise("ok"))
    return cases.crossJoin(F.broadcast(total))
