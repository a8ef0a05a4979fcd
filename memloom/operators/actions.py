"""What consolidation decides: actions with guards, folded over the graph in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.operators.learning import survivors
from memloom.operators.skew import skew_join
from memloom.session import materialize

ACTIONS = "seq bigint, action string, id string, others array<string>, value string, force boolean"
#: Kinds that compress: they can be switched off, and (but for sub-hubs) never touch a protected node unless forced.
COMPACTION = ("summarize_episodes", "merge", "introduce_subhub", "shorten", "retire")
#: Verdicts that need two nodes of a list, and what they make of these.
VERDICTS = {"dispute": "disputed", "ask_user": "disputed", "keep_both_with_context": None}


def judged(actions: DataFrame, nodes: DataFrame, protected: DataFrame, enabled: bool = True) -> DataFrame:
    """The actions with their targets that are nodes (``there``), and an outcome: applied, skipped_disabled, skipped_protected or skipped_missing.

    ``actions``: ``ACTIONS``. What is guarded is the node of shorten and retire, and the others of merge and summarize_episodes (which they remove). Missing is an action whose node is
    no node, a verdict on fewer than two nodes, a supersession without both.
    """
    one = materialize(actions.where("seq is not null and action is not null").dropDuplicates(["seq"]), "actions")
    targets = one.select("seq", "action", F.posexplode(F.concat(F.array("id"), F.coalesce("others", F.array().cast("array<string>")))).alias("at", "target")).where("target is not null")
    known = skew_join(targets, nodes.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct(), ["target"], "left")
    known = skew_join(known, protected.select(F.col("id").alias("target"), F.lit(True).alias("kept")).distinct(), ["target"], "left")
    guarded = F.when(F.col("action").isin("shorten", "retire"), F.col("at") == 0).when(F.col("action").isin("merge", "summarize_episodes"), F.col("at") > 0).otherwise(False)
    facts = known.groupBy("seq").agg(
        F.coalesce(F.bool_or(F.col("known") & (F.col("at") == 0)), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.col("kept") & guarded), F.lit(False)).alias("barred"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("known") & (F.col("at") > 0), F.struct("at", "target")))), lambda x: x["target"]).alias("there"),
    )
    rows = one.join(facts, "seq", "left")
    force, found = F.coalesce("force", F.lit(False)), F.size("there")
    missing = (
        F.when(F.col("action").isin(*VERDICTS), found < 2).when(F.col("action") == "supersede", ~F.col("own") | (found < 1) | (F.col("id") == F.try_element_at("there", F.lit(1))))
        .when(F.col("action").isin("summarize_episodes", "introduce_subhub"), F.col("id").isNull()).otherwise(~F.col("own"))
    )
    outcome = F.when(F.col("action").isin(*COMPACTION) & ~force & F.lit(not enabled), "skipped_disabled").when(F.col("barred") & ~force, "skipped_protected").when(F.coalesce(missing, F.lit(True)), "skipped_missing").otherwise("applied")
    return materialize(rows.select("seq", "action", "id", F.coalesce("there", F.array().cast("array<string>")).alias("there"), "value", outcome.alias("outcome")), "judged")


def applied(done: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """What the applied actions of ``judged`` leave of ``nodes`` (id, type, status, summary).

    ``state`` (id, type, status, summary, archived, moved_to): every node and every new one; of several actions on a field the last by seq counts. archived is the seq that removed the node (the row is what the
    archive keeps), moved_to the node that stands for it in the end, through all merges. ``edges`` (src, rel, dst): supersedes from winner to loser, contradicts from the first of a dispute to the others.
    ``members`` (id, old_topic, topic): memberships that go to a new sub-hub. ``trail`` (seq, action, ids): the verdicts, for the record.
    """
    ok = done.where("outcome = 'applied'")
    each = ok.select("seq", "action", "id", "value", F.explode("there").alias("target"))
    status = (
        ok.where("action = 'reject'").select("id", "seq", F.lit("rejected").alias("to")).unionByName(ok.where("action = 'promote'").select("id", "seq", F.lit("active").alias("to")))
        .unionByName(each.where("action = 'supersede'").select(F.col("target").alias("id"), "seq", F.lit("superseded").alias("to"))).unionByName(each.where("action in ('dispute', 'ask_user')").select(F.col("target").alias("id"), "seq", F.lit("disputed").alias("to")))
    )
    last = lambda df, name: df.groupBy("id").agg(F.max_by("to", "seq").alias(name))
    kinds = last(ok.where("action = 'promote' and coalesce(value, '') <> ''").select("id", "seq", F.col("value").alias("to")), "new_type")
    said = last(ok.where("action = 'shorten'").select("id", "seq", F.col("value").alias("to")), "new_summary")
    gone = ok.where("action = 'retire'").select("id", "seq").unionByName(each.where("action in ('merge', 'summarize_episodes') and target <> id").select(F.col("target").alias("id"), "seq")).groupBy("id").agg(F.min("seq").alias("archived"))
    moves = each.where("action in ('merge', 'summarize_episodes') and target <> id").select(F.col("id").alias("keep_id"), F.col("target").alias("drop_id"))
    to = survivors(moves, moves.where("false").select(F.col("keep_id").alias("id"))).select(F.col("drop_id").alias("id"), F.col("survivor").alias("moved_to"))
    made = ok.where("action in ('summarize_episodes', 'introduce_subhub')").groupBy("id").agg(F.max_by(F.struct(F.when(F.col("action") == "introduce_subhub", "hub").otherwise("section").alias("type"), F.when(F.col("action") == "summarize_episodes", F.col("value")).alias("summary")), "seq").alias("m"))
    fresh = made.join(nodes.select("id"), "id", "left_anti").select("id", "m.type", F.lit("active").alias("status"), "m.summary")
    state = nodes.select("id", "type", "status", "summary").unionByName(fresh)
    for df in (last(status, "new_status"), kinds, said, gone, to):
        state = state.join(df, "id", "left")
    state = state.select("id", F.coalesce("new_type", "type").alias("type"), F.coalesce("new_status", "status").alias("status"), F.coalesce("new_summary", "summary").alias("summary"), "archived", "moved_to")
    first = ok.where(F.col("action").isin(*VERDICTS)).select(F.element_at("there", 1).alias("src"), F.lit("contradicts").alias("rel"), F.explode(F.slice("there", F.lit(2), F.size("there"))).alias("dst"))
    edges = first.unionByName(each.where("action = 'supersede'").select(F.col("id").alias("src"), F.lit("supersedes").alias("rel"), F.col("target").alias("dst"))).where("src <> dst").distinct()
    members = each.where("action = 'introduce_subhub'").select(F.col("target").alias("id"), F.col("value").alias("old_topic"), F.col("id").alias("topic")).distinct()
    trail = ok.where(F.col("action").isin("supersede", "reject", *VERDICTS)).select("seq", "action", F.concat(F.when(F.col("action").isin("supersede", "reject"), F.array("id")).otherwise(F.array().cast("array<string>")), "there").alias("ids"))
    return {"state": state, "edges": edges, "members": members, "trail": trail}
