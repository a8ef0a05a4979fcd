"""Problem 6: rebuilding conversations from message rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from memloom.operators.ordering import global_positions
from memloom.operators.pointers import resolve_pointers
from memloom.operators.skew import skew_join
from memloom.session import materialize

ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "system": "system", "developer": "system"}

_SAID = r"(?U)[^\s\x1c-\x1f]"
_BLOCKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))


def speaker(role: Column) -> Column:
    """user, assistant or system, without regard to case, surrounding blanks and a final colon; null if unknown."""
    bare = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s*:?\s*$", ""))
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), bare)


def message_text(content: Column) -> Column:
    """The text of a message: of a JSON list of blocks the blocks' texts joined by line ends, else ``content`` itself.

    A list without any text gives an empty string; null stays null.
    """
    listed = content.rlike(r"(?s)^\s*\[\s*(\{.*\}\s*)?\]\s*$")
    blocks = F.when(listed, F.from_json(content, _BLOCKS))
    return F.when(blocks.isNotNull(), F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")).otherwise(content)


def message_paths(links: DataFrame) -> DataFrame:
    """(leaf, pos, message): the way from the first message to each message without an answer, pos from 1.

    ``links`` (message, parent): one row per message, parent null for a first one. Pointers are resolved by doubling. A message whose way up ends at an absent message or never
    ends is on no path. In a thread where no message has two answers depth is the place on the path, so a thread of any length stays spread over rows;
    only threads that branch carry their paths, each leaf the whole of its own.
    """
    rows = materialize(links.where("message is not null").groupBy("message").agg(F.min("parent").alias("parent")), "links")
    found = materialize(resolve_pointers(rows, "message", "parent").where("state = 'ok'").select("node", "root", "depth"), "found")
    answers = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("answers"))
    forked = materialize(skew_join(found, answers.where("answers > 1").select("node"), ["node"], "left_semi").select("root").distinct(), "forked")
    straight = skew_join(found, forked.withColumn("forks", F.lit(True)), ["root"], "left").where("forks is null")
    ends = straight.groupBy("root").agg(F.max_by("node", "depth").alias("leaf"))
    out = skew_join(straight, ends, ["root"]).select("leaf", (F.col("depth") + 1).cast("bigint").alias("pos"), F.col("node").alias("message"))
    if forked.isEmpty():
        return out
    tree = skew_join(skew_join(found, forked, ["root"], "left_semi").select(F.col("node").alias("message")), rows, ["message"])
    paths = resolve_pointers(tree, "message", "parent", with_path=True).join(answers, "node", "left_anti")
    steps = paths.select(F.col("node").alias("leaf"), F.posexplode("path").alias("at", "message")).select("leaf", (F.col("at") + 1).cast("bigint").alias("pos"), "message")
    return out.unionByName(steps)


def rebuild_conversations(messages: DataFrame, with_content: bool = False, parent: str | None = None) -> DataFrame:
    """(conv_id, pos, message_id[, role, content]) of all messages of the conversations that are whole.

    A message_id counts once: of repeated deliveries the first received. Rows without a message_id or conv_id are dropped.
    Each message points to the one before it: the message its column ``parent`` names, or, if none is given, the one of its conversation with the next lower seq number; where no message of a conversation has
    a seq, they are numbered by sent_at and then message_id. The pointers are resolved by doubling into paths from the first message to the last, and pos is the place on the path. A conversation is left out
    if a message is on no path (its way up ends at a missing message or in a circle), or if it has more than one path; if a seq is null among others or repeated (without ``parent``);
    if a message has no text or no known role; or unless it is system messages at the start
    only (or none), then user and assistant in turn, at least once, ending with assistant. An empty
    table gives an empty result; extra columns are ignored.

    All conversation-wide facts are sums and extremes that combine before the shuffle, and positions
    by time come from a range-partitioned sort over all messages, so one conversation of any length never becomes one task's.
    """
    above = F.col(parent).cast("bigint") if parent else F.lit(None).cast("bigint")
    fields = [F.col("received_at"), F.col("conv_id"), F.col("seq"), F.col("sent_at"), above.alias("above"), speaker(F.col("role")).alias("role"), F.coalesce(message_text(F.col("content")).rlike(_SAID), F.lit(False)).alias("said")]
    rows = messages.where("message_id is not null and conv_id is not null").select("message_id", F.struct(*fields).alias("r"))
    rows = rows.groupBy("message_id").agg(F.min("r").alias("r")).select("message_id", "r.*").drop("received_at")
    rows = materialize(rows, "messages")
    kinds = rows.groupBy("conv_id").agg(F.count("seq").alias("numbered"), F.count(F.lit(1)).alias("all"), F.min(F.col("said") & F.col("role").isNotNull()).alias("good"))
    usable = F.col("good") if parent else F.col("good") & ((F.col("numbered") == 0) | (F.col("numbered") == F.col("all")))
    kinds = materialize(kinds.where(usable).select("conv_id", (F.col("numbered") > 0).alias("by_seq")), "kinds")
    rows = skew_join(rows, kinds, ["conv_id"])
    if parent:
        placed = materialize(rows.select("conv_id", "message_id", "role", F.col("message_id").alias("node"), F.col("above").alias("before")), "placed")
    else:
        by_seq = rows.where("by_seq").select("conv_id", "message_id", "role", F.col("seq").cast("bigint").alias("no"))
        timed = global_positions(rows.where("not by_seq").select("conv_id", "message_id", "role", "sent_at"), [F.col("conv_id"), F.col("sent_at"), F.col("message_id")], "at", "by_time")
        first = timed.groupBy("conv_id").agg(F.min("at").alias("first"))
        timed = skew_join(timed, first, ["conv_id"]).select("conv_id", "message_id", "role", (F.col("at") - F.col("first") + 1).alias("no"))
        before = F.when(F.col("no") != 1, F.struct("conv_id", (F.col("no") - 1).alias("no")))
        placed = materialize(by_seq.unionByName(timed).select("conv_id", "message_id", "role", F.struct("conv_id", "no").alias("node"), before.alias("before")), "placed")
    # Messages of one number are one node with two messages, which shows below as a path that has two messages at one place.
    paths = message_paths(placed.select(F.col("node").alias("message"), F.col("before").alias("parent")))
    on_path = materialize(skew_join(placed, paths.select(F.col("message").alias("node"), "leaf", "pos"), ["node"]).select("conv_id", "message_id", "role", "leaf", "pos"), "paths")
    parity = lambda f, role: f(F.when(F.col("role") == role, F.col("pos") % 2))
    facts = on_path.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("leaf").alias("one"), F.max("leaf").alias("other"), F.max("pos").alias("last"), F.count_if(F.col("role") == "system").alias("k"), F.coalesce(F.max(F.when(F.col("role") == "system", F.col("pos"))), F.lit(0)).alias("last_system"),
        parity(F.min, "user").alias("u0"), parity(F.max, "user").alias("u1"), parity(F.min, "assistant").alias("a0"), parity(F.max, "assistant").alias("a1"),
    )
    whole = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("all"))
    rules = ["one = other", "n = all", "last = n", "last_system = k", "n > k", "(n - k) % 2 = 0", "u0 = u1", "u0 = (k + 1) % 2", "a0 = a1", "a0 = k % 2"]
    kept = facts.join(whole, "conv_id").where(reduce(lambda x, y: x & y, map(F.expr, rules))).select("conv_id")
    out = skew_join(on_path, kept, ["conv_id"], "left_semi").select("conv_id", F.col("pos").cast("int").alias("pos"), "message_id", "role")
    if not with_content:
        return out.drop("role")
    said = messages.select("message_id", F.struct("received_at", message_text(F.col("content")).alias("content")).alias("c")).groupBy("message_id").agg(F.min("c").alias("c"))
    return out.join(said, "message_id").select("conv_id", "pos", "message_id", "role", F.col("c.content").alias("content"))
