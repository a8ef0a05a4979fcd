"""The flagship plan: BM25 (and vector) seeds, personalized PageRank, and a tiered pack under token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.functions.text import code_pointer, search_text, token_estimate, tokens
from memloom.operators.bm25 import bm25, normalised
from memloom.operators.pagerank import conductance, personalized_pagerank, transition
from memloom.plans import config
from memloom.plans.frames import edges, memberships, vertices
from memloom.operators.ordering import global_positions
from memloom.operators.skew import BROADCAST_ROWS, skew_join, small_side
from memloom.session import materialize, rows_of


def corpus(nodes: DataFrame) -> DataFrame:
    """(id, tokens): the searchable bag of every node."""
    one = vertices(nodes, "summary", "part_of", "tags", "body")
    return one.select("id", tokens(search_text(F.col("id"), F.col("summary"), F.col("part_of"), F.col("tags"), F.col("body"))).alias("tokens"))


def graph_steps(nodes: DataFrame) -> DataFrame:
    """The transition matrix of a snapshot; it depends on no query."""
    return transition(graph_conductance(nodes))


def graph_conductance(nodes: DataFrame) -> DataFrame:
    ids = vertices(nodes)
    return conductance(edges(nodes), memberships(nodes), ids, config.RELATION_PRIORS, config.RELATION_DEFAULT, config.EDGE_WEIGHT, config.MEMBERSHIP_WEIGHT)


def blended(lexical: DataFrame, semantic: DataFrame | None, blend: float) -> DataFrame:
    """(case_id, id, score): both seeds as shares, mixed; the lexical scores themselves where there is no other."""
    if semantic is None:
        return lexical
    parts = normalised(lexical).select("case_id", "id", (F.col("score") * (1 - blend)).alias("score")).unionByName(normalised(semantic).select("case_id", "id", (F.col("score") * blend).alias("score")))
    return parts.groupBy("case_id", "id").agg(F.sum("score").alias("score"))


def conflict_nodes(nodes: DataFrame) -> DataFrame:
    """Ids in a contradiction: retired, contradicted by a check, or at either end of a conflict edge between nodes."""
    one = vertices(nodes, "status", "verification")
    odd = one.where(F.col("status").isin(*config.RETIRED) | (F.col("verification.status") == "contradicted")).select("id")
    at = edges(nodes).where(F.col("rel").isin(*config.CONFLICT_RELS)).join(vertices(nodes).select(F.col("id").alias("dst")), "dst", "left_semi")
    return odd.unionByName(at.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()


def with_conflicts(teleport: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The teleport plus its own sum spread evenly over the conflict nodes (1 where it is empty is the caller's case)."""
    n = conflicts.count()
    if not n:
        return teleport
    extra = teleport.groupBy("case_id").agg((F.sum("mass") / n).alias("mass")).crossJoin(conflicts)
    return teleport.unionByName(extra.select("case_id", "id", "mass"))


def status_prior() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in config.STATUS_PRIORS.items() for x in p]), F.coalesce("status", F.lit("active"))), F.lit(1.0))


def activations(masses: DataFrame, nodes: DataFrame, lift: bool = False) -> DataFrame:
    """(case_id, id, activation): mass times the prior of the node's status, rescaled so that the top of a case is 1. Rounded to 12 digits, so that equal nodes tie."""
    scaled = masses.join(vertices(nodes, "status"), "id").select("case_id", "id", (F.col("mass") * (F.lit(1.0) if lift else status_prior())).alias("a"))
    peak = small_side(scaled.groupBy("case_id").agg(F.max("a").alias("peak")), "peaks")
    return scaled.join(peak, "case_id").select("case_id", "id", F.round(F.col("a") / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0), 12).alias("activation"))


def trust_marks(warn: float) -> Column:
    """What a reader should know before relying on a node; empty if nothing."""
    check, code = F.col("verification.status"), F.col("type").isin(*config.CODE_TYPES)
    marks = F.array_compact(F.array(
        F.when(F.col("status").isin("stale", "disputed", "rejected"), F.element_at(F.create_map(*[F.lit(x) for p in config.MARKS.items() for x in p]), F.col("status"))),
        F.when(check == "contradicted", config.MARKS["contradicted"]).when(code & (check.isNull() | (check == "unverified")), config.MARKS["unverified"]),
        F.when(F.col("confidence") < warn, F.format_string(config.MARKS["unsure"], F.col("confidence"))),
    ))
    return F.when(F.size(marks) > 0, F.concat(F.lit("  ⟨"), F.array_join(marks, "; "), F.lit("⟩"))).otherwise("")


def tier_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in config.TIERS.items() for x in p]), kind), F.lit("operational"))


def rendered(warn: float, compact: bool) -> Column:
    """The line, or for operational texts and rulings the block, that stands for a node in a pack."""
    said, mark = F.trim(F.coalesce("summary", F.lit(""))), trust_marks(warn)
    tail = F.element_at(F.split("id", "::"), -1)
    line = F.concat(F.lit("- "), "id", F.lit(" — "), said, mark)
    pointer = F.concat(F.lit("- `"), F.when(F.coalesce("source_path", F.lit("")) != "", code_pointer(F.col("source_path"), F.col("lineno"), F.col("line_end"))).otherwise(F.col("id")), F.lit("` — "), tail, F.lit(" — "), said, mark)
    body = F.trim(F.coalesce("body", F.lit("")))
    block = F.concat(F.lit("### "), "id", mark, F.lit("\n"), said, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""))
    operational, code, ruling = F.col("tier") == "operational", F.col("type").isin(*config.CODE_TYPES), F.col("type").isin(*config.RULING_TYPES)
    out = F.when(operational & code, pointer)
    if compact:
        out = out.when(operational & ~ruling, F.when((F.coalesce("source_path", F.lit("")) != "") & (F.coalesce("lineno", F.lit(0)) != 0), pointer).otherwise(line))
    return out.when(operational | ruling, block).otherwise(line)


#: Up to this many ranked rows a pack folds them all.
FOLDED = 100_000


def pack(active: DataFrame, nodes: DataFrame, settings: dict, compact: bool = False, folded: int = FOLDED) -> DataFrame:
    """(case_id, tier, ord, id, activation, cost): first fit in the order of activation, then id.

    A node at or above the threshold goes to its tier if its estimated cost still fits the tier's budget, else
    to the periphery; later, smaller ones may still fit. Room only shrinks, so of the nodes of one cost in a tier those kept are the first ones, at most room / cost of them: where there are more rows than ``FOLDED`` only these,
    found by a range-partitioned sort, enter the fold, and a case and tier folds at most room · ln(room) rows, whatever the data.
    """
    budget = dict(settings["budget"])
    if compact:
        budget = {k: v if k == "periphery" else max(1, int(v * settings["compact_ratio"])) for k, v in budget.items()}
    info = vertices(nodes, "type", "status", "summary", "body", "source_path", "lineno", "line_end", "confidence", "verification").withColumn("tier", tier_of(F.col("type")))
    rows = active.where(F.col("activation") >= settings["threshold"]).join(info, "id").withColumn("cost", token_estimate(rendered(settings["warn_confidence"], compact)))
    limit = F.element_at(F.create_map(*[F.lit(x) for t in ("strategic", "tactical", "operational") for x in (t, budget[t])]), F.col("tier"))
    rows = materialize(rows.select("case_id", "tier", "id", "activation", "cost", limit.alias("room")), "ranked")
    fits = rows.where("cost <= room")
    if rows_of(rows) > folded:
        at = global_positions(fits, [F.col("case_id"), F.col("tier"), F.col("cost"), F.desc("activation"), F.col("id")], "_at", "by_cost")
        first = at.groupBy("case_id", "tier", "cost").agg(F.min("_at").alias("_first"))
        fits = skew_join(at, first, ["case_id", "tier", "cost"]).where((F.col("_at") - F.col("_first")) < F.floor(F.col("room") / F.col("cost"))).drop("_at", "_first")
    order = lambda a, b: F.when(a["activation"] > b["activation"], -1).when(a["activation"] < b["activation"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    fits = fits.groupBy("case_id", "tier", "room").agg(F.array_sort(F.collect_list(F.struct("activation", "id", "cost")), order).alias("xs"))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<string>").alias("ids"))
    fold = F.aggregate("xs", start, lambda s, x: F.when(s["spent"] + x["cost"] <= F.col("room"), F.struct((s["spent"] + x["cost"]).alias("spent"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s), lambda s: s["ids"])
    chosen = materialize(fits.select("case_id", F.explode(fold).alias("id"), F.lit(True).alias("kept")), "chosen")
    mark = F.broadcast(chosen) if rows_of(chosen) <= BROADCAST_ROWS else chosen
    placed = rows.join(mark, ["case_id", "id"], "left")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("activation"), "id"))
    kept = placed.where("kept").withColumn("ord", rank("case_id", "tier"))
    # The rest is cut to its first rows in every task before it is shuffled.
    rest = placed.where("kept is null").withColumn("tier", F.lit("periphery")).withColumn("ord", rank("case_id")).where(F.col("ord") <= budget["periphery"])
    return kept.unionByName(rest).select("case_id", "tier", "ord", "id", "activation", "cost")


def pack_text(packed: DataFrame, nodes: DataFrame, settings: dict, compact: bool = False) -> DataFrame:
    """(case_id, text): each case's pack as one markdown text, tier by tier. A pack is bounded by its budget, so one row holds it."""
    info = vertices(nodes, "type", "status", "summary", "body", "source_path", "lineno", "line_end", "confidence", "verification")
    rows = packed.select("case_id", "tier", "ord", "id").join(info, "id")
    link = F.concat(F.lit("- "), "id", F.lit(" — "), F.trim(F.coalesce("summary", F.lit(""))))
    line = F.when(F.col("tier") == "periphery", link).otherwise(rendered(settings["warn_confidence"], compact))
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(config.PACK_TITLES) for x in (k, i)]), F.col("tier"))
    title = F.element_at(F.create_map(*[F.lit(x) for p in config.PACK_TITLES.items() for x in p]), F.col("tier"))
    tiers = rows.groupBy("case_id", place.alias("place"), title.alias("title")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    whole = tiers.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "title", "lines"))), lambda x: F.concat(x["title"], F.lit("\n"), x["lines"])), "\n\n").alias("text"))
    return whole.select("case_id", F.concat(F.lit("# Context pack (compact)\n\n" if compact else "# Context pack\n\n"), "text", F.lit("\n")).alias("text"))


def inflow(masses: DataFrame, steps: DataFrame, top: DataFrame, damping: float, k: int = 3) -> DataFrame:
    """(case_id, id, rank, source, mass, share): the ``k`` nodes that gave most to each node of ``top`` (case_id, id); ties by id."""
    into = steps.join(top.withColumnRenamed("id", "v"), "v").join(masses.select("case_id", F.col("id").alias("u"), F.col("mass").alias("from_mass")), ["case_id", "u"])
    into = into.select("case_id", F.col("v").alias("id"), F.col("u").alias("source"), (F.lit(damping) * F.col("from_mass") * F.col("p")).alias("given"))
    ranked = into.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "id").orderBy(F.desc("given"), "source"))).where(F.col("rank") <= k)
    return ranked.join(masses, ["case_id", "id"]).select("case_id", "id", "rank", "source", F.round("given", 6).alias("mass"), F.round(F.col("given") / F.col("mass"), 3).alias("share"))


def retrieve(nodes: DataFrame, queries: DataFrame, settings: dict | None = None, compact: bool = False, intent: str | None = None, semantic: DataFrame | None = None, engine: str = "auto") -> dict[str, DataFrame]:
    """All stages for a table of queries (case_id, query): seeds, masses, activations and pack.

    A query that matches nothing has no rows anywhere. ``intent``: ``conflict`` also seeds the nodes in contradictions, and
    both it and ``history`` lift the lower prior of retired nodes. ``semantic`` (case_id, id, score) is mixed into the seeds only.
    """
    settings = settings or config.profile()
    asked = queries.select("case_id", tokens(F.col("query")).alias("tokens"))
    seeds = materialize(blended(bm25(corpus(nodes), asked), semantic, settings["blend"]), "seeds")
    teleport = seeds.select("case_id", "id", F.col("score").alias("mass"))
    if settings["seed_floor"]:
        cases = queries.select("case_id").distinct()
        floor = vertices(nodes).crossJoin(small_side(cases, "cases")).select("case_id", "id", F.lit(settings["seed_floor"]).alias("mass"))
        teleport = teleport.unionByName(floor)
    if intent == "conflict":
        teleport = with_conflicts(teleport, conflict_nodes(nodes))
    arcs = materialize(graph_conductance(nodes), "conductance")
    steps = materialize(transition(arcs), "steps")
    masses = materialize(personalized_pagerank(teleport, steps, settings["damping"], settings["max_hops"], settings["tolerance"], engine), "masses")
    active = materialize(activations(masses, nodes, lift=intent is not None), "activations")
    return {"seeds": seeds, "masses": masses, "conductance": arcs, "steps": steps, "activations": active, "pack": pack(active, nodes, settings, compact)}
