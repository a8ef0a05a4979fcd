"""Which of the rows asked about are in their cases' packs, for many cases over one graph: scores, masses and activations of all nodes stay in a task, a case at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.functions.text import search_text, token_estimate, tokens
from memloom.operators.bm25 import B, K1
from memloom.operators.ordering import global_positions
from memloom.operators.skew import BROADCAST_ROWS, skew_join, small_side
from memloom.plans import config
from memloom.plans.frames import vertices
from memloom.plans.retrieve import graph_steps, rendered, retrieve, status_prior, tier_of
from memloom.session import materialize, measured, rows_of

#: Up to this many postings of query terms (5 bytes each for words said up to 255 times), and arcs (24 bytes), a task takes them all; beyond it all cases are retrieved by joins.
TASK_HITS, TASK_ARCS = 80_000_000, 5_000_000
#: Nodes whose cells of a kind go to the tasks in one row.
CHUNK = 16_384
#: Ranked rows of a case that are ordered first; the rest only if these don't settle it.
RANKED = 4_096
TIERS = ("strategic", "tactical", "operational")


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, minlength=n).astype(float, copy=False)  # of no values it makes whole numbers


class Graph:
    """Nodes, postings and arcs as arrays. Nodes lie in the order: core, leaves by their neighbour, those without an arc; ``at`` has the place of a node's number, ``number`` the reverse.

    Arcs lead in both directions, so a node without one has no flow in either, and a leaf, a node of one arc, gets only from its neighbour and gives all back: only the rest, the core, is iterated.
    """

    def __init__(self, parts: dict[str, list], settings: dict):
        (i, size, prior), (c, cost, tier), (u, v, p) = (tuple(map(np.concatenate, zip(*[x[1:] for x in parts.pop(kind)]))) if kind in parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0)) for kind in ("prior", "cost", "arc"))
        n = len(i)
        self.settings, self.n, self.terms = settings, n, {}
        degree = np.bincount(u, minlength=n)
        near = np.full(n, -1)
        near[u] = v
        leaf = (degree == 1) & (degree[near] > 1)
        group = np.where(degree == 0, 2, leaf)
        self.number = np.lexsort((np.arange(n), np.where(leaf, near, 0), group))
        at = np.empty(n, int)
        at[self.number] = np.arange(n)
        self.at, self.core, self.linked = at, int((group == 0).sum()), int((group < 2).sum())
        self.prior, self.cost, self.tier, length = np.empty(n), np.empty(n, int), np.empty(n, int), np.empty(n)
        self.prior[at[i]], length[at[i]], self.cost[at[c]], self.tier[at[c]] = prior, size, cost, tier
        inner = ~leaf[u] & ~leaf[v]
        order = np.argsort(at[v[inner]], kind="stable")
        self.u, self.v, self.p = at[u[inner]][order], at[v[inner]][order], p[inner][order]
        self.parent, self.share = at[near[self.number[self.core : self.linked]]], np.empty(self.linked - self.core)
        down = leaf[v]
        self.share[at[v[down]] - self.core] = p[down]
        self.shares = _sums(self.parent, self.share, self.core)
        self.norm = K1 * (1 - B + B * length / (length.mean() or 1.0)) if n else length
        found: dict[int, list] = {}
        hits = parts.pop("hit", [])
        while hits:
            k, docs, tf, _ = hits.pop()
            found.setdefault(k, []).append((at[docs].astype(np.int32), tf.astype(np.min_scalar_type(tf.max()))))
        for k in list(found):
            docs, tf = map(np.concatenate, zip(*found.pop(k)))
            self.terms[k] = docs, tf, np.log(1 + (max(n, 1) - len(docs) + 0.5) / (len(docs) + 0.5))

    def seeds(self, asked: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for k, t in zip(asked.tolist(), times.tolist()):
            if k in self.terms:
                docs, tf, idf = self.terms[k]
                tf = tf.astype(float)
                out[docs] += t * idf * (K1 + 1) * tf / (tf + self.norm[docs])
        return out

    def masses(self, seeds: np.ndarray) -> np.ndarray:
        """Personalized PageRank after all rounds. Nodes without an arc hold a share of the mass that depends on their share of the seeds alone."""
        d, core, linked = self.settings["damping"], self.core, self.linked
        p = seeds / seeds.sum()
        dead, below = p[linked:].sum(), _sums(self.parent, p[core:linked], core)
        x, before, under, a = p[:core], np.zeros(core), below, 1.0
        for _ in range(self.settings["max_hops"]):
            a = 1 - d + d * dead * a
            new = _sums(self.v, self.p * x[self.u], core)
            new += under
            new *= d
            new += a * p[:core]
            under = a * below + d * self.shares * x
            x, before = new, x
        out = a * p
        out[:core] = x
        out[core:linked] += d * self.share * before[self.parent]
        return out

    def held(self, asked: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> list[int]:
        """Which numbers of ``wanted`` the pack holds: first fit by activation, then id (the order of numbers), down to the last one wanted."""
        seeds = self.seeds(asked, times)
        if not seeds.any():
            return []
        mass = self.masses(seeds)
        raw = mass * self.prior
        peak = raw.max()
        peak = peak if peak > 0 else 1.0
        mine = self.at[wanted]
        worth = np.round(raw[mine] / peak, 12)
        mine = mine[(worth >= self.settings["threshold"]) & (mass[mine] > 0)]
        if not len(mine):
            return []
        least = np.round(raw[mine] / peak, 12).min()
        near = np.flatnonzero((raw >= (least - 1e-11) * peak) & (mass > 0))
        act = np.round(raw[near] / peak, 12)
        near, act = near[act >= least], act[act >= least]
        if len(near) > RANKED:
            first = act >= np.partition(act, len(act) - RANKED)[len(act) - RANKED]
            got, left = self._fold(near[first], act[first], mine)
            if not left:
                return got
        return self._fold(near, act, mine)[0]

    def _fold(self, rows: np.ndarray, act: np.ndarray, mine: np.ndarray) -> tuple[list[int], bool]:
        """What of ``mine`` is held, and whether some of it was not settled by these rows."""
        rows = rows[np.lexsort((self.number[rows], -act))]
        room, passed, most = [self.settings["budget"][t] for t in TIERS], 0, self.settings["budget"]["periphery"]
        left, out = set(mine.tolist()), []
        for k, tier, cost in zip(rows.tolist(), self.tier[rows].tolist(), self.cost[rows].tolist()):
            kept = cost <= room[tier]
            if kept:
                room[tier] -= cost
            else:
                passed += 1
            if k in left:
                left.discard(k)
                if kept or passed <= most:
                    out.append(int(self.number[k]))
            # Room only shrinks: what doesn't fit now never does, and the periphery is full.
            if passed >= most:
                left = {g for g in left if self.cost[g] <= room[self.tier[g]]} if passed == most or kept else left
            if not left:
                break
        return out, bool(left)


def _in_task(settings: dict):
    def run(batches):
        parts: dict[str, list] = {}
        cases: dict[str, dict] = {}
        for b in batches:
            kinds, keys, names, columns = (*(b.column(c).to_pylist() for c in ("kind", "k", "case_id")), [b.column(c) for c in "ijx"])
            for r, kind in enumerate(kinds):
                i, j, x = (np.array(c[r].values) if c[r].is_valid else None for c in columns)
                if kind in ("ask", "want"):
                    cases.setdefault(names[r], {})[kind] = (i, j)
                else:
                    parts.setdefault(kind, []).append((keys[r], i, j, x))
        if not cases:
            return
        graph = Graph(parts, settings)
        for name, case in cases.items():
            if "ask" in case and "want" in case and (got := graph.held(*case["ask"], case["want"][0])):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array(got, pa.int32())], names=["case_id", "i"])

    return run


def held(nodes: DataFrame, queries: DataFrame, wanted: DataFrame, settings: dict) -> DataFrame:
    """(case_id, id): the rows of ``wanted`` that are in the packs that ``retrieve`` makes for ``queries`` (case_id, query).

    Every task gets nodes, arcs and postings as arrays and works off its share of the cases, so nothing is written for each case and node. That takes all rounds, no seed floor and a graph that fits a task; else the packs themselves are made.
    """
    spark = nodes.sparkSession
    general = lambda: wanted.join(retrieve(nodes, queries, settings)["pack"].select("case_id", "id"), ["case_id", "id"], "left_semi")
    if settings["tolerance"] > 0 or settings["seed_floor"] or settings["max_hops"] < 1:
        return general()
    info = vertices(nodes, "type", "status", "summary", "body", "source_path", "lineno", "line_end", "confidence", "verification", "part_of", "tags").withColumn("tier", tier_of(F.col("type")))
    said = tokens(search_text(F.col("id"), F.col("summary"), F.col("part_of"), F.col("tags"), F.col("body")))
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    own = info.select("id", said.alias("tokens"), status_prior().alias("prior"), place.cast("double").alias("tier"), token_estimate(rendered(settings["warn_confidence"], False)).alias("cost"))
    own = global_positions(own, [F.col("id")]).withColumn("i", (F.col("_pos") - 1).cast("int"))
    ids = small_side(own.select("id", "i"), "ids")
    asked = materialize(queries.select("case_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("case_id", "term").agg(F.count(F.lit(1)).cast("int").alias("times")), "asked")
    terms = small_side(global_positions(asked.select("term").distinct(), [F.col("term")]).select("term", F.col("_pos").cast("int").alias("t")), "terms")
    found = own.select("i", F.explode("tokens").alias("term"))
    # Rows shrink to query terms before they are moved; then one shuffle counts them and lays out the postings of a term.
    found = found.join(terms, "term") if rows_of(terms) <= BROADCAST_ROWS else skew_join(found, terms, ["term"], keys=0)
    part = F.floor(F.col("i") / CHUNK).alias("part")
    found = found.select("t", "i", part).repartition("t", "part").groupBy("t", "part", "i").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    cells = lambda i, j, x=None: F.sort_array(F.collect_list(F.struct(F.col(i).alias("i"), j.alias("j"), *([x.alias("x")] if x is not None else []))))
    hits = materialize(found.groupBy("t", "part").agg(cells("i", F.col("tf")).alias("cells"), F.count(F.lit(1)).alias("n")), "hits", cells=F.sum("n"))
    steps = materialize(graph_steps(nodes), "steps")
    if (measured(hits).get("cells") or 0) > TASK_HITS or rows_of(steps) > TASK_ARCS:
        return general()
    for end in "uv":
        steps = skew_join(steps, ids.select(F.col("id").alias(end), F.col("i").alias(f"{end}i")), [end])
    chunked = lambda df, i, j, x: df.groupBy(F.floor(F.col(i) / CHUNK)).agg(cells(i, j, x).alias("cells"))
    packed = lambda df, kind, k=F.lit(0), case=F.lit(None).cast("string"): df.select(F.lit(kind).alias("kind"), k.alias("k"), case.alias("case_id"), F.col("cells.i").alias("i"), F.col("cells.j").alias("j"), (F.col("cells.x") if "x" in df.schema["cells"].dataType.elementType.names else F.lit(None).cast("array<double>")).alias("x"))
    common = packed(hits, "hit", F.col("t")).unionByName(packed(chunked(steps, "ui", F.col("vi"), F.col("p")), "arc"))
    common = common.unionByName(packed(chunked(own.withColumn("len", F.size("tokens")), "i", F.col("len"), F.col("prior")), "prior")).unionByName(packed(chunked(own, "i", F.col("cost"), F.col("tier")), "cost"))
    want = wanted.where("id is not null").distinct().join(ids, "id").groupBy("case_id").agg(cells("i", F.lit(0)).alias("cells"))
    ask = asked.join(terms, "term").groupBy("case_id").agg(cells("t", F.col("times")).alias("cells"))
    tasks = spark.sparkContext.defaultParallelism
    mine = F.pmod(F.xxhash64("case_id"), F.lit(tasks)).cast("int")
    sent = packed(ask, "ask", case=F.col("case_id")).unionByName(packed(want, "want", case=F.col("case_id"))).withColumn("task", mine)
    sent = sent.unionByName(common.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))))
    got = sent.repartitionById(tasks, "task").select("kind", "k", "case_id", "i", "j", "x").mapInArrow(_in_task(settings), "case_id string, i int")
    return materialize(got, "held").join(ids, "i").select("case_id", "id")
