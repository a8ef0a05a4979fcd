"""Retrieval: BM25 seeds, conductance, personalized PageRank, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.functions.text import tokens
from memloom.operators.bm25 import bm25, normalised
from memloom.operators.pagerank import personalized_pagerank
from memloom.plans import config
from memloom.plans.frames import vertices
from memloom.plans.retrieve import activations, blended, conflict_nodes, corpus, graph_conductance, graph_steps, inflow, pack, retrieve, with_conflicts
from memloom.session import materialize, table

#: The stated queries of the retrieval operators, one case each.
ASKED = {
    "q1": "consolidation weekly maintenance",
    "q2": "frozen horizon linker shared logging",
    "q3": "Überblick Hauptordner Zwischenspeicher",
    "q4": "ruler ruler quota",
}


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED.items()), "case_id string, query string")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(corpus(table(spark, sf_dir, "nodes")), _asked(spark).select("case_id", tokens(F.col("query")).alias("tokens")))


def _exact(**more) -> dict:
    """All rounds are run, so that the result is defined to the last digit."""
    return config.profile(tolerance=0.0, **more)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best nodes for every evaluation text."""
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("case_id"), tokens(F.col("text")).alias("tokens"))
    scored = bm25(corpus(table(spark, sf_dir, "nodes")), asked).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where("rank <= 10").select("case_id", "rank", "id", "score")


def bm25_seed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(_seeds(spark, sf_dir)).select("case_id", "id", F.round("score", 9).alias("share"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second seed: the share of the query's letters-of-three that a node's summary has."""
    three = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))
    own = vertices(table(spark, sf_dir, "nodes"), "summary").where("length(summary) > 3").select("id", three(F.lower("summary")).alias("g"))
    asked = _asked(spark).select("case_id", F.explode(three(F.lower("query"))).alias("x"))
    hit = own.select("id", F.explode("g").alias("x")).join(F.broadcast(asked), "x").groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return hit.where("n >= 4").select("case_id", "id", F.col("n").cast("double").alias("score"))


def blend_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended(_seeds(spark, sf_dir), _semantic(spark, sf_dir), 0.5).select("case_id", "id", F.round("score", 9).alias("seed"))


def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_conductance(table(spark, sf_dir, "nodes")).select("u", "v", F.round("c", 9).alias("c"))


def out_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_conductance(table(spark, sf_dir, "nodes")).groupBy("u").agg(F.round(F.sum("c"), 6).alias("strength"), F.count(F.lit(1)).alias("neighbours"))


def _masses(spark: SparkSession, sf_dir: str, engine: str = "auto") -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    return personalized_pagerank(_seeds(spark, sf_dir).withColumnRenamed("score", "mass"), graph_steps(nodes), tolerance=0.0, engine=engine)


def ppr_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masses(spark, sf_dir).where("mass >= 5e-9").select("case_id", "id", F.round("mass", 8).alias("mass"))


def ppr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join engine, which graphs beyond one task's memory take."""
    return _masses(spark, sf_dir, "join").where("mass >= 5e-9").select("case_id", "id", F.round("mass", 8).alias("mass"))


def ppr_early_stop(spark: SparkSession, sf_dir: str, engine: str = "auto") -> DataFrame:
    """Each case stops by itself, as soon as a round moves less than a hundredth of its mass."""
    found = personalized_pagerank(_seeds(spark, sf_dir).withColumnRenamed("score", "mass"), graph_steps(table(spark, sf_dir, "nodes")), tolerance=0.01, engine=engine)
    return found.where("mass >= 5e-9").select("case_id", "id", F.round("mass", 8).alias("mass"))


def ppr_early_stop_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppr_early_stop(spark, sf_dir, "join")


def ppr_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppr_batched(spark, sf_dir).where("case_id = 'q2'").select("id", "mass")


def ppr_status_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations(_masses(spark, sf_dir), table(spark, sf_dir, "nodes")).where("activation >= 1e-4").select("case_id", "id", F.round("activation", 6).alias("activation"))


def _pack(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    found = retrieve(table(spark, sf_dir, "nodes"), _asked(spark), _exact(), **how)["pack"]
    return found.select("case_id", "tier", "ord", "id", F.round("activation", 6).alias("activation"), "cost")


def retrieve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir)


def retrieve_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, compact=True)


def retrieve_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, intent="conflict")


def stale_in_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First touch: the nodes of each pack that still wait for their summary."""
    stale = vertices(table(spark, sf_dir, "nodes"), "status").where("status = 'stale'").select("id")
    return _pack(spark, sf_dir).join(stale, "id", "left_semi").select("case_id", "tier", "ord", "id")


def conflict_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_nodes(table(spark, sf_dir, "nodes"))


def conflict_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    found = with_conflicts(_seeds(spark, sf_dir).withColumnRenamed("score", "mass"), conflict_nodes(nodes))
    return found.groupBy("case_id", "id").agg(F.round(F.sum("mass"), 6).alias("mass"))


def explain_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest sources of each of a case's five strongest nodes."""
    nodes = table(spark, sf_dir, "nodes")
    masses = materialize(_masses(spark, sf_dir), "masses")
    top = masses.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("mass", 12)), "id"))).where("r <= 5").select("case_id", "id")
    return inflow(masses, graph_steps(nodes), top, 0.85).select("case_id", "id", "rank", "source", "mass", "share")


def top_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return _seeds(spark, sf_dir).withColumn("rank", rank).where("rank <= 8").select("case_id", "rank", "id")


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_seed_norm, blend_seed, conductance, out_strength, ppr_batched, ppr_join, ppr_early_stop, ppr_early_stop_join, ppr_single, ppr_status_prior, retrieve_pack, retrieve_compact, retrieve_conflict, stale_in_pack, conflict_seeds, conflict_teleport, explain_inflow, top_seeds)
}

_CASES = ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items())
_PRIORS = ", ".join(f"('{k}', {v})" for k, v in config.RELATION_PRIORS.items())
_W = r"'[\p{L}\p{N}_]+'"

GRAPH = f"""
vx as (select distinct on (id) * from nodes where id is not null),
ex as (select id src, unnest(edges) e, generate_subscripts(edges, 1) - 1 pos from vx),
ed as (select src, pos, e.rel rel, e.to dst, e.w w, e.coact coact, e.last_used last_used, e.origin origin from ex where coalesce(e.to, '') <> ''),
px as (select id src, unnest(part_of) e, generate_subscripts(part_of, 1) - 1 pos from vx),
mb as (select src, pos, e.topic topic, e.w w from px where coalesce(e.topic, '') <> ''),
pri as (select * from (values {_PRIORS}) t(rel, beta)),
tm as (select src u, dst v, coalesce(w, 0.5) * coalesce(beta, 0.5) c from ed left join pri on pri.rel = coalesce(ed.rel, 'relates_to') union all select src, topic, coalesce(w, 0.7) * 0.7 from mb),
okc as (select * from tm where u <> v and c > 0 and v in (select id from vx)),
cd as (select u, v, sum(c) c from (select u, v, c from okc union all select v, u, c from okc) group by u, v),
st as (select u, v, c / sum(c) over (partition by u) p from cd)"""

SEEDS = f"""
tx as (select id, list_transform(regexp_extract_all(concat_ws(' ', regexp_replace(regexp_replace(regexp_replace(id, '^[^:]*:', ''), '::|/|_', ' ', 'g'), ' +', ' ', 'g'), coalesce(summary, ''),
  coalesce(array_to_string(list_transform(part_of, lambda p: coalesce(p.topic, '')), ' '), ''), coalesce(array_to_string(list_filter(tags, lambda x: x is not null), ' '), ''), substr(coalesce(body, ''), 1, 600)), {_W}), lambda x: lower(x)) ws from vx),
tt as (select id, len(ws) n, unnest(ws) term from tx),
tf as (select id, n, term, count(*) tf from tt group by all),
df as (select term, ln(1 + ((select count(*) from vx) - count(*) + 0.5) / (count(*) + 0.5)) idf from tf group by term),
av as (select avg(len(ws)) a from tx)"""

_ASK = f"""qs as (select case_id, unnest(list_transform(regexp_extract_all(q, {_W}), lambda x: lower(x))) term from (values {_CASES}) t(case_id, q))"""
_SCORE = "sc as (select case_id, tf.id id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))) score from qs join tf using (term) join df using (term) cross join av group by 1, 2)"
BASE = f"with recursive {GRAPH},{SEEDS},{_ASK},{_SCORE}"


def _ppr(start: str) -> str:
    return f""",
z as (select case_id, id, m / sum(m) over (partition by case_id) m from ({start})),
dead as (select id from vx where id not in (select u from st)),
it(r, case_id, id, mass) as (select 0, case_id, id, m from z union all
  select r + 1, case_id, v, sum(x) from (
    select it.r, it.case_id, t.v, it.mass * t.w x from it join (
      select z.case_id, vx.id u, z.id v, (0.15 + case when dead.id is null then 0 else 0.85 end) * z.m w from z, vx left join dead on dead.id = vx.id
      union all select c.case_id, u, v, 0.85 * p from st, (select distinct case_id from z) c) t on t.case_id = it.case_id and t.u = it.id
    where r < 30) group by r, case_id, v),
pi as (select case_id, id, mass from it where r = 30)"""


_START = "select case_id, id, score m from sc"
_CONFLICT = """select id from vx where status in ('superseded', 'disputed', 'rejected') or verification.status = 'contradicted'
union select unnest([src, dst]) from ed where rel in ('contradicts', 'supersedes') and dst in (select id from vx)"""
_WITH = f"select case_id, id, sum(m) m from (select case_id, id, score m from sc union all select case_id, c.id, s / (select count(*) from ({_CONFLICT})) from (select case_id, sum(score) s from sc group by 1), ({_CONFLICT}) c) group by 1, 2"


def _active(lift: bool = False) -> str:
    prior = "1.0" if lift else "case coalesce(status, 'active') when 'superseded' then 0.2 when 'disputed' then 0.5 when 'rejected' then 0.1 else 1.0 end"
    return f""",
ac as (select case_id, id, round(a / max(a) over (partition by case_id), 12) activation from (select case_id, id, mass * {prior} a from pi join vx using (id)))"""


def _packed(compact: bool = False, factor: float = 1.0) -> str:
    pointer = r"""'- `' || case when coalesce(source_path, '') <> '' then source_path || ':' || coalesce(lineno::varchar, 'None') || case when line_end <> lineno and line_end <> 0 and lineno <> 0 then '-' || line_end else '' end else id end
      || '` — ' || string_split(id, '::')[-1] || ' — ' || said || mark"""
    short = f"when tier = 'operational' and type not in ('decision', 'adr') then case when coalesce(source_path, '') <> '' and coalesce(lineno, 0) <> 0 then {pointer} else '- ' || id || ' — ' || said || mark end" if compact else ""
    tiers = " ".join(f"when '{k}' then '{v}'" for k, v in config.TIERS.items())
    rooms = {k: max(1, int(v * factor)) for k, v in config.PROFILES["defaults"]["budget"].items() if k != "periphery"}
    return rf""",
nf as (select *, trim(coalesce(summary, '')) said, trim(coalesce(body, '')) txt, coalesce(case type {tiers} end, 'operational') tier, array_to_string(list_filter([
   case status when 'stale' then '{config.MARKS["stale"]}' when 'disputed' then '{config.MARKS["disputed"]}' when 'rejected' then '{config.MARKS["rejected"]}' end,
   case when verification.status = 'contradicted' then '{config.MARKS["contradicted"]}' when type in ('module', 'class', 'function', 'method', 'file') and coalesce(verification.status, 'unverified') = 'unverified' then '{config.MARKS["unverified"]}' end,
   case when confidence < 0.5 then printf('{config.MARKS["unsure"]}', confidence) end], lambda x: x is not null), '; ') marks from vx),
ln as (select *, case when marks <> '' then '  ⟨' || marks || '⟩' else '' end mark from nf),
rd as (select id, tier, case when tier = 'operational' and type in ('module', 'class', 'function', 'method', 'file') then {pointer} {short}
   when tier = 'operational' or type in ('decision', 'adr') then '### ' || id || mark || chr(10) || said || case when txt <> '' then chr(10) || chr(10) || txt else '' end
   else '- ' || id || ' — ' || said || mark end line from ln),
ct as (select id, tier, length(line) - length(regexp_replace(line, '[^\x00-\x7F]', '', 'g')) nona, length(line) - length(regexp_replace(line, '[⺀-鿿぀-ヿ가-힯豈-﫿]', '', 'g')) cjk, length(line) len from rd),
cs as (select id, tier, greatest(1, case when nona = 0 then len // 4 else floor((len - nona) / 4.0 + (nona - cjk) / 2.2 + cjk / 1.5)::bigint end)::integer cost from ct),
rk as (select case_id, tier, id, activation, cost, row_number() over (partition by case_id, tier order by activation desc, id) rn,
  case tier when 'strategic' then {rooms['strategic']} when 'tactical' then {rooms['tactical']} else {rooms['operational']} end room from ac join cs using (id) where activation >= 0.02),
ff(case_id, tier, rn, id, activation, cost, spent, kept) as (
  select case_id, tier, rn, id, activation, cost, case when cost <= room then cost else 0 end, cost <= room from rk where rn = 1 union all
  select rk.case_id, rk.tier, rk.rn, rk.id, rk.activation, rk.cost, ff.spent + case when ff.spent + rk.cost <= rk.room then rk.cost else 0 end, ff.spent + rk.cost <= rk.room
  from ff join rk on rk.case_id = ff.case_id and rk.tier = ff.tier and rk.rn = ff.rn + 1),
pk as (select case_id, case when kept then tier else 'periphery' end tier, id, activation, cost from ff),
po as (select *, cast(row_number() over (partition by case_id, tier order by activation desc, id) as integer) ord from pk)"""


_OUT = " select case_id, tier, ord, id, round(activation, 6) activation, cost from po where tier <> 'periphery' or ord <= 40"

SQL = {
    "bm25_topk": f"""with {GRAPH},{SEEDS},
qs as (select item_id case_id, unnest(list_transform(regexp_extract_all(text, {_W}), lambda x: lower(x))) term from eval_items), {_SCORE}
select case_id, cast(rank as integer) rank, id, score from (select case_id, id, round(score, 6) score, row_number() over (partition by case_id order by round(score, 6) desc, id) rank from sc) where rank <= 10""",
    "bm25_seed_norm": BASE + " select case_id, id, round(score / sum(score) over (partition by case_id), 9) share from sc where score > 0",
    "blend_seed": BASE
    + """, own as (select id, list_distinct(list_transform(range(1, greatest(length(summary) - 2, 1) + 1), lambda i: substr(lower(summary), i, 3))) g from vx where length(summary) > 3),
gq as (select case_id, unnest(list_distinct(list_transform(range(1, greatest(length(q) - 2, 1) + 1), lambda i: substr(lower(q), i, 3)))) x from (values """
    + _CASES
    + """) t(case_id, q)),
hit as (select case_id, id, count(*) n from (select id, unnest(g) x from own) join gq using (x) group by 1, 2 having count(*) >= 4),
pt as (select case_id, id, 0.5 * score / sum(score) over (partition by case_id) s from sc where score > 0 union all select case_id, id, 0.5 * n / sum(n) over (partition by case_id) from hit)
select case_id, id, round(sum(s), 9) seed from pt group by 1, 2""",
    "conductance": f"with {GRAPH} select u, v, round(c, 9) c from cd",
    "out_strength": f"with {GRAPH} select u, round(sum(c), 6) strength, count(*) neighbours from cd group by u",
    "ppr_batched": BASE + _ppr(_START) + " select case_id, id, round(mass, 8) mass from pi where mass >= 5e-9",
    "ppr_single": BASE + _ppr(_START) + " select id, round(mass, 8) mass from pi where mass >= 5e-9 and case_id = 'q2'",
    "ppr_status_prior": BASE + _ppr(_START) + _active() + " select case_id, id, round(activation, 6) activation from ac where activation >= 1e-4",
    "retrieve_pack": BASE + _ppr(_START) + _active() + _packed() + _OUT,
    "retrieve_compact": BASE + _ppr(_START) + _active() + _packed(True, 0.25) + _OUT,
    "retrieve_conflict": BASE + _ppr(_WITH) + _active(True) + _packed() + _OUT,
    "stale_in_pack": BASE + _ppr(_START) + _active() + _packed() + " select case_id, po.tier tier, ord, id from po join vx using (id) where (po.tier <> 'periphery' or ord <= 40) and status = 'stale'",
    "conflict_seeds": f"with {GRAPH} {_CONFLICT}",
    "conflict_teleport": BASE + f" select case_id, id, round(m, 6) mass from ({_WITH})",
    "explain_inflow": BASE
    + _ppr(_START)
    + """, tp as (select case_id, id, mass from (select *, row_number() over (partition by case_id order by round(mass, 12) desc, id) r from pi) where r <= 5),
fl as (select tp.case_id, tp.id, pi.id source, 0.85 * pi.mass * p given, tp.mass whole from tp join st on st.v = tp.id join pi on pi.case_id = tp.case_id and pi.id = st.u)
select case_id, id, cast(rank as integer) rank, source, round(given, 6) mass, round(given / whole, 3) share from (select *, row_number() over (partition by case_id, id order by given desc, source) rank from fl) where rank <= 3""",
    "top_seeds": BASE + " select case_id, cast(rank as integer) rank, id from (select *, row_number() over (partition by case_id order by round(score, 9) desc, id) rank from sc) where rank <= 8",
}
SQL["ppr_join"] = SQL["ppr_batched"]
SQL["ppr_early_stop"] = SQL["ppr_early_stop_join"] = (
    BASE
    + _ppr(_START)
    + """, mv as (select case_id, r, sum(abs(d)) moved from (select case_id, id, r, sum(m) d from (select case_id, id, r, mass m from it where r > 0 union all select case_id, id, r + 1, -mass from it where r < 30) group by 1, 2, 3) group by 1, 2),
 sp as (select case_id, coalesce(min(r) filter (moved < 0.01), 30) r from mv group by 1) select case_id, id, round(mass, 8) mass from it join sp using (case_id, r) where mass >= 5e-9"""
)
