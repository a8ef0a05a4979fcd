"""Upkeep and views: audits, gaps, staleness, repairs, search, and the texts that are handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.functions.text import id_tail
from memloom.operators import upkeep
from memloom.operators.actions import applied, judged
from memloom.operators.graph import resolved
from memloom.operators.ordering import global_positions
from memloom.plans import config
from memloom.plans.frames import edges, vertices
from memloom.plans.retrieve import graph_conductance, pack_text, retrieve
from memloom.queries.graphs import export_degree, protected_nodes
from memloom.queries.learning import _DEG, _PROT, _RES, _SAL, digest_top
from memloom.queries.reconciling import queue_refresh
from memloom.queries.retrieval import _START, BASE, GRAPH, _active, _asked, _exact, _packed, _ppr, retrieve_pack
from memloom.session import table


def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each invariant; two rows of the table in a hundred have lost their id, their bucket or a mark of a merge has come into their text."""
    nodes = table(spark, sf_dir, "nodes")
    n = F.length(F.concat_ws("", "id", "summary"))
    odd = nodes.withColumn("summary", F.when(n % 97 == 0, F.concat(F.lit("<<<<<<< ours\n"), "summary")).otherwise(F.col("summary"))).withColumn("bucket", F.when(n % 89 == 0, "lost").otherwise(F.col("bucket"))).withColumn("id", F.when(n % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("id")))
    return upkeep.audit(odd, queue_refresh(spark, sf_dir)).groupBy("anomaly").agg(F.count(F.lit(1)).alias("found"))


def gaps_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that nothing documents, documents of what is gone, and nodes in conflict (pairs judged different)."""
    from memloom.queries.learning import _disputed

    return upkeep.gaps(vertices(table(spark, sf_dir, "nodes"), "status"), _disputed(spark, sf_dir))


def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doc files outside saved sessions, by whether any of their nodes documents something; files of stale nodes only are not counted."""
    nodes = table(spark, sf_dir, "nodes")
    own = vertices(nodes, "source_path", "bucket", "status").where("bucket = 'doc' and coalesce(source_path, '') <> '' and source_path not like 'sessions/%'")
    says = edges(nodes).where("rel = 'documents'").select(F.col("src").alias("id")).distinct().withColumn("says", F.lit(True))
    files = own.join(says, "id", "left").groupBy("source_path").agg(F.bool_or(F.coalesce("status", F.lit("active")) != "stale").alias("counts"), F.coalesce(F.bool_or("says"), F.lit(False)).alias("documents"))
    return files.where("counts").select("source_path", "documents")


def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's list: nodes of some types and statuses with a word in id or summary, in any case, and a link of some weight; hubs first, then by degree."""
    nodes = table(spark, sf_dir, "nodes")
    word = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")).contains("index")
    rows = vertices(nodes, "type", "status", "summary", "bucket").where((word("id") | word("summary")) & F.col("type").isin("note", "hub", "decision", "section", "record", "function") & (F.coalesce("status", F.lit("active")) != "rejected"))
    strong = resolved(edges(nodes).where("coalesce(w, 0.5) >= 0.2"), vertices(nodes)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    strong = strong.unionByName(vertices(nodes, "part_of").where(F.exists("part_of", lambda p: F.coalesce(p["w"], F.lit(0.7)) >= 0.2)).select("id")).distinct()
    rows = rows.join(strong, "id", "left_semi").join(export_degree(spark, sf_dir).select("id", "degree"), "id")
    return rows.select("id", "type", F.col("type").isin(*config.HUB_TYPES).alias("hub"), "degree", F.substring(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), "\n", " ")), 1, 110).alias("summary"))


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that the links of the most frequent target come from, by their ids: a lookup of stated ids in the table."""
    links = table(spark, sf_dir, "links").where("target is not null")
    top = links.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(1)
    asked = links.join(F.broadcast(top.select("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return vertices(table(spark, sf_dir, "nodes"), "type", "status", "source_hash").join(asked, "id", "left_semi")


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded for a node: its summary and its id spelled out, or its id."""
    spelled = F.translate(F.regexp_replace(id_tail(F.col("id")), "::", " "), "/_", "  ")
    said = F.trim(F.concat(F.trim(F.coalesce("summary", F.lit(""))), F.lit(" "), spelled))
    return vertices(table(spark, sf_dir, "nodes"), "summary").select("id", F.coalesce(F.nullif(said, F.lit("")), "id").alias("text"))


def coactivated_in_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that were packed together: what consolidation learns from."""
    return upkeep.coactivated(retrieve_pack(spark, sf_dir), graph_conductance(table(spark, sf_dir, "nodes")))


def pack_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's pack as text."""
    nodes, settings = table(spark, sf_dir, "nodes"), _exact()
    return pack_text(retrieve(nodes, _asked(spark), settings)["pack"], nodes, settings)


def digest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the digest: standing decisions and open questions."""
    own = vertices(table(spark, sf_dir, "nodes"), "type", "summary")
    said = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), F.lit("")), F.lit("(no summary)"))
    rows = digest_top(spark, sf_dir).join(own, "id").select("kind", "rank", F.concat(F.lit("- **"), "type", F.lit("** — "), said, F.lit("  ·  `"), "id", F.lit("`")).alias("line"))
    return rows.select(F.row_number().over(Window.orderBy("kind", "rank")).alias("no"), "line")


def commit_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File nodes by whether their file changed since their commit. Known are the commits of an even first digit; the files that changed since are here those whose path has an even length."""
    nodes = vertices(table(spark, sf_dir, "nodes"), "source_kind", "source_path", "provenance")
    known = nodes.select(F.col("provenance.commit").alias("commit"), F.col("source_path").alias("path")).where("commit is not null").where(F.conv(F.substring("commit", 1, 1), 16, 10).cast("int") % 2 == 0)
    changes = known.where(F.length("path") % 2 == 0).unionByName(known.withColumn("path", F.lit(None).cast("string"))).distinct()
    return upkeep.commit_staleness(nodes, changes)


def fold_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of consolidation by the action log: purchases are folds, errors judged passes, the rest something else."""
    message = F.when(F.col("event_type") == "purchase", "consolidate | weights folded").when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), "consolidate | consolidation applied").otherwise("retrieve | pack")
    return upkeep.fold_state(table(spark, sf_dir, "events").select("ts", message.alias("message")))


def bare_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are a bare symbol: the qualname of every node, and every file's name, as if an edge had named them without their path."""
    ids = vertices(table(spark, sf_dir, "nodes"))
    named = ids.select(F.concat(F.regexp_extract("id", r"^([^:]*:)", 1), F.element_at(F.split(F.regexp_replace("id", r"^[^:]*:", ""), "::|/"), -1)).alias("target")).distinct()
    return upkeep.bare_targets(named.join(ids.select(F.col("id").alias("target")), "target", "left_anti"), ids)


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as a judge might write them, from judged pairs and the states of nodes: all eleven kinds, numbered in the order of their ids."""
    pairs = table(spark, sf_dir, "duplicate_pairs").where("verdict is not null and a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict").distinct()
    n = F.length("a") + F.length("b")
    kinds = F.element_at(F.array(*map(F.lit, ("supersede", "dispute", "keep_both_with_context", "ask_user"))), (n % 4 + 1).cast("int"))
    lists = F.col("verdict") != "same"
    made = pairs.select(
        F.when(~lists, F.when(n % 5 == 0, "summarize_episodes").otherwise("merge")).otherwise(kinds).alias("action"), F.when(~lists & (n % 5 == 0), F.concat(F.lit("note:digest/"), "a")).when(lists & (n % 4 != 0), F.lit(None).cast("string")).otherwise(F.col("a")).alias("id"),
        F.when(lists & (n % 4 != 0), F.array("a", "b")).otherwise(F.array("b")).alias("others"), F.when(~lists & (n % 5 == 0), "digest").alias("value"), (n % 7 == 0).alias("force"),
    )
    nodes = vertices(table(spark, sf_dir, "nodes"), "type", "status", "summary")
    none = F.array().cast("array<string>")
    kind = F.when(F.col("status") == "captured", "promote").when(F.col("status") == "stale", F.when(F.length("id") % 2 == 0, "retire").otherwise("shorten")).when(F.col("status") == "disputed", "reject").when(F.col("type") == "overview", "introduce_subhub")
    single = nodes.withColumn("action", kind).where("action is not null").select(
        "action", F.when(F.col("action") == "introduce_subhub", F.concat(F.lit("hub:sub/"), "id")).otherwise(F.col("id")).alias("id"), F.when(F.col("action") == "introduce_subhub", F.array("id")).otherwise(none).alias("others"),
        F.when(F.col("action") == "promote", "decision").when(F.col("action") == "shorten", F.substring(F.coalesce("summary", F.lit("")), 1, 20)).when(F.col("action") == "introduce_subhub", "top").alias("value"), F.lit(False).alias("force"),
    )
    rows = made.unionByName(single)
    return global_positions(rows, [F.col("action"), F.col("id"), F.col("others"), F.col("value"), F.col("force")], "seq", "actions")


def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many actions of each kind are applied, and what stops the others."""
    done = judged(_actions(spark, sf_dir), vertices(table(spark, sf_dir, "nodes")), protected_nodes(spark, sf_dir))
    return done.groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("actions"))


def applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that the actions change, archive or make."""
    nodes = vertices(table(spark, sf_dir, "nodes"), "type", "status", "summary")
    done = judged(_actions(spark, sf_dir), nodes, protected_nodes(spark, sf_dir))
    state = applied(done, nodes)["state"]
    old = nodes.select("id", F.col("type").alias("t"), F.col("status").alias("s"), F.col("summary").alias("x"), F.lit(True).alias("old"))
    changed = state.join(old, "id", "left").where("old is null or archived is not null or moved_to is not null or not (type <=> t and status <=> s and summary <=> x)")
    return changed.select("id", "type", "status", "summary", F.col("archived").isNotNull().alias("archived"), "moved_to")


def action_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that verdicts leave behind."""
    nodes = vertices(table(spark, sf_dir, "nodes"), "type", "status", "summary")
    return applied(judged(_actions(spark, sf_dir), nodes, protected_nodes(spark, sf_dir)), nodes)["edges"]


QUERIES = {f.__name__: f for f in (audit_buckets, gaps_report, doc_coverage, search_nodes, node_lookup, embedding_text, coactivated_in_pack, pack_markdown, digest_markdown, commit_stale, fold_log, bare_repair, action_outcomes, applied_actions, action_edges)}

_G = f"with recursive {GRAPH}"
_PACKED = BASE + _ppr(_START) + _active() + _packed()
_LINE = _packed().split("rd as (select id, tier, ", 1)[1].split(" line from ln)", 1)[0]

from memloom.queries.learning import _DIS  # noqa: E402
from memloom.queries.reconciling import _QUEUE  # noqa: E402

_ACT = f"""{_G}, {_RES}, {_DEG}, {_PROT}, jp as (select distinct least(a, b) a, greatest(a, b) b, verdict, (length(a) + length(b)) n from duplicate_pairs where verdict is not null and a is not null and b is not null and a <> b),
ac as (select case when verdict = 'same' then case when n % 5 = 0 then 'summarize_episodes' else 'merge' end else ['supersede', 'dispute', 'keep_both_with_context', 'ask_user'][n % 4 + 1] end act,
  case when verdict = 'same' and n % 5 = 0 then 'note:digest/' || a when verdict <> 'same' and n % 4 <> 0 then null else a end id, case when verdict <> 'same' and n % 4 <> 0 then [a, b] else [b] end others, case when verdict = 'same' and n % 5 = 0 then 'digest' end val, n % 7 = 0 forced from jp
 union all select act, case act when 'introduce_subhub' then 'hub:sub/' || id else id end, case act when 'introduce_subhub' then [id] else [] end, case act when 'promote' then 'decision' when 'shorten' then substr(coalesce(summary, ''), 1, 20) when 'introduce_subhub' then 'top' end, false
 from (select id, summary, case when status = 'captured' then 'promote' when status = 'stale' then case when length(id) % 2 = 0 then 'retire' else 'shorten' end when status = 'disputed' then 'reject' when type = 'overview' then 'introduce_subhub' end act from vx) where act is not null),
s0 as (select *, row_number() over (order by act, id nulls first, others, val nulls first, forced) seq from ac), tg as (select seq, unnest(others) t, generate_subscripts(others, 1) k from s0),
tt2 as (select seq, list(t order by k) filter (t in (select id from vx)) th, bool_or(t in (select id from pr)) pb from tg group by 1), sq as (select s0.*, coalesce(th, []) th, coalesce(pb, false) pb from s0 left join tt2 using (seq)),
jd as (select *, case when not forced and (act in ('shorten', 'retire') and id in (from pr) or act in ('merge', 'summarize_episodes') and pb) then 'skipped_protected'
  when case when act in ('dispute', 'ask_user', 'keep_both_with_context') then len(th) < 2 when act = 'supersede' then id not in (select id from vx) or len(th) < 1 when act in ('summarize_episodes', 'introduce_subhub') then false else id not in (select id from vx) end then 'skipped_missing' else 'applied' end outcome from sq),
okk as (select * from jd where outcome = 'applied'), ee as (select seq, act, id, val, unnest(th) target from okk),
ns as (select id, arg_max(s, seq) s from (select id, seq, case act when 'reject' then 'rejected' else 'active' end s from okk where act in ('reject', 'promote') union all select target, seq, case act when 'supersede' then 'superseded' else 'disputed' end from ee where act in ('supersede', 'dispute', 'ask_user')) group by 1),
nt as (select id, arg_max(val, seq) t from okk where act = 'promote' group by 1), nx as (select id, arg_max(val, seq) x from okk where act = 'shorten' group by 1),
gn as (select distinct id from (select id from okk where act = 'retire' union all select target from ee where act in ('merge', 'summarize_episodes') and target <> id)),
mv as (select target drop_id, min(id) keep_id from ee where act in ('merge', 'summarize_episodes') and target <> id group by 1),
wl as (select drop_id, keep_id cur, 1 d from mv union all select wl.drop_id, mv.keep_id, d + 1 from wl join mv on mv.drop_id = wl.cur where d < 1000), sv as (select drop_id, cur from wl where cur not in (select drop_id from mv)),
nw as (select id, case act when 'introduce_subhub' then 'hub' else 'section' end ty, case act when 'summarize_episodes' then val end sm from okk where act in ('summarize_episodes', 'introduce_subhub') and id not in (select id from vx) qualify row_number() over (partition by id order by seq desc) = 1)"""

SQL = {
    "action_outcomes": f"{_ACT} select act as action, outcome, count(*) actions from jd group by 1, 2",
    "applied_actions": f"""{_ACT}, ss as (select id, type, status, summary, true old from vx union all select id, ty, 'active', sm, false from nw)
select ss.id, coalesce(nt.t, type) as type, coalesce(ns.s, status) status, coalesce(nx.x, summary) summary, gn.id is not null archived, sv.cur moved_to from ss left join ns on ns.id = ss.id left join nt on nt.id = ss.id left join nx on nx.id = ss.id left join gn on gn.id = ss.id left join sv on sv.drop_id = ss.id
where not old or gn.id is not null or sv.cur is not null or coalesce(nt.t, type) is distinct from type or coalesce(ns.s, status) is distinct from status or coalesce(nx.x, summary) is distinct from summary""",
    "action_edges": f"{_ACT} select id src, 'supersedes' rel, target dst from ee where act = 'supersede' and id <> target union select th[1], 'contradicts', unnest(th[2:]) from okk where act in ('dispute', 'ask_user', 'keep_both_with_context')",
    "audit_buckets": f"""{_QUEUE}, od as (select * replace (case when length(coalesce(id, '') || coalesce(summary, '')) % 83 = 0 then null else id end as id, case when length(coalesce(id, '') || coalesce(summary, '')) % 89 = 0 then 'lost' else bucket end as bucket,
  case when length(coalesce(id, '') || coalesce(summary, '')) % 97 = 0 then '<<<<<<< ours' || chr(10) || summary else summary end as summary) from nodes), ov as (select distinct on (id) * from od where id is not null),
f as (select 'unparsable' anomaly from od where id is null union all select 'duplicate_ids' from (select id from od where id is not null group by 1 having count(*) > 1)
 union all select 'path_mismatch' from ov where bucket is distinct from case when coalesce(source_kind, '') = 'synthesized' then '_hubs' when split_part(id, ':', 1) in ('code', 'doc', 'data') then split_part(id, ':', 1) else 'notes' end
 union all select 'bad_shape' from ov where len(list_filter(coalesce(edges, []), lambda e: e is null or coalesce(e.to, '') = '' or coalesce(e.rel, '') = '')) > 0
 union all select 'status_inconsistent' from ov where source_kind = 'derived_from_file' and source_hash is not null and (coalesce(status, 'active') = 'active' and derived_from_hash is distinct from source_hash or status = 'stale' and derived_from_hash is not distinct from source_hash)
 union all select 'missing_trust_fields' from ov where source_kind = 'derived_from_file' and (verification is null or provenance is null)
 union all select 'queue_lag' from (select distinct id from qu) q left join ov using (id) where ov.type is null and ov.bucket is null and ov.source_kind is null or coalesce(ov.status, 'active') <> 'stale'
 union all select 'conflict_markers' from ov where regexp_matches(concat_ws(chr(10), summary, body), '(^|\\n)(<<<<<<<|\\|\\|\\|\\|\\|\\|\\||>>>>>>>)( |\\n|$)'))
select anomaly, count(*) found from f group by 1""",
    "gaps_report": f"""{_G}, {_DIS} select 'undocumented' kind, id, null::varchar target from vx where split_part(id, ':', 1) = 'code' and coalesce(status, 'active') <> 'stale' and id not in (select dst from dd where rel = 'documents')
union all select 'drifted', src, dst from dd where rel = 'documents' and split_part(src, ':', 1) = 'doc' and dst not in (select id from vx) union all select 'conflict', src, dst from dd where rel in ('contradicts', 'supersedes') and dst in (select id from vx)""",
    "doc_coverage": f"{_G} select source_path, bool_or(id in (select src from ed where rel = 'documents')) documents from vx where bucket = 'doc' and coalesce(source_path, '') <> '' and source_path not like 'sessions/%' group by 1 having bool_or(coalesce(status, 'active') <> 'stale')",
    "search_nodes": f"""{_G}, {_RES}, rmm as (select * from mb where topic in (select id from vx)), l as (select unnest([src, dst]) x from (select src, dst from re union all select src, topic from rmm) where src <> dst), dg as (select x id, count(*) degree from l group by 1),
sg as (select unnest([src, dst]) id from re where coalesce(w, 0.5) >= 0.2 union select id from vx where len(list_filter(part_of, lambda p: coalesce(p.w, 0.7) >= 0.2)) > 0)
select id, type, type in ('hub', 'overview') hub, coalesce(degree, 0) degree, substr(trim(replace(coalesce(summary, ''), chr(10), ' ')), 1, 110) summary from vx left join dg using (id)
where (contains(lower(id), 'index') or contains(lower(replace(coalesce(summary, ''), chr(10), ' ')), 'index')) and type in ('note', 'hub', 'decision', 'section', 'record', 'function') and coalesce(status, 'active') <> 'rejected' and id in (from sg)""",
    "node_lookup": f"{_G}, t as (select target from links where target is not null group by 1 order by count(*) desc, target limit 1) select id, type, status, source_hash from vx where id in (select source from links where target in (from t))",
    "embedding_text": f"{_G} select id, coalesce(nullif(trim(trim(coalesce(summary, '')) || ' ' || replace(replace(replace(regexp_replace(id, '^[^:]*:', ''), '::', ' '), '/', ' '), '_', ' ')), ''), id) as text from vx",
    "coactivated_in_pack": _PACKED + " , ip as (select case_id, id from po where tier <> 'periphery') select distinct x.case_id, u a, v b from cd join ip x on x.id = u join ip y on y.id = v and y.case_id = x.case_id where u < v",
    "pack_markdown": _PACKED
    + f""", lt as (select id, said, {_LINE} line from ln), pl as (select po.case_id, po.tier t, ord, case when po.tier = 'periphery' then '- ' || po.id || ' — ' || said else lt.line end line from po join lt on lt.id = po.id where po.tier <> 'periphery' or ord <= 40),
pt as (select case_id, case t when 'strategic' then 0 when 'tactical' then 1 when 'operational' then 2 else 3 end k, case t {" ".join(f"when '{k}' then '{v}'" for k, v in config.PACK_TITLES.items())} end || chr(10) || string_agg(line, chr(10) order by ord) x from pl group by case_id, t)
select case_id, '# Context pack' || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) order by k) || chr(10) as text from pt group by 1""",
    "digest_markdown": rf"""{_G}, {_RES}, {_DEG}, {_SAL}, k as (select *, case when type in ('decision', 'adr') then 'decision' when type = 'open_question' then 'question' end kind from va where coalesce(status, 'active') in ('active', 'captured')),
r as (select *, row_number() over (partition by kind order by salience desc, id) rank from k where kind is not null), p as (select * from r where rank <= case kind when 'decision' then 6 else 4 end)
select cast(row_number() over (order by kind, rank) as integer) no, '- **' || type || '** — ' || coalesce(nullif(trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')), ''), '(no summary)') || '  ·  `' || id || '`' line from p""",
    "commit_stale": f"""{_G}, c as (select distinct provenance.commit x from vx where provenance.commit is not null and ascii(substr(provenance.commit, 1, 1)) in (48, 50, 52, 54, 56, 97, 99, 101))
select id, case when coalesce(provenance.commit, '') = '' then 'no_commit' when provenance.commit not in (from c) then 'unresolved' when length(source_path) % 2 = 0 then 'stale' else 'current' end verdict from vx where source_kind = 'derived_from_file' and coalesce(source_path, '') <> ''""",
    "fold_log": """with j as (select max(ts) t from events where event_type = 'error' and event_id % 97 = 0), o as (select ts, event_type from events where event_type = 'purchase' or event_type = 'error' and event_id % 97 = 0)
select (select max(ts) from o) as last, (select t from j) last_judged, (select count(*) from o where event_type = 'purchase' and ((select t from j) is null or ts > (select t from j))) folds""",
    "bare_repair": r"""with v as (select distinct id, split_part(id, ':', 1) c, regexp_replace(id, '^[^:]*:', '') tl from nodes where id is not null), t as (select distinct c, regexp_extract(tl, '([^/:]*)$', 1) nm, c || ':' || list_last(string_split(replace(tl, '::', '/'), '/')) target, list_last(string_split(replace(tl, '::', '/'), '/')) name from v),
q as (select c, regexp_extract(id, '::(.*)$', 1) as name, min(id) id from v where contains(id, '::') group by 1, 2 having count(*) = 1), fl as (select distinct c, list_last(string_split(tl, '/')) as name from v where not contains(id, '::') and contains(tl, '/'))
select target, q.id from t join q on q.c = t.c and q.name = t.name where target not in (select id from v) and not contains(t.name, ':') and t.name <> '' and not exists (select 1 from fl where fl.c = t.c and fl.name = t.name)""",
}
