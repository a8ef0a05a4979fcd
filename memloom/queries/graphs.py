"""Graph structure: resolution, components, branches, degrees, merges, export and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memloom.functions.text import subtree, token_estimate
from memloom.operators import merging
from memloom.operators.graph import dangling, degrees, isolated, min_labels, reachable, resolved
from memloom.plans import config
from memloom.plans.frames import edges, memberships, vertices
from memloom.queries.retrieval import GRAPH
from memloom.session import table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "nodes")
    return vertices(nodes), edges(nodes), memberships(nodes)


def _structural() -> F.Column:
    return (F.col("origin") == "structural") | (F.col("origin").isNull() & F.coalesce(F.col("rel").isin("imports", "calls"), F.lit(False)))


def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, e, _ = _graph(spark, sf_dir)
    return resolved(e, ids).where("src <> dst").select("src", "rel", "dst", "w", "coact")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links without a target node by kind: imports of something external, other structural ones, semantic ones."""
    nodes, links = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "links").where("target is not null")
    kind = F.when(F.col("rel") == "imports", "external").when(_structural(), "structural").otherwise("semantic")
    return dangling(links, vertices(nodes), "target").groupBy(kind.alias("kind"), "rel").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"))


def edge_merge_max_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links").select(F.col("source").alias("src"), "rel", F.col("target").alias("dst"), "w", "coact")
    return merging.strongest_edges(links)


def edge_merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links").select(F.col("source").alias("src"), "rel", F.col("target").alias("dst"), "w", "coact", "last_used")
    return merging.refreshed_edges(links, "last_used")


def membership_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.strongest_memberships(_graph(spark, sf_dir)[2]).select("src", "topic", F.round("w", 6).alias("w"))


def membership_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.latest_memberships(_graph(spark, sf_dir)[2], "pos").select("src", "topic", F.round("w", 6).alias("w"))


def inbound_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed duplicates merged: links to the greater id of a pair go to the smallest id it is the same as."""
    links = table(spark, sf_dir, "links").select(F.col("source").alias("src"), "rel", F.col("target").alias("dst"), "w", "coact")
    moves = table(spark, sf_dir, "duplicate_pairs").where("verdict = 'same' and a <> b").groupBy(F.greatest("a", "b").alias("old")).agg(F.min(F.least("a", "b")).alias("new"))
    return merging.redirected(links, moves)


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, e, m = _graph(spark, sf_dir)
    return isolated(e, m, ids)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, e, m = _graph(spark, sf_dir)
    return min_labels(e.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(m.select(F.col("src").alias("x"), F.col("topic").alias("y"))), ids)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


def graph_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectivity in one row: components, largest share, isolated nodes, dangling edges, and whether the gate is passed."""
    ids, e, m = _graph(spark, sf_dir)
    sizes = _components(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))
    lost = dangling(e, ids).agg(F.count_if(F.col("rel") == "imports").alias("external"), F.count_if((F.col("rel") != "imports") & _structural()).alias("structural"), F.count_if((F.col("rel") != "imports") & ~_structural()).alias("semantic"))
    alone = isolated(e, m, ids).agg(F.count(F.lit(1)).alias("isolated"))
    share = F.round(F.col("largest") / F.col("nodes"), 6)
    return shape.crossJoin(lost).crossJoin(alone).select("nodes", "components", share.alias("largest_share"), "isolated", "external", "structural", "semantic", ((share >= 0.9) & (F.col("semantic") <= 0)).alias("passed"))


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(table(spark, sf_dir, "nodes"), "type").where(F.col("type").isin(*config.HUB_TYPES)).select("id")


def branch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hub, member): nodes whose memberships lead to the hub over nodes, however far."""
    ids, _, m = _graph(spark, sf_dir)
    down = resolved(m.select("src", F.col("topic").alias("dst")), ids).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hubs = _hubs(spark, sf_dir)
    return reachable(hubs, down).select(F.col("root").alias("hub"), F.col("id").alias("member"))


def branch_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hub, member): nodes reached from the hub over containing edges, stopping at any other hub."""
    ids, e, m = _graph(spark, sf_dir)
    hubs = _hubs(spark, sf_dir)
    # The export has few such edges: memberships of half a node and more count as what their topic contains.
    held = m.where("w >= 0.5").select(F.col("topic").alias("src"), F.col("src").alias("dst")).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    steps = resolved(e.where(F.col("rel").isin(*config.HUB_DOWN_RELS)), ids).select("src", "dst").unionByName(held.select("src", "dst"))
    return reachable(hubs, steps, hubs).select(F.col("root").alias("hub"), F.col("id").alias("member"))


def branch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every hub's branch against its budget."""
    members = branch_up(spark, sf_dir).unionByName(branch_down(spark, sf_dir)).distinct()
    own = vertices(table(spark, sf_dir, "nodes"), "summary", "body", "branch_budget")
    cost = own.select(F.col("id").alias("member"), token_estimate(F.concat_ws("\n", "summary", "body")).alias("cost"))
    sums = members.join(cost, "member").groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("cost").alias("tokens"))
    budget = F.coalesce("branch_budget", F.lit(config.PROFILES["defaults"]["branch_nodes"]))
    return sums.join(own.select(F.col("id").alias("hub"), budget.alias("budget")), "hub").select("hub", "size", "tokens", "budget", ((F.col("size") > F.col("budget")) | (F.col("tokens") > config.PROFILES["defaults"]["branch_tokens"])).alias("over_budget"))


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, e, _ = _graph(spark, sf_dir)
    return degrees(e, ids)


def protected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that compaction leaves alone: rulings, and those of more than 0.7 of the greatest degree."""
    deg = degree_centrality(spark, sf_dir)
    top = deg.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    rows = vertices(table(spark, sf_dir, "nodes"), "type").join(deg, "id").crossJoin(F.broadcast(top))
    return rows.where(F.lower("type").isin(*config.PROFILES["defaults"]["protect"]) | (F.col("degree") / F.col("top") > 0.7)).select("id", "type", "degree")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, e, m = _graph(spark, sf_dir)
    own = resolved(e, ids).where("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target"), "rel", "w", F.coalesce("origin", F.lit("semantic")).alias("origin"))
    part = resolved(m, ids, dst="topic").where("src <> topic").select(F.col("src").alias("source"), F.col("topic").alias("target"), F.lit("part_of").alias("rel"), "w", F.lit("membership").alias("origin"))
    return own.unionByName(part)


def export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def export_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree over edges and memberships, as the exported graph shows it."""
    counts = _links(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return vertices(table(spark, sf_dir, "nodes"), "type").join(counts, "id", "left").select("id", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


def heaviest_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of every node: its heaviest topic, the first of equals, else its bucket, else a question mark."""
    nodes = table(spark, sf_dir, "nodes")
    best = memberships(nodes).groupBy(F.col("src").alias("id")).agg(F.max_by("topic", F.struct(F.coalesce("w", F.lit(0.0)), -F.col("pos"))).alias("topic"))
    return vertices(nodes, "bucket").join(best, "id", "left").select("id", F.coalesce("topic", "bucket", F.lit("?")).alias("domain"))


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nodes by type, status and bucket in one pass."""
    one = vertices(table(spark, sf_dir, "nodes"), "type", "status", "bucket")
    by = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit("—")).alias("value")) for c in ("type", "status", "bucket")]))
    return one.select(by.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("nodes"))


def subtree_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of at least three file-backed nodes, with the first eight ids."""
    own = vertices(table(spark, sf_dir, "nodes"), "source_path", "source_kind").where("source_kind = 'derived_from_file' and source_path is not null").withColumn("subtree", subtree(F.col("source_path"), 2))
    counts = own.groupBy("subtree").agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 3")
    # Cut to the first eight in every task before any directory is gathered.
    first = own.select("subtree", "id").withColumn("r", F.row_number().over(Window.partitionBy("subtree").orderBy("id"))).where("r <= 8")
    sample = first.groupBy("subtree").agg(F.array_join(F.sort_array(F.collect_list("id")), "\n").alias("sample"))
    return counts.join(sample, "subtree").select("subtree", "nodes", "sample")


QUERIES = {
    f.__name__: f
    for f in (
        edge_resolution, dangling_edges, edge_merge_max_sum, edge_merge_keep, membership_renorm, membership_latest, inbound_redirect, isolated_nodes, components, graph_gate, branch_up, branch_down,
        branch_budget, degree_centrality, protected_nodes, export_links, export_degree, heaviest_topic, tallies, subtree_hubs,
    )
}

_G = f"with recursive {GRAPH}"
_RES = "re as (select * from ed where dst in (select id from vx)), rm as (select * from mb where topic in (select id from vx))"
_SCALE = "case when sum(w) over (partition by src) > 1 then round(w / sum(w) over (partition by src), 4) else w end"
_STRUCT = "(coalesce(origin, '') = 'structural' or (origin is null and coalesce(rel in ('imports', 'calls'), false)))"
_COMP = """ln as (select src x, dst y from re union select src, topic from rm), ar as (select x, y from ln union select y, x from ln),
rc as (select id x, id y from vx union select rc.x, ar.y from rc join ar on ar.x = rc.y), cp as (select x id, min(y) component from rc group by x)"""
_ISO = "iso as (select id from vx where id not in (select unnest([src, dst]) from (select src, dst from re union all select src, topic from rm) where src <> dst))"
_HUB = "hb as (select id from vx where type in ('hub', 'overview'))"
_UP = "up as (select h.id hub, rm.src member from hb h join rm on rm.topic = h.id union select up.hub, rm.src from up join rm on rm.topic = up.member)"
_DOWN = """ds as (select src, dst from (select src, dst from re where rel in ('documents', 'defines', 'specifies', 'implements', 'contains') union all select topic, src from rm where w >= 0.5) where dst not in (select id from hb)),
dn as (select h.id hub, ds.dst member from hb h join ds on ds.src = h.id union select dn.hub, ds.dst from dn join ds on ds.src = dn.member)"""
_DEG = "dg as (select id, count(x) degree from vx left join (select unnest([src, dst]) x from re) on x = id group by id)"
_EST = "(case when {0} = '' then 1 when regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g') = {0} then greatest(1, length({0}) // 4) else greatest(1, floor(length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) / 4.0 + (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) - (length({0}) - length(regexp_replace({0}, '[⺀-鿿぀-ヿ가-힯豈-﫿]', '', 'g')))) / 2.2 + (length({0}) - length(regexp_replace({0}, '[⺀-鿿぀-ヿ가-힯豈-﫿]', '', 'g'))) / 1.5)::bigint) end)"
ESTIMATE = _EST

SQL = {
    "edge_resolution": f"{_G}, {_RES} select src, rel, dst, w, coact from re where src <> dst",
    "dangling_edges": f"select case when rel = 'imports' then 'external' when {_STRUCT} then 'structural' else 'semantic' end kind, rel, count(*) links, count(distinct target) targets from links where target is not null and target not in (select id from nodes) group by 1, 2",
    "edge_merge_max_sum": "select source src, rel, target dst, max(coalesce(w, 0)) w, cast(sum(coalesce(coact, 0)) as bigint) coact from links where target <> source group by 1, 2, 3",
    "edge_merge_keep": "select source src, rel, target dst, max(coalesce(w, 0)) w, coalesce(first(coact order by last_used nulls first, coact nulls first), 0) coact from links where target is not null group by 1, 2, 3",
    "membership_renorm": f"{_G}, b as (select src, topic, max(coalesce(w, 0)) w from mb group by 1, 2) select src, topic, round({_SCALE}, 6) w from b",
    "membership_latest": f"{_G}, b as (select src, topic, arg_max(coalesce(w, 0), pos) w from mb group by 1, 2) select src, topic, round({_SCALE}, 6) w from b",
    "inbound_redirect": """with mv as (select greatest(a, b) old, min(least(a, b)) new from duplicate_pairs where verdict = 'same' and a <> b group by 1)
select source src, rel, coalesce(new, target) dst, max(coalesce(w, 0)) w, cast(sum(coalesce(coact, 0)) as bigint) coact from links left join mv on old = target where coalesce(new, target) <> source group by 1, 2, 3""",
    "isolated_nodes": f"{_G}, {_RES}, {_ISO} select id from iso",
    "components": f"{_G}, {_RES}, {_COMP} select id, component from cp",
    "graph_gate": f"""{_G}, {_RES}, {_COMP}, {_ISO}, sz as (select component, count(*) n from cp group by 1), dl as (select * from ed where dst not in (select id from vx)),
sh as (select count(*) components, max(n) largest, cast(sum(n) as bigint) nodes from sz), lo as (select count(*) filter (rel = 'imports') external, count(*) filter (rel <> 'imports' and {_STRUCT}) structural, count(*) filter (rel <> 'imports' and not {_STRUCT}) semantic from dl)
select nodes, components, round(largest / nodes, 6) largest_share, (select count(*) from iso) isolated, external, structural, semantic, round(largest / nodes, 6) >= 0.9 and semantic <= 0 passed from sh, lo""",
    "branch_up": f"{_G}, {_RES}, {_HUB}, {_UP} select hub, member from up where hub <> member",
    "branch_down": f"{_G}, {_RES}, {_HUB}, {_DOWN} select hub, member from dn where hub <> member",
    "branch_budget": f"""{_G}, {_RES}, {_HUB}, {_UP}, {_DOWN}, mem as (select hub, member from up where hub <> member union select hub, member from dn where hub <> member),
co as (select id, {_EST.format("concat_ws(chr(10), summary, body)")} cost, branch_budget from vx)
select hub, size, tokens, budget, size > budget or tokens > 60000 over_budget from (select hub, count(*) size, cast(sum(c.cost) as bigint) tokens, any_value(coalesce(h.branch_budget, 150)) budget from mem join co c on c.id = member join co h on h.id = hub group by hub)""",
    "degree_centrality": f"{_G}, {_RES}, {_DEG} select id, degree from dg",
    "protected_nodes": f"{_G}, {_RES}, {_DEG} select id, type, degree from vx join dg using (id) where lower(type) in ('decision', 'adr') or degree / (select greatest(max(degree), 1) from dg) > 0.7",
    "export_links": f"{_G}, {_RES} select src source, dst target, rel, w, coalesce(origin, 'semantic') origin from re where src <> dst union all select src, topic, 'part_of', w, 'membership' from rm where src <> topic",
    "export_degree": f"{_G}, {_RES}, l as (select unnest([src, dst]) x from (select src, dst from re union all select src, topic from rm) where src <> dst) select id, any_value(type) as type, count(x) degree from vx left join l on x = id group by id",
    "heaviest_topic": f"{_G}, b as (select src, arg_max(topic, row(coalesce(w, 0), -pos)) topic from mb group by 1) select id, coalesce(topic, bucket, '?') domain from vx left join b on src = id",
    "tallies": f"{_G} select field, value, count(*) nodes from (select 'type' field, coalesce(type, '—') as value from vx union all select 'status', coalesce(status, '—') from vx union all select 'bucket', coalesce(bucket, '—') from vx) group by 1, 2",
    "subtree_hubs": """with v as (select distinct on (id) * from nodes where id is not null), t as (select id, case when source_path like '%/%' then array_to_string(list_slice(string_split(source_path, '/'), 1, least(2, len(string_split(source_path, '/')) - 1)), '/') else '_root' end subtree from v where source_kind = 'derived_from_file' and source_path is not null),
r as (select *, row_number() over (partition by subtree order by id) r from t) select subtree, count(*) nodes, string_agg(id, chr(10) order by id) filter (r <= 8) sample from r group by 1 having count(*) >= 3""",
}
