"""Problems 4 and 7: hierarchies of the graph and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.operators.hierarchy import descendants, hierarchy
from memloom.operators.snapshots import base_state, snapshot_changes, unit_states
from memloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "nodes")).where("parent_id is not null").select("node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path from the root, joined by line ends; null where there is no root."""
    found = hierarchy(table(spark, sf_dir, "nodes"), with_path=True)
    return found.select("node_id", "root_id", "depth", F.array_join("path", "\n").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(table(spark, sf_dir, "nodes"))


def _changes(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    snaps = table(spark, sf_dir, "unit_snapshots")
    return snapshot_changes(unit_states(table(spark, sf_dir, "nodes"), snaps), "snap_no", "id", fields, "taken_at", base=base_state(snaps))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, ["content_sha"]).select("snap_no", "id", "change")


def p7_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every field a snapshot states: a unit also changes by its path or policy."""
    found = _changes(spark, sf_dir, ["content_sha", "source_path", "policy"])
    return found.select("snap_no", "id", "change", F.array_join("changed_fields", ",").alias("fields"))


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p7_found, p7_fields)}

_PARENTS = """
with recursive ids as (select distinct id from nodes where id is not null),
up as (select id, e.topic t, e.w w, pos from (select id, unnest(part_of) e, generate_subscripts(part_of, 1) pos from nodes) where e.topic in (from ids)),
best as (select id, arg_max(t, row(coalesce(w, '-infinity'::double), -pos)) p from up group by id),
down as (select e.to id, min(id) p from (select id, unnest(edges) e from nodes) where e.rel in ('defines', 'contains') group by 1),
par as (select ids.id, coalesce(best.p, down.p) p from ids left join best using (id) left join down using (id)),
walk as (select id, p cur, 1 depth, [p] path from par where p is not null
  union all select w.id, par.p, depth + 1, list_prepend(par.p, path) from walk w join par on par.id = w.cur where par.p is not null and depth < 2000 and not list_contains(path, par.p)),
ended as (select w.id, w.cur root, w.depth, w.path from walk w join par on par.id = w.cur where par.p is null)"""

_STATES = """
with raw as (select snap_no, id, regexp_replace(trim(lower(content_sha)), '^sha256:', '') h, source_path f, policy g, taken_at from unit_snapshots),
one as (select snap_no, id, max(row(taken_at, h, f, g)) v from raw group by 1, 2),
low as (select min(snap_no) - 1 n from unit_snapshots),
base as (select id, max(row(regexp_replace(trim(lower(source_hash)), '^sha256:', ''), source_path, policy)) v from nodes where source_kind = 'derived_from_file' and id is not null group by 1),
st as (select snap_no, id, v[2] h, v[3] f, v[4] g from one union all select n, id, v[1], v[2], v[3] from base, low),
nums as (select snap_no, lag(snap_no) over (order by snap_no) prev from (select distinct snap_no from st)),
cur as (select n.snap_no, s.id, s.h, s.f, s.g from st s join nums n using (snap_no) where prev is not null),
bef as (select n.snap_no, s.id, s.h, s.f, s.g from st s join nums n on n.prev = s.snap_no),
j as (select coalesce(c.snap_no, b.snap_no) snap_no, coalesce(c.id, b.id) id, b.id is null added, c.id is null removed,
  c.h is distinct from b.h dh, c.f is distinct from b.f df, c.g is distinct from b.g dg from cur c full join bef b on c.snap_no = b.snap_no and c.id = b.id)"""

SQL = {
    "p4_found": _PARENTS + " select par.id node_id, coalesce(root, '') root_id, cast(coalesce(depth, -1) as integer) depth from par left join ended using (id) where p is not null",
    "p4_paths": _PARENTS
    + """ select par.id node_id, case when p is null then par.id else coalesce(root, '') end root_id, cast(case when p is null then 0 else coalesce(depth, -1) end as integer) depth,
  case when p is null then par.id when root is not null then array_to_string(list_append(path, par.id), chr(10)) end path from par left join ended using (id)""",
    "p4_descendants": _PARENTS + " select ancestor_id, id node_id, cast(depth - pos + 1 as integer) distance from (select id, depth, unnest(path) ancestor_id, generate_subscripts(path, 1) pos from ended)",
    "p7_found": _STATES + " select snap_no, id, case when added then 'added' when removed then 'removed' else 'changed' end change from j where added or removed or dh",
    "p7_fields": _STATES
    + """ select snap_no, id, case when added then 'added' when removed then 'removed' else 'changed' end change,
  case when added or removed then '' else concat_ws(',', case when dh then 'content_sha' end, case when dg then 'policy' end, case when df then 'source_path' end) end fields
  from j where added or removed or dh or df or dg""",
}
