"""Problem 7: what changed between full snapshots."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, functions as F

from memloom.session import materialize


def normal_hash(c: Column) -> Column:
    """A hash without regard to case, surrounding blanks and a leading ``sha256:``; null stays null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^sha256:", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def snapshot_changes(states: DataFrame, state: str, key: str, fields: list[str], latest: str | None = None, lowest_is_base: bool = False, base=None) -> DataFrame:
    """(state, key, change, changed_fields) against the preceding delivered state.

    ``states`` holds full states stacked in one table; ``state`` orders them and need not be
    contiguous. A record is the same by ``key``; of several rows for a record in one state the one
    with the greatest ``latest`` (then the greatest fields) counts, so rows repeated or delivered late change nothing. Rows
    with a null key or state are dropped. A null field equals only a null field. ``change`` is added,
    removed or changed; ``changed_fields`` is sorted and empty for added and removed. The lowest
    state has no predecessor: all its records are added, unless it is the base to compare with (``lowest_is_base``). ``base`` names a state
    that is a base only, below all others; where it has no rows the lowest other state is compared with an empty one.

    Every record becomes signed cells, + in its own state's comparison and - in the next one's: one
    presence marker and one (field, value) per field. Cells that cancel leave no trace; what
    is left of the sums tells what happened. The sums combine on the map side and group by key and
    field, so no group grows with the table. The states are listed on the driver, one number for each delivery.
    """
    rows = states.select(F.col(state).alias("_s"), F.col(key).alias("_k"), F.struct(*([F.col(latest).alias("_at")] if latest else []), *fields).alias("_v")).where("_s is not null and _k is not null")
    rows = rows.groupBy("_s", "_k").agg(F.max("_v").alias("_v"))
    rows = materialize(rows, "states")
    order = sorted({r[0] for r in rows.select("_s").distinct().collect()} | ({base} if base is not None else set()))
    following = dict(pairwise(order))
    kind = dict(rows.dtypes)["_s"]
    signed = [F.struct(F.col("_s").alias("t"), F.lit(1).alias("sign"))]
    if following:
        nxt = F.element_at(F.create_map(*[F.lit(x).cast(kind) for pair in following.items() for x in pair]), F.col("_s"))
        signed.append(F.struct(nxt.alias("t"), F.lit(-1).alias("sign")))
    cells = [F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(f).alias("field"), F.col(f"_v.{f}").cast("string").alias("value")) for f in fields]
    cells = rows.select("_k", F.explode(F.array(*signed)).alias("c"), F.array(*cells).alias("cells")).where("c.t is not null")
    if (lowest_is_base or base is not None) and order:
        cells = cells.where(F.col("c.t") != F.lit(order[0]).cast(kind))
    cells = cells.select("_k", "c.t", "c.sign", F.explode("cells").alias("cell"))
    left = cells.groupBy("t", "_k", "cell.field", "cell.value").agg(F.sum("sign").alias("sum")).where("sum <> 0")
    fate = left.groupBy("t", "_k").agg(F.sum(F.when(F.col("field") == "", F.col("sum"))).alias("present"), F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("touched"))
    none = F.array().cast("array<string>")
    return fate.select(
        F.col("t").alias(state), F.col("_k").alias(key),
        F.when(F.col("present") > 0, "added").when(F.col("present") < 0, "removed").otherwise("changed").alias("change"),
        F.when(F.col("present").isNull(), F.col("touched")).otherwise(none).alias("changed_fields"),
    )


def edited_files(unit_snapshots: DataFrame) -> DataFrame:
    """(source_path): the files of which a unit was added, removed or got another hash between the two newest snapshots; spellings of a hash are one. Nothing before a second snapshot."""
    rows = unit_snapshots.where("id is not null and snap_no is not null")
    newest = F.broadcast(rows.select("snap_no").distinct().orderBy(F.desc("snap_no")).limit(2))
    rows = rows.join(newest, "snap_no", "left_semi").select("snap_no", "id", "source_path", normal_hash(F.col("content_sha")).alias("content_sha"), F.col("taken_at").cast("timestamp_ntz").alias("taken_at"))
    changed = snapshot_changes(rows, "snap_no", "id", ["content_sha"], latest="taken_at", lowest_is_base=True).select("id").distinct()
    return rows.join(changed, "id", "left_semi").where("coalesce(source_path, '') <> ''").select("source_path").distinct()


def base_state(unit_snapshots: DataFrame) -> int:
    """The number of the state before the lowest snapshot."""
    return (unit_snapshots.agg(F.min("snap_no")).first()[0] or 0) - 1


def unit_states(nodes: DataFrame, unit_snapshots: DataFrame) -> DataFrame:
    """The snapshots of units, with the file-derived nodes before them as ``base_state``."""
    base = nodes.where("source_kind = 'derived_from_file'").select(
        F.lit(None).cast("int").alias("snap_no"), "id", normal_hash(F.col("source_hash")).alias("content_sha"), "source_path", "policy", F.lit(None).cast("timestamp_ntz").alias("taken_at")
    )
    snaps = unit_snapshots.select("snap_no", "id", normal_hash(F.col("content_sha")).alias("content_sha"), "source_path", "policy", F.col("taken_at").cast("timestamp_ntz").alias("taken_at")).where("snap_no is not null")
    return snaps.unionByName(base.withColumn("snap_no", F.lit(base_state(unit_snapshots))))
