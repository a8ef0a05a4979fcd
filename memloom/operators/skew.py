"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from memloom.session import discard, materialize, measured, rows_of

#: A key is hot from this many rows on; below it a single task takes it without harm.
HOT_ROWS = 100_000
#: Hot keys up to so many are gathered and their rows of the other side broadcast; if there are more, the hot rows are spread by salt instead.
HOT_KEYS = 1_000
#: A hot key's rows are spread over one salt for every so many of them.
SALT_ROWS = 50_000


def hot_keys(df: DataFrame, on: list[str], rows: int | None = None) -> DataFrame | None:
    """(*on, _n): the keys of more than ``rows`` rows with their counts, written; None if there are none.

    Counted with map-side combining, so a hot key costs one row per map task. A table that was written and has no more than ``rows`` rows has none,
    which takes no job to know.
    """
    rows = HOT_ROWS if rows is None else rows
    known = rows_of(df)
    if known is not None and known <= rows:
        return None
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    counts = df.where(present).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    found = materialize(counts, "hot")
    if rows_of(found):
        return found
    discard(found)
    return None


UNKNOWN = object()
#: A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, label: str = "small", most: int | None = None) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most ``most`` (``BROADCAST_ROWS``) rows; a larger one is left to be shuffled."""
    out = materialize(df, label)
    if rows_of(out) > (BROADCAST_ROWS if most is None else most):
        return out
    marked = F.broadcast(out)
    marked._memloom_path, marked._memloom_measured = out._memloom_path, measured(out)
    return marked


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, hot=UNKNOWN, keys: int | None = None) -> DataFrame:
    """``left`` join ``right`` where ``left`` may have hot keys and ``right`` has few rows a key.

    All but the hot keys are shuffled as ever. The hot ones are answered by broadcasting just their rows of ``right`` while there are at most ``keys`` (``HOT_KEYS``) of them;
    beyond that the hot rows of ``left`` get a salt, as many as their number calls for, and the rows of ``right`` one copy for each salt of their key, so that no task takes more than about ``SALT_ROWS`` of a key.
    Null keys match nothing. ``how``: inner, left or left_semi. ``hot``: what ``hot_keys`` said of ``left``, for callers that join the same ``left`` again and again.
    """
    hot = hot_keys(left, on, rows) if hot is UNKNOWN else hot
    if hot is None:
        return left.join(right, on, how)
    number = measured(hot).get("rows")
    few = number is not None and number <= (HOT_KEYS if keys is None else keys)
    mark = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    cold = left.join(mark(hot.select(*on)), on, "left_anti").join(right, on, how)
    if few:
        warm = left.join(mark(hot.select(*on)), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot.select(*on)), on, "left_semi")), on, how)
        return cold.unionByName(warm)
    salts = hot.select(*on, F.ceil(F.col("_n") / SALT_ROWS).cast("int").alias("_salts"))
    # The place of a row among the salts is drawn from its own values, so a task that runs again draws it again; rows that are alike in all columns stay together.
    own = F.xxhash64(*[c for c, kind in left.dtypes if not kind.startswith("map")])
    warm = left.join(salts, on).withColumn("_salt", F.pmod(own, F.col("_salts")).cast("int")).drop("_salts")
    copies = right.join(salts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return cold.unionByName(warm.join(copies, [*on, "_salt"], how).drop("_salt"))


#: A group of at most this many rows is compared within one task; a larger one is cut into tiles.
TILE = 4_096


def self_pairs(rows: DataFrame, key: str, ident: str, condition=None, band=None, tile: int = TILE) -> DataFrame:
    """Pairs (``a``, ``b``) of rows as structs with equal ``key`` and a.ident < b.ident for which ``condition(a, b)`` holds.

    A key with more than ``tile`` rows is cut into tiles, by ``band(row)`` if given (rows can pair only within
    a band or with the next one) and by a hash of ``ident``; each pair of tiles is its own join key, so no task holds a whole large group and none of its pairs is lost.
    """
    fields = [c for c in rows.columns if c != key]
    a, b = (rows.select(key, F.struct(*fields).alias(x)) for x in "ab")
    check = condition or (lambda x, y: F.lit(True))
    ordered = F.col(f"a.{ident}") < F.col(f"b.{ident}")
    crowded = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    crowded = crowded.select(key, F.ceil(F.col("_n") / tile).cast("int").alias("_parts"))
    crowded = small_side(crowded, "crowded")
    if not rows_of(crowded):
        return a.join(b, key).where(ordered & check(F.col("a"), F.col("b"))).select("a", "b")
    cold = a.join(crowded, key, "left_anti").join(b, key).where(ordered & check(F.col("a"), F.col("b"))).select("a", "b")
    full = rows.join(crowded, key).withColumn("_b", band(rows) if band else F.lit(0)).withColumn("_p", F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = full.withColumn("_q", every).withColumn("_c", F.explode(F.array("_b", F.col("_b") + 1)) if band else F.col("_b"))
    left = left.select(key, F.col("_b").alias("_lb"), F.col("_p").alias("_lp"), F.col("_c").alias("_rb"), F.col("_q").alias("_rp"), F.struct(*fields).alias("a"))
    right = full.withColumn("_q", every).withColumn("_c", F.explode(F.array(F.col("_b") - 1, "_b")) if band else F.col("_b"))
    right = right.select(key, F.col("_c").alias("_lb"), F.col("_q").alias("_lp"), F.col("_b").alias("_rb"), F.col("_p").alias("_rp"), F.struct(*fields).alias("b"))
    hot = left.join(right, [key, "_lb", "_lp", "_rb", "_rp"]).where(((F.col("_lb") < F.col("_rb")) | ordered) & check(F.col("a"), F.col("b")))
    swap = ~ordered
    hot = hot.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return cold.unionByName(hot)
