"""Exact global positions from range-partitioned sorting with partition offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


def sorted_with_local_rows(df: DataFrame, keys: list[Column], label: str = "sorted") -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written, with ``_part`` and ``_row``.

    ``keys`` should end in something unique: then a value that a third of all rows share is cut
    over several ranges and no task holds an unbounded group.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    return ordered.withColumn("_part", F.shiftright("_at", _ROW_BITS)).withColumn("_row", F.col("_at") - F.shiftleft(F.shiftright("_at", _ROW_BITS), _ROW_BITS)).drop("_at")


def partition_offsets(ordered: DataFrame, amount: Column) -> DataFrame:
    """(``_part``, ``_before``): the sum of ``amount`` over all earlier partitions.

    One row per partition is gathered, as many as there are tasks, whatever the data.
    """
    sums = ordered.groupBy("_part").agg(F.sum(amount).alias("n")).collect()
    before, rows = 0, []
    for r in sorted(sums, key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r["n"] or 0
    return ordered.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")


def global_positions(df: DataFrame, keys: list[Column], name: str = "_pos", label: str = "sorted") -> DataFrame:
    """``df`` with its exact 1-based position in the order of ``keys`` over all partitions.

    Ties are broken by the order of rows in the written table. An empty table stays empty.
    """
    ordered = sorted_with_local_rows(df, keys, label)
    offsets = F.broadcast(partition_offsets(ordered, F.lit(1)))
    return ordered.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
