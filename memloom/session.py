"""Session helpers: table loading and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset do we set one of
    our own: below the warehouse on a cluster, a temporary folder in a single-machine session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="memloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_memloom_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{checkpoint_root(spark)}/memloom-{app}-{uuid.uuid4().hex[:8]}"

        def clean(path=_OWN[app]) -> None:
            try:
                _remove(spark, path)
            except Exception:  # the session is gone; its folder goes with it
                pass

        atexit.register(clean)
    return _OWN[app]


def materialize(df: DataFrame, label: str = "t", **measures: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without tying any block to an executor, so a lost executor costs a re-read
    and never a recomputation. Values made by non-deterministic expressions are fixed by the write.
    Rows and ``measures`` (aggregates by name) are counted in the same pass: see ``rows_of`` and ``measured``.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memloom_path, out._memloom_measured = path, seen.get
    return out


def measured(df: DataFrame) -> dict:
    """What ``materialize`` measured; empty for any other table."""
    return getattr(df, "_memloom_measured", {})


def rows_of(df: DataFrame) -> int | None:
    """The number of rows of a table that ``materialize`` wrote; None where nothing has counted them."""
    return measured(df).get("rows")


def discard(df: DataFrame | None) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_memloom_path", None)
    if path:
        _remove(df.sparkSession, path)
