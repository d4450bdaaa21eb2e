"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: anything that
cuts lineage goes through ``spark.checkpoint.dir`` (a shared folder named by the
cluster).  Tests and the bench set their own folder only when that setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that every entry point applies.  Timestamps in the catalog are naive
# (TIMESTAMP_NTZ); the session zone only matters for rendering, and the library
# renders epoch seconds in UTC without consulting it.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "medialake", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own session)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as is.
    Only in local runs (tests, bench) where it is unset do we pick a fresh folder.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="medialake-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for written intermediate tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


#: The open scopes; each collects the folders of the tables written while it is open.
_scopes: list[list[str]] = []


@contextmanager
def table_scope() -> Iterator[list[str]]:
    """Collect the folders of all tables that ``cut_lineage`` writes inside the block.

    Whoever opens the scope knows when no plan reads these tables any more and may then hand
    them to ``drop_tables``."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]


def drop_tables(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Delete written tables that are not needed again, but none that ``reader``'s plan scans."""
    scanned = "\n".join(reader.inputFiles()) if reader is not None and paths else ""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path.rstrip("/").rsplit("/", 1)[-1] + "/" not in scanned:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared checkpoint folder and
    reading it back (survives executor loss; keeps codegen and column pruning,
    and is cheaper than an RDD checkpoint, which recomputes the lineage once more).
    """
    path = shared_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    for made in _scopes:
        made.append(path)
    return df.sparkSession.read.parquet(path)
