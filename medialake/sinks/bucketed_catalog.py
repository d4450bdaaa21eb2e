"""B1 sink: a catalog in buckets by path, so that a batch rewrites only the buckets it touches.

``<base>/data/<write>/bucket=<b>/part-*.parquet`` holds rows whose path hashes to bucket b;
``<base>/v=<n>`` or ``<base>/v=<n>.<tag>`` is version n's manifest: one row (bucket, folder,
rows) per non-empty bucket, the folder relative to ``data``.  An upsert reads the buckets of its paths, writes them
anew into a folder of its own and then writes a manifest that names the new folders for the
touched buckets and the old ones for all others.  A version is the manifest alone, complete
with its ``_SUCCESS``: it becomes visible in one moment, and a failed write leaves at most a
data folder that no manifest names.  Older versions stay readable, since no file is changed.

The number of buckets is fixed when a catalog is created and kept as the name of an empty folder,
``<base>/buckets=<n>``.  A base whose newest version ``catalog_store`` wrote as a whole is put into buckets by
the first upsert, and ``catalog_store.read_current`` reads versions of both kinds.  Rows are hashed by ``xxhash64`` of the path, so the buckets are even
whatever the paths are; at 100 TB of catalog take as many as give files of a few hundred MB.

Scale.  A batch of k paths touches at most min(k, buckets) of them; the manifest has one row per bucket and is
read on the driver (it is the list of partitions, as in a table's metadata).  The touched rows are shuffled
once by bucket; the anti join of old and new rows is by (bucket, path) on the touched rows only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.ingest import newest_per_path
from ..session import cut_lineage
from . import catalog_store as CS

BUCKETS = 64
_MANIFEST = "bucket int, folder string, rows long"  # no catalog column is called folder


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def create(spark: SparkSession, base: str, buckets: int = BUCKETS) -> None:
    """Fix the number of buckets of a new catalog; nothing happens where one exists."""
    if _buckets(spark, base) is None:
        fs, _, jvm = CS._fs(spark, base)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/buckets={buckets}"))


def _buckets(spark: SparkSession, base: str) -> int | None:
    fs, path, _ = CS._fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []
    found = sorted(int(n.removeprefix("buckets=")) for n in names if n.startswith("buckets="))
    return found[0] if found else None


def _find(spark: SparkSession, base: str, version: int | None) -> str | None:
    """The folder name of a version (the newest one by default)."""
    found = [x for x in CS._complete(spark, base) if version is None or x[0] == version]
    return found[-1][2] if found else None


def _manifest(spark: SparkSession, base: str, name: str | None) -> dict[int, tuple[str, int]] | None:
    rows = CS.manifest_rows(spark, base, name) if name else []
    return None if rows is None else {r["bucket"]: (r["folder"], r["rows"]) for r in rows}


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict[int, tuple[str, int]]:
    """bucket -> (folder, rows) of a version (the newest one by default): one row per bucket, none for a
    version that ``catalog_store`` wrote as a whole."""
    return _manifest(spark, base, _find(spark, base, version)) or {}


def _read(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], S.MEDIA_FILES_SCHEMA)
    return spark.read.schema(S.MEDIA_FILES_SCHEMA).parquet(*[f"{base.rstrip('/')}/data/{f}" for f in folders])


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """All rows of a version (the newest one by default), or an empty catalog."""
    name = _find(spark, base, version)
    return CS.read_folder(spark, base, name) if name else spark.createDataFrame([], S.MEDIA_FILES_SCHEMA)


def read_touched(spark: SparkSession, base: str, batch: DataFrame) -> DataFrame:
    """The rows of those buckets alone that the paths of ``batch`` fall into: all that a freshness test
    (J2) of the batch against the catalog can meet.  A version without buckets is read as a whole."""
    held = _manifest(spark, base, _find(spark, base, None))
    if held is None:
        return read(spark, base)
    return _read(spark, base, sorted(held[b][0] for b in _touched(batch, _buckets(spark, base) or BUCKETS) if b in held))


def _touched(rows: DataFrame, buckets: int) -> list[int]:
    """Bucket numbers that occur: at most one row per bucket."""
    found = rows.select(bucket_of(F.col("file_path"), buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in found)


def upsert(base: str, new_rows: DataFrame, buckets: int = BUCKETS, tag: str = "") -> int:
    """Insert or replace by ``file_path``; of several new rows for one path the newest counts.  Returns the
    number of the version; an empty batch gives a version that shares every bucket.

    ``tag``: see ``catalog_store.write_version``; a tag that has a version already is not written again.
    """
    spark, base = new_rows.sparkSession, base.rstrip("/")
    found = CS._complete(spark, base)
    done = [number for number, t, _ in found if tag and t == tag]
    if done:
        return done[-1]
    create(spark, base, buckets)
    buckets = _buckets(spark, base)
    held = _manifest(spark, base, found[-1][2] if found else None)
    cols = [c for c in S.MEDIA_COLUMNS if c != "id"]
    new = cut_lineage(newest_per_path(new_rows.select(*cols)), "catalog-batch")
    if held is None:  # a version without buckets: all of it is put into buckets, once
        held, old = {}, read(spark, base)
        touched = _touched(old.select("file_path").unionByName(new.select("file_path")), buckets)
    else:
        touched = _touched(new, buckets)
        old = _read(spark, base, [held[b][0] for b in touched if b in held])
    old = old.select(*cols)
    kept = old.join(new.select("file_path"), "file_path", "left_anti")
    # The surrogate id is stable per path, as in operators.ingest.upsert.
    merged = kept.unionByName(new).select(F.xxhash64("file_path").alias("id"), *cols,
                                          bucket_of(F.col("file_path"), buckets).alias("bucket"))
    write = uuid.uuid4().hex
    if touched:
        (merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "file_path")
         .write.partitionBy("bucket").parquet(f"{base}/data/{write}"))
    sizes = {r["bucket"]: r["n"] for r in  # one row per touched bucket
             (spark.read.parquet(f"{base}/data/{write}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
              if touched else [])}
    held |= {b: (f"{write}/bucket={b}", n) for b, n in sizes.items()}
    number = found[-1][0] + 1 if found else 0
    rows = [(b, folder, n) for b, (folder, n) in sorted(held.items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        f"{base}/v={number}" + (f".{tag}" if tag else ""))
    return number


def vacuum(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Delete all versions but the newest ``keep`` and the bucket folders that none of the kept ones
    names; returns the deleted data folders.  Not to be run beside a writer or readers of old versions."""
    fs, _, jvm = CS._fs(spark, base)
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([base.rstrip("/"), *parts]))
    found = CS._complete(spark, base)
    named = {f for number, _, _ in found[-keep:] for f, _ in manifest(spark, base, number).values()}
    gone = []
    for _, _, name in found[:-keep]:
        fs.delete(path(name), True)
    if not fs.exists(path("data")):
        return gone
    for write in fs.listStatus(path("data")):
        for st in fs.listStatus(write.getPath()):
            folder = f"{write.getPath().getName()}/{st.getPath().getName()}"
            if st.isDirectory() and folder not in named:
                fs.delete(st.getPath(), True)
                gone.append(folder)
    return sorted(gone)
