"""B1 sink: a catalog stored as versioned Parquet directories.

``<base>/v=<n>`` or ``<base>/v=<n>.<tag>`` holds version n.  A new version is written completely next to the
current one and only then becomes current (the highest complete version, marked by
the commit protocol's ``_SUCCESS``), so a reader never sees a half-written catalog
and no job overwrites the path it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S


def _fs(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def _complete(spark: SparkSession, base: str) -> list[tuple[int, str, str]]:
    """(version, tag, folder) of every complete version below ``base``, in order (one
    directory listing on the driver)."""
    fs, path, jvm = _fs(spark, base)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        number, _, tag = name.removeprefix("v=").partition(".")
        if name.startswith("v=") and number.isdigit() and \
                fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((int(number), tag, name))
    return sorted(out)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the complete versions below ``base``."""
    return [number for number, _, _ in _complete(spark, base)]


def has_tag(spark: SparkSession, base: str, tag: str) -> bool:
    """True if a complete version was written under ``tag``."""
    return any(t == tag for _, t, _ in _complete(spark, base))


def manifest_rows(spark: SparkSession, base: str, name: str) -> list | None:
    """Rows (bucket, folder, rows) of a version folder that is a manifest of ``bucketed_catalog``, or None
    for one that holds the rows themselves."""
    found = spark.read.parquet(f"{base.rstrip('/')}/{name}")
    return found.select("bucket", "folder", "rows").collect() if "folder" in found.columns else None


def read_folder(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows of a version folder, of either kind."""
    base = base.rstrip("/")
    rows = manifest_rows(spark, base, name)
    paths = [f"{base}/{name}"] if rows is None else [f"{base}/data/{r['folder']}" for r in rows]
    if not paths:
        return spark.createDataFrame([], S.MEDIA_FILES_SCHEMA)
    return spark.read.schema(S.MEDIA_FILES_SCHEMA).parquet(*paths)


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The newest complete version (whole or in buckets), or an empty catalog."""
    found = _complete(spark, base)
    return read_folder(spark, base, found[-1][2]) if found else spark.createDataFrame([], S.MEDIA_FILES_SCHEMA)


def write_version(df: DataFrame, base: str, tag: str = "") -> int:
    """Write ``df`` as the version after the newest one; return its number (from 0).

    ``tag`` names the work that made it (letters, digits, ``-`` and ``_``).  It is part of the
    folder's name, so version and tag become visible in the same moment.
    """
    found = _complete(df.sparkSession, base)
    number = found[-1][0] + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/v={number}" + (f".{tag}" if tag else ""))
    return number
