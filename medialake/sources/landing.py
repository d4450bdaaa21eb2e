"""Land derived tables once, as Parquet in the shared folder, and read them back.

A catalog is a stored table in practice (the reference keeps it in a database
file and queries it many times).  The catalog-shaped views over the test tables
are therefore written once per source table version to
``<spark.checkpoint.dir>/landed/<key>/<name>`` and every query reads that copy.
The key is derived from the source files' paths, sizes and modification times, so
a changed source lands again.  Writes go to a temporary folder that is renamed
into place, so concurrent or failed writers never expose a partial table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def source_stamp(spark: SparkSession, paths: list[str]) -> str:
    parts = []
    for path in paths:
        fs, p, _ = _fs(spark, path)
        st = fs.getFileStatus(p)
        parts.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:20]


def landed_path(spark: SparkSession, name: str, sources: list[str],
                write: Callable[[str], None], version: str = "") -> str:
    """The folder that ``write(folder)`` fills from ``sources``, landed once.

    ``version`` identifies the rules that fill it (changing the rules
    lands a new copy even when the checkpoint folder outlives the job)."""
    key = hashlib.sha1((source_stamp(spark, sources) + "|" + version).encode()).hexdigest()[:20]
    final = shared_path(spark, "landed", key, name)
    fs, final_p, jvm = _fs(spark, final)
    marker = jvm.org.apache.hadoop.fs.Path(final_p, "_SUCCESS")
    if not fs.exists(marker):
        tmp = shared_path(spark, "landed", key, f".{name}.{uuid.uuid4().hex}")
        write(tmp)
        moved = not fs.exists(final_p) and fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), final_p)
        if not moved and not fs.exists(marker):
            raise RuntimeError(f"{final} exists without being complete")
    return final


def landed(spark: SparkSession, name: str, sources: list[str],
           build: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """The table ``name`` built by ``build()`` from ``sources``, landed once (see ``landed_path``)."""
    return spark.read.parquet(landed_path(
        spark, name, sources, lambda folder: build().write.mode("overwrite").parquet(folder), version))


def task_filesystem(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI as a task opens it, and the path inside it."""
    if path.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(quote(path, safe="/:@"))


def write_files(files: DataFrame, folder: str) -> None:
    """``files`` (name, content as binary): each row as a file of its own below ``folder``, written by
    the tasks; a task that is run again writes the same bytes to the same names.  Complete with ``_SUCCESS``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = task_filesystem(folder)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{inner}/{name}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    spark = files.sparkSession
    files.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    fs, folder_p, jvm = _fs(spark, folder)
    fs.mkdirs(folder_p)
    fs.create(jvm.org.apache.hadoop.fs.Path(folder_p, "_SUCCESS")).close()
