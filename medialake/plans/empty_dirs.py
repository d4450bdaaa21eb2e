"""K3: directories with no file anywhere below them, deepest first.

Directories ``left_anti`` the ancestors of every file's directory: one explode of
the per-directory file table and one anti join, instead of walking the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def empty_directories(dirs: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """``dirs``: dir_path of directories on disk; ``files``: file_path of files."""
    file_dirs = files.select(P.dirname(F.col("file_path")).alias("d")).distinct()
    occupied = file_dirs.select(F.explode(P.ancestors(F.col("d"))).alias("dir_path")).distinct()
    cand = dirs.select("dir_path").distinct()
    if root:
        prefix = root.rstrip("/") + "/"
        cand = cand.where(F.col("dir_path").startswith(prefix))
    empty = cand.join(occupied, "dir_path", "left_anti")
    return empty.select("dir_path", F.size(P.components(F.col("dir_path"))).alias("parts"))


def ordered(empty: DataFrame) -> DataFrame:
    return empty.orderBy(F.col("parts").desc(), "dir_path")
