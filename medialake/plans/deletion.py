"""K1: what the deletion tool would delete (dry run as a table).

List (A5) -> pattern (C2) -> existing / missing (J3) -> deepest-first order (F1)
-> totals (D14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .common import mark_existing


def deletion_plan(listed: DataFrame, inventory: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row per listed path (duplicates kept): status ``delete`` or ``missing``,
    the size on disk, and the F1 sort keys (``depth``, ``dir``, ``name``)."""
    if pattern:
        listed = listed.where(F.col("file_path").contains(F.lit(pattern)))
    rows = mark_existing(listed, inventory).withColumn(
        "status", F.when(F.col("exists"), F.lit("delete")).otherwise(F.lit("missing")))
    d = P.dirname(F.col("file_path"))
    return rows.select(F.col("file_path").alias("input_path"), "status", "original_size",
                       P.depth(d).alias("depth"), d.alias("dir"),
                       P.basename(F.col("file_path")).alias("name"))


def ordered(plan: DataFrame) -> DataFrame:
    """F1 order of the plan: deepest directory first, then directory, then name."""
    return plan.orderBy(F.col("depth").desc(), "dir", "name")


def deletion_totals(plan: DataFrame) -> DataFrame:
    """Files to delete, bytes to free, missing files."""
    d = F.col("status") == "delete"
    return plan.agg(F.count_if(d).alias("files_to_delete"),
                    F.coalesce(F.sum(F.when(d, F.col("original_size"))), F.lit(0)).cast("bigint")
                    .alias("bytes_to_free"),
                    F.count_if(F.col("status") == "missing").alias("missing"))
