"""K4 (video encoding) and K5 (RAW to JPEG) plans as tables.

List (A5) -> pattern (C2) -> existing (J3) -> [RAW only (C1)] -> output path (H9)
-> protected-output check (J4, raises) -> skip existing outputs (J5) -> estimate
(H19) -> totals (D13).  Nothing is encoded or converted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths as P
from .common import check_protected, mark_existing, mark_existing_outputs


def encode_plan(listed: DataFrame, inventory: DataFrame, catalog: DataFrame | None = None,
                suffix: str = "_encoded", pattern: str | None = None,
                skip_existing: bool = True) -> DataFrame:
    if pattern:
        listed = listed.where(F.col("file_path").contains(F.lit(pattern)))
    existing = mark_existing(listed, inventory).where("exists")
    tasks = existing.select(
        F.col("file_path").alias("input_path"),
        P.output_path(F.col("file_path"), suffix).alias("output_path"),
        "original_size", F.lit("encode").alias("status"))
    if catalog is not None:
        check_protected(tasks, catalog)
    plan = mark_existing_outputs(tasks, inventory, skip_existing)
    return plan.withColumn("estimated_size", F.when(
        F.col("status") == "encode", F.col("original_size") * S.VIDEO_ESTIMATE_RATIO))


def raw_convert_plan(listed: DataFrame, inventory: DataFrame, catalog: DataFrame | None = None,
                     suffix: str = "_jpg", pattern: str | None = None,
                     skip_existing: bool = True) -> DataFrame:
    """K5; non-RAW files get status ``filtered`` (the reference counts them)."""
    existing = mark_existing(listed, inventory).where("exists")
    is_raw = P.lower_extension(F.col("file_path")).isin(*S.RAW_EXTENSIONS)
    keep = is_raw if not pattern else (is_raw & F.col("file_path").contains(F.lit(pattern)))
    rows = existing.withColumn(
        "status", F.when(keep, F.lit("convert")).otherwise(F.lit("filtered")))
    tasks = rows.select(F.col("file_path").alias("input_path"),
                        F.when(keep, P.output_path(F.col("file_path"), suffix, ".jpg"))
                        .alias("output_path"),
                        "original_size", "status")
    if catalog is not None:
        check_protected(tasks.where(F.col("status") == "convert"), catalog)
    plan = mark_existing_outputs(tasks, inventory, skip_existing)
    return plan.withColumn("estimated_size", F.when(
        F.col("status") == "convert", F.col("original_size") * S.RAW_ESTIMATE_RATIO))
