"""K7: dates for photo-server assets read from their file names (dry-run plan).

Album assets (J9) -> EXIF year test (C10) -> date from the name (H11) -> one change
row per asset to update (B6).  Every asset of the album gets a status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import assets as A


def date_from_name_plan(members: DataFrame, assets: DataFrame, album_name: str,
                        target_year: int) -> DataFrame:
    chosen = A.exif_year(A.album_assets(members, assets, album_name))
    dto = F.col("exifInfo.dateTimeOriginal")
    name_date = D.datetime_from_filename(F.col("originalFileName"))
    status = (F.when(dto.isNull() | (dto == ""), F.lit("no_exif_date"))
              .when(F.col("exif_year").isNull(), F.lit("bad_exif_year"))
              .when(F.col("exif_year") != target_year, F.lit("other_year"))
              .when(name_date.isNull(), F.lit("no_name_date"))
              .otherwise(F.lit("update")))
    return chosen.select(
        F.col("id").alias("asset_id"), "originalFileName", dto.alias("old_date"), "exif_year",
        status.alias("status"),
        F.when(F.col("exif_year") == target_year, D.iso_with_offset(name_date)).alias("new_date"))


def date_changes(plan: DataFrame) -> DataFrame:
    """(asset id, ISO date with offset) for the assets to update."""
    return plan.where(F.col("status") == "update").select("asset_id", "new_date")
