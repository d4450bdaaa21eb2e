"""K6: which files get a creation time, from a suggestion list (dry run as a table).

Suggestions (A6) -> pattern (C2) -> existing (J3) -> supported (C13) -> already
dated in the catalog (J6) -> status -> how it would be written (C14) -> counters
(D12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths as P
from .common import split_existing


def write_method(path_col) -> F.Column:
    """C14: EXIF for images, container metadata for videos; formats that cannot
    hold a creation time (.mpg .mpeg .m2v .vob .dat) are ``unsupported_format``."""
    ext = P.lower_extension(path_col)
    return (F.when(ext.isin(*S.NO_DATE_METADATA_EXTENSIONS), F.lit("unsupported_format"))
            .when(ext.isin(*S.IMAGE_EXTENSIONS), F.lit("EXIF"))
            .when(ext.isin(*S.VIDEO_EXTENSIONS), F.lit("Video Metadata"))
            .otherwise(F.lit("Unknown")))


def creation_time_plan(suggestions: DataFrame, inventory: DataFrame, catalog: DataFrame,
                       pattern: str | None = None) -> DataFrame:
    s = suggestions.select("file_path", "suggested")
    if pattern:
        s = s.where(F.col("file_path").contains(F.lit(pattern)))
    existing, _ = split_existing(s, inventory)
    supported = existing.where(P.lower_extension(F.col("file_path")).isin(*S.SUPPORTED_EXTENSIONS))
    dated = catalog.select("file_path", F.col("creation_date").isNotNull().alias("has_date"))
    rows = supported.join(dated, "file_path", "left")
    method = write_method(F.col("file_path"))
    status = (F.when(F.coalesce(F.col("has_date"), F.lit(False)), F.lit("has_metadata"))
              .when(F.col("suggested").isNull(), F.lit("no_suggestion"))
              .when(method == "unsupported_format", F.lit("unsupported_format"))
              .otherwise(F.lit("update")))
    return rows.select(F.col("file_path").alias("input_path"), "suggested",
                       status.alias("status"),
                       F.when(status == "update", method).alias("method"))


def creation_time_counters(plan: DataFrame) -> DataFrame:
    """D12 for K6: processed, to update, already dated, without suggestion,
    format without date field."""
    s = F.col("status")
    return plan.agg(F.count(F.lit(1)).alias("processed"),
                    F.count_if(s == "update").alias("updated"),
                    F.count_if(s == "has_metadata").alias("skipped_has_metadata"),
                    F.count_if(s == "no_suggestion").alias("skipped_no_pattern"),
                    F.count_if(s == "unsupported_format").alias("unsupported_format"))
