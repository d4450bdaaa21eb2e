"""K8: a new album of the images matching a resolution (dry-run plan).

Live IMAGE assets (A9) -> resolution test (C9) -> album membership rows (B5).  The
new album is written as (album_name, asset_id) rows -- a membership table scales
with the number of matches, where one array per album would not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets as A


#: Width and height, each with an optional sign, around an ``x``.
_SIZE = r"\s*([+-]?\d+)\s*x\s*([+-]?\d+)\s*"


def parse_resolution(text: str) -> tuple[int, int]:
    """Width and height of a text like ``1920x1080``; ValueError for any other text."""
    found = re.fullmatch(_SIZE, text, re.IGNORECASE | re.ASCII)
    if found is None:
        raise ValueError(f"not a size of the form 1920x1080: {text!r}")
    width, height = map(int, found.groups())
    return width, height


def resolution_column(text_col):
    """H16 as a column: (width, height) struct, NULL when the text is not ``WxH``."""
    t = F.lower(text_col)
    side = lambda group: F.regexp_extract(t, f"^{_SIZE}$", group).try_cast("int")
    return F.when(t.rlike(f"^{_SIZE}$"), F.struct(side(1).alias("width"), side(2).alias("height")))


def matching_images(assets: DataFrame, resolution: str, exact: bool = False) -> DataFrame:
    w, h = parse_resolution(resolution)
    return A.resolution_match(A.live_assets(assets, "IMAGE"), w, h, exact)


def album_plan(assets: DataFrame, resolution: str, album_name: str,
               exact: bool = False) -> DataFrame:
    """B5 rows: the album to create and its assets."""
    return (matching_images(assets, resolution, exact).where("matches")
            .select(F.lit(album_name).alias("album_name"), F.col("id").alias("asset_id")))


def match_counts(assets: DataFrame, resolution: str, exact: bool = False) -> DataFrame:
    """Scanned, matched and no-size counters of the run, one row."""
    m = matching_images(assets, resolution, exact)
    return m.agg(F.count(F.lit(1)).alias("scanned"),
                 F.count_if("matches").alias("matched"),
                 F.count_if("no_size").alias("no_size"))
