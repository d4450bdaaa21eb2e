"""Photo-server assets and albums as tables.

The reference pages through a server API and fetches every asset one by one; here
the asset records are a table (landed JSON lines, or the fixture view), album
membership is a table of (album, asset) rows, and every step is a filter or an
equi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def asset_lines(spark, path: str) -> DataFrame:
    """Landed JSON lines, each parsed to ``record`` (``schema.ASSET_SCHEMA``) or, if it is no such record,
    kept in ``bad``.  Bad: not an object, broken off, a field of another type, or without an id; missing
    fields are NULL and fields outside the schema are left out.  Lines of white space alone are no lines."""
    schema = T.StructType([*S.ASSET_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json(
        "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    good = F.col("_r._bad").isNull() & F.col("_r.id").isNotNull()
    record = F.struct(*[F.col(f"_r.{name}") for name in S.ASSET_SCHEMA.names])
    return parsed.select(F.when(good, record).alias("record"), F.when(~good, F.col("value")).alias("bad"))


def read_assets(spark, path: str) -> DataFrame:
    """Asset records landed as JSON lines, without the bad lines (see ``asset_lines``)."""
    return asset_lines(spark, path).where("record is not null").select("record.*")


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, records and bad lines of ``asset_lines``."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count("record").alias("records"),
                     F.count("bad").alias("bad_lines"))


def read_albums(spark, path: str) -> DataFrame:
    """Albums landed as JSON lines, exploded to membership rows right away."""
    albums = spark.read.schema(S.ALBUM_SCHEMA).json(path)
    return albums.select(F.col("id").alias("album_id"), "albumName",
                         F.explode("assetIds").alias("asset_id"))


def live_assets(assets: DataFrame, asset_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Assets not in the trash, optionally of one type (IMAGE / VIDEO), optionally the first ``limit``
    by id (a top-k per partition, merged; the reference takes them in the server's order)."""
    df = assets.where(~F.coalesce(F.col("isTrashed"), F.lit(False)))
    if asset_type:
        df = df.where(F.col("type") == asset_type)
    return df if limit is None else df.orderBy("id").limit(limit)


def asset_detail(assets: DataFrame) -> DataFrame:
    """A10: the nested fields the tools read, as flat columns."""
    return assets.select("id", "type", "originalFileName",
                         F.col("exifInfo.exifImageWidth").alias("width"),
                         F.col("exifInfo.exifImageHeight").alias("height"),
                         F.col("exifInfo.dateTimeOriginal").alias("dateTimeOriginal"))


def first_album(albums: DataFrame, album_name: str) -> str:
    """The id of the first album called ``album_name`` in listing order (``ordinal``; ties go to the lesser
    id).  One aggregate, of which one row reaches the driver; a name without an album is an error."""
    found = albums.where(F.col("albumName") == F.lit(album_name)).agg(
        F.min(F.struct("ordinal", "album_id")).alias("a")).first()["a"]
    if found is None:
        raise ValueError(f"Album '{album_name}' not found")
    return found["album_id"]


def album_assets(members: DataFrame, assets: DataFrame, album_name: str,
                 asset_type: str | None = None, albums: DataFrame | None = None) -> DataFrame:
    """A11 + J9: live assets of the album called ``album_name``.

    With ``albums`` (album_id, albumName, ordinal: the order in which albums are listed) only the first
    album of that name counts, as in the reference.  Without a listing all memberships of the
    name are used: the members' own names then stand for one album each.  An unknown name is an error.
    """
    if albums is not None:
        chosen = members.where(F.col("album_id") == F.lit(first_album(albums, album_name)))
    else:
        chosen = members.where(F.col("albumName") == F.lit(album_name))
        if chosen.limit(1).count() == 0:
            raise ValueError(f"Album '{album_name}' not found")
    ids = chosen.select(F.col("asset_id").alias("id")).distinct()
    return live_assets(assets, asset_type).join(ids, "id", "left_semi")


def resolution_match(assets: DataFrame, width: int, height: int, exact: bool = False,
                     tolerance: int = S.RESOLUTION_TOLERANCE) -> DataFrame:
    """Adds ``matches`` (either orientation, exact or within ``tolerance`` px per
    side) and ``no_size`` (width or height missing; never matches)."""
    w, h = F.col("exifInfo.exifImageWidth"), F.col("exifInfo.exifImageHeight")
    if exact:
        hit = ((w == width) & (h == height)) | ((h == width) & (w == height))
    else:
        hit = (((F.abs(w - width) <= tolerance) & (F.abs(h - height) <= tolerance))
               | ((F.abs(h - width) <= tolerance) & (F.abs(w - height) <= tolerance)))
    no_size = w.isNull() | h.isNull()
    return assets.withColumn("no_size", no_size).withColumn(
        "matches", F.when(no_size, F.lit(False)).otherwise(hit))


def exif_year(assets: DataFrame) -> DataFrame:
    """C10 helper: ``exif_year`` = integer of the first four characters of
    dateTimeOriginal (NULL if missing or not a number)."""
    dto = F.col("exifInfo.dateTimeOriginal")
    return assets.withColumn(
        "exif_year", F.when(dto.isNotNull() & (dto != ""), F.substring(dto, 1, 4).try_cast("int")))


def target_year_filter(assets: DataFrame, year: int) -> DataFrame:
    """Keep assets whose EXIF year equals ``year``; missing or bad years drop."""
    return exif_year(assets).where(F.col("exif_year") == year)
