"""Catalog-shaped views over the driver's generic test tables.

The test tables hold no media catalog, so the catalog (``media_files``), the asset
records of the photo server (``assets``/``albums``) and the inputs derived from them
are computed from ``documents`` and ``events`` by fixed rules (FIXTURES.md §3).
Every view is a narrow projection of its source table: no shuffle, and the
work grows with the table.  The DuckDB oracle builds the same views with the same
rules (see ``medialake.oracle``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import paths as P
from .landing import landed, landed_path, write_files


# Version of the rules below: a change to this module lands the tables again.
with open(__file__, "rb") as _fh:
    RULES_VERSION = hashlib.sha1(_fh.read()).hexdigest()[:12]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Column rules for media_files; i = doc_id, k = i div 2, n = n_chars.
_DIR = """CASE k % 6
    WHEN 0 THEN concat('/library/photos/2019/dev', k % 7)
    WHEN 1 THEN concat('/library/photos/2021/2021.06.xx - trip/dev', k % 7)
    WHEN 2 THEN '/library/photos/2020/2020.09.13-event'
    WHEN 3 THEN concat('/library/videos/set', k % 3)
    WHEN 4 THEN concat('/library/Camera Uploads/dev', k % 7)
    ELSE '/library' END"""

_STEM = """CASE
    WHEN k % 4 < 2 THEN concat('IMG_', k, IF(i % 2 = 1, '_720p', ''))
    WHEN k % 4 = 2 THEN concat('2018-', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '-',
                               lpad(CAST(1 + k % 31 AS STRING), 2, '0'), ' 21-30-',
                               lpad(CAST(i % 60 AS STRING), 2, '0'), ' ', i)
    ELSE concat('VID_2021', lpad(CAST(1 + k % 13 AS STRING), 2, '0'), '05_122219_', i) END"""

_EXT = """CASE
    WHEN i % 8 < 4 THEN 'jpg'
    WHEN i % 8 = 4 THEN CASE k % 3 WHEN 0 THEN 'dng' WHEN 1 THEN 'CR2' ELSE 'nef' END
    WHEN i % 8 IN (5, 6) THEN 'mp4'
    WHEN k % 2 = 0 THEN 'avi'
    ELSE 'mpg' END"""


def _src(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media catalog as a stored table (landed once per source version)."""
    return landed(spark, "media_files", [_src(sf_dir, "documents")],
                  lambda: media_files_view(spark, sf_dir), RULES_VERSION)


def media_files_view(spark: SparkSession, sf_dir: str, with_content: bool = False) -> DataFrame:
    """The media catalog (one row per document), schema ``schema.MEDIA_FILES_SCHEMA``.

    ``with_content`` appends the document text as ``content`` (the file bytes), so
    hashing needs no join back to the source table.
    """
    docs = table(spark, sf_dir, "documents")
    base = docs.selectExpr(
        "doc_id AS i", "CAST(doc_id DIV 2 AS BIGINT) AS k", "n_chars AS n", "text")
    parts = base.selectExpr(
        "*", f"{_DIR} AS dir", f"{_STEM} AS stem", f"{_EXT} AS ext",
        "i % 17 = 0 AS corrupt", "i % 8 >= 5 AS video")
    return parts.selectExpr(
        "i + 1 AS id",
        "concat(dir, '/', stem, '.', ext) AS file_path",
        "concat(stem, '.', ext) AS file_name",
        "n * 4096 AS file_size",
        "IF(corrupt, NULL, md5(text)) AS file_hash",
        "IF(video, 'video', 'image') AS media_type",
        """CASE WHEN i % 3 = 0 OR i % 8 = 4 OR corrupt THEN NULL
                ELSE TIMESTAMP_NTZ '2022-05-01 00:00:00' + make_dt_interval(CAST(i % 3650 AS INT)) END
           AS creation_date""",
        "IF(video AND NOT corrupt, CAST(i % 7200 AS DOUBLE) + CAST(0.5 AS DOUBLE), NULL) AS duration",
        """CASE WHEN i % 8 = 4 OR corrupt THEN NULL
                ELSE element_at(array(1920, 1179, 2556, 1280), CAST(i % 4 AS INT) + 1) END AS width""",
        """CASE WHEN i % 8 = 4 OR corrupt THEN NULL
                ELSE element_at(array(1080, 2556, 1179, 720), CAST(i % 4 AS INT) + 1) END AS height""",
        """CASE WHEN NOT video OR corrupt THEN NULL
                WHEN ext = 'mp4' THEN IF(k % 3 = 0, 'hevc', 'h264')
                WHEN ext = 'avi' THEN 'mjpeg' ELSE 'mpeg2video' END AS codec_name""",
        """CASE WHEN NOT video OR corrupt THEN NULL
                WHEN ext = 'mp4' THEN IF(k % 3 = 0, 'H.265 / HEVC (High Efficiency Video Coding)',
                                         'H.264 / AVC / MPEG-4 AVC / MPEG-4 part 10')
                WHEN ext = 'avi' THEN 'Motion JPEG' ELSE 'MPEG-2 video' END AS codec_long_name""",
        "IF(video AND NOT corrupt, (n % 40) * 1000000, NULL) AS bit_rate",
        "IF(video AND NOT corrupt, CAST(24 + i % 7 AS DOUBLE), NULL) AS frame_rate",
        """CASE WHEN corrupt THEN NULL
                WHEN ext = 'mp4' THEN 'mov,mp4,m4a,3gp,3g2,mj2'
                WHEN ext = 'avi' THEN 'avi' WHEN ext = 'mpg' THEN 'mpeg'
                WHEN ext = 'jpg' THEN 'jpeg' ELSE lower(ext) END AS format_name""",
        """CASE WHEN corrupt THEN NULL
                WHEN ext = 'mp4' THEN 'QuickTime / MOV'
                WHEN ext = 'avi' THEN 'AVI (Audio Video Interleaved)'
                WHEN ext = 'mpg' THEN 'MPEG-PS (MPEG-2 Program Stream)'
                WHEN ext = 'jpg' THEN 'JPEG Image' ELSE concat(upper(ext), ' RAW Image') END
           AS format_long_name""",
        "corrupt AS is_corrupted",
        """CASE WHEN NOT corrupt THEN NULL
                WHEN video THEN 'ffprobe error: moov atom not found'
                ELSE 'Critical image corruption: cannot identify image file' END AS error_message""",
        "TIMESTAMP_NTZ '2024-01-15 10:30:00' AS analyzed_at",
        "CAST(1600000000 + i * 3600 AS DOUBLE) AS modified_at",
        *(["text AS content"] if with_content else []),
    )


def documents_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File content per catalog path: the document text stands in for the bytes."""
    return media_files_view(spark, sf_dir, with_content=True).select("file_path", "content")


def file_name(path: Column) -> Column:
    """The name of a landed file: hidden and odd paths of the catalog are names like all others."""
    digest = F.md5(path)
    return F.concat(F.substring(digest, 1, 2), F.lit("/f"), digest)


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the catalog's files: one file per document with a text, under ``file_name``."""
    def write(folder: str) -> None:
        content = documents_content(spark, sf_dir).where(F.col("content").isNotNull())
        write_files(content.select(file_name(F.col("file_path")).alias("name"),
                                   F.col("content").cast("binary").alias("content")), folder)
    return landed_path(spark, "document-files", [_src(sf_dir, "documents")], write, RULES_VERSION)


def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan records as a stored table (landed once per source version)."""
    return landed(spark, "scan_records", [_src(sf_dir, "documents")],
                  lambda: scan_records_view(spark, sf_dir), RULES_VERSION)


def scan_records_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan records of a re-scan below ``/library`` (schema ``SCAN_RECORDS_SCHEMA``).

    Every catalog file, a quarter of them touched again (mtime + 60 s); one new
    ``new_{id}.jpg`` per ten catalog files (some with decoder errors: critical when
    id % 30 = 0, harmless when id % 20 = 0, harmless but with a failed EXIF read
    when id % 50 = 0); and per 25 files a hidden file, a file in a hidden directory
    and a non-media file.  Probe and EXIF documents are rendered from the catalog
    columns, so parsing them back (A7/A8) reproduces the catalog.
    """
    cat = media_files(spark, sf_dir)
    probe = F.to_json(F.struct(
        F.struct(
            F.col("duration").cast("string").alias("duration"),
            F.col("bit_rate").cast("string").alias("bit_rate"),
            F.col("format_name").alias("format_name"),
            F.col("format_long_name").alias("format_long_name"),
            F.when(F.col("creation_date").isNotNull(),
                   F.create_map(F.lit("creation_time"),
                                F.replace(D.iso_with_offset("creation_date"), F.lit("+00:00"), F.lit(".000000Z"))))
             .alias("tags"),
        ).alias("format"),
        F.array(
            F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"),
                     F.lit(None).cast("string").alias("codec_long_name"),
                     F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                     F.lit("0/0").alias("r_frame_rate")),
            F.struct(F.lit("video").alias("codec_type"), F.col("codec_name").alias("codec_name"),
                     F.col("codec_long_name").alias("codec_long_name"),
                     F.col("width").alias("width"), F.col("height").alias("height"),
                     F.format_string("%d/1", F.col("frame_rate").cast("int")).alias("r_frame_rate")),
        ).alias("streams"),
    ))
    exif = F.to_json(F.array(F.struct(
        F.replace(D.ts_text("creation_date"), F.lit("-"), F.lit(":")).alias("DateTimeOriginal"),
        F.lit(None).cast("string").alias("CreateDate"),
        F.lit(None).cast("string").alias("CreationDate"),
    )))
    is_video = F.col("media_type") == "video"
    ok = ~F.col("is_corrupted")
    existing = cat.select(
        "file_path",
        "file_size",
        (F.col("modified_at") + F.when(F.col("id") % 4 == 0, 60.0).otherwise(0.0))
        .alias("modified_at"),
        F.col("file_hash").alias("content_md5"),
        F.when(is_video & ok, probe).alias("probe_json"),
        F.when(~is_video & ok, exif).alias("exif_json"),
        F.when(~is_video & ok, F.col("width")).alias("width"),
        F.when(~is_video & ok, F.col("height")).alias("height"),
        F.when(~is_video & ok & (F.col("format_name") == "jpeg"), F.lit("JPEG")).alias("image_format"),
        F.when(~ok, F.when(is_video, F.lit("corrupted")).otherwise(F.lit("image_error")))
        .alias("error_kind"),
        F.when(~ok, F.when(is_video, F.lit("moov atom not found"))
               .otherwise(F.lit("cannot identify image file")))
        .alias("error_text"),
    )
    i = F.col("id")
    new_kind = (F.when(i % 30 == 0, F.lit("image_error"))
                .when(i % 50 == 0, F.lit("image_error_exif_failed"))
                .when(i % 20 == 0, F.lit("image_error")))
    new_text = (F.when(i % 30 == 0, F.lit("image file is truncated (17 bytes not processed)"))
                .when((i % 50 == 0) | (i % 20 == 0), F.lit("unknown EXIF orientation tag")))
    new = cat.where(i % 10 == 0).select(
        F.concat(P.dirname(F.col("file_path")), F.lit("/new_"), i, F.lit(".jpg"))
        .alias("file_path"),
        "file_size",
        (F.col("modified_at") + 7.0).alias("modified_at"),
        F.col("file_hash").alias("content_md5"),
        F.lit(None).cast("string").alias("probe_json"),
        F.to_json(F.array(F.struct(
            F.lit(None).cast("string").alias("DateTimeOriginal"),
            F.lit("2023:03:20 10:15:00").alias("CreateDate"),
            F.lit(None).cast("string").alias("CreationDate"),
        ))).alias("exif_json"),
        F.lit(4000).alias("width"),
        F.lit(3000).alias("height"),
        F.lit("JPEG").alias("image_format"),
        new_kind.alias("error_kind"),
        new_text.alias("error_text"),
    )
    side = cat.where(i % 25 == 0)
    d = P.dirname(F.col("file_path"))
    extras = [
        F.concat(d, F.lit("/.DS_Store_"), i),                       # hidden file
        F.concat(d, F.lit("/.thumbnails/t_"), i, F.lit(".jpg")),     # file in hidden dir
        F.concat(d, F.lit("/notes_"), i, F.lit(".txt")),             # not media
    ]
    noise = side.select(F.explode(F.array(*extras)).alias("file_path"),
                        F.lit(100).cast("bigint").alias("file_size"),
                        F.col("modified_at"),
                        F.lit(None).cast("string").alias("content_md5"),
                        F.lit(None).cast("string").alias("probe_json"),
                        F.lit(None).cast("string").alias("exif_json"),
                        F.lit(None).cast("int").alias("width"),
                        F.lit(None).cast("int").alias("height"),
                        F.lit(None).cast("string").alias("image_format"),
                        F.lit(None).cast("string").alias("error_kind"),
                        F.lit(None).cast("string").alias("error_text"))
    return existing.unionByName(new).unionByName(noise)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The on-disk inventory as a stored table (landed once per source version)."""
    return landed(spark, "inventory", [_src(sf_dir, "documents")],
                  lambda: inventory_view(spark, sf_dir), RULES_VERSION)


def inventory_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist on disk: catalog rows with id % 9 <> 0, plus the ``_jpg.jpg``
    output of every fifth RAW file (so that skip-existing has work to do)."""
    cat = media_files(spark, sf_dir)
    kept = cat.where(F.col("id") % 9 != 0).select("file_path", "file_size", "modified_at")
    raw_ext = F.lower(P.extension(F.col("file_path")))
    outputs = (cat.where((F.col("id") % 5 == 0) & raw_ext.isin(".dng", ".cr2", ".nef"))
               .select(F.concat(P.dirname(F.col("file_path")), F.lit("/"),
                                P.stem(F.col("file_path")), F.lit("_jpg.jpg")).alias("file_path"),
                       (F.col("file_size") * 3 / 10).cast("bigint").alias("file_size"),
                       "modified_at"))
    return kept.unionByName(outputs)


def file_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a hand-edited file list: every catalog path, padded with
    whitespace, interleaved with a comment line and a blank line per entry."""
    cat = media_files(spark, sf_dir)
    lines = F.array(
        F.concat(F.lit("# "), F.col("file_name")),
        F.concat(F.lit("  "), F.col("file_path"), F.lit("\t")),
        F.lit("   "),
    )
    return cat.select(F.explode(lines).alias("value"))


def directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory listing as a stored table (landed once per source version)."""
    return landed(spark, "directory_entries", [_src(sf_dir, "documents")],
                  lambda: directory_entries_view(spark, sf_dir), RULES_VERSION)


def directory_entries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories on disk for the empty-directory plan: every ancestor of every
    catalog path (below the root ``/library``), plus ``{dir}/empty{id}`` for id % 50 = 0."""
    cat = media_files(spark, sf_dir)
    anc = cat.select(F.explode(P.ancestors(P.dirname(F.col("file_path")))).alias("dir_path"))
    empty = (cat.where(F.col("id") % 50 == 0)
             .select(F.concat(P.dirname(F.col("file_path")), F.lit("/empty"), F.col("id"))
                     .alias("dir_path")))
    return anc.unionByName(empty).distinct()


# --- assets of the photo server, from events --------------------------------------

def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset records as a stored table (landed once per source version)."""
    return landed(spark, "assets", [_src(sf_dir, "events")],
                  lambda: assets_view(spark, sf_dir), RULES_VERSION)


def assets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset records (one per event), schema ``schema.ASSET_SCHEMA`` plus ``album``."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    mm = F.lpad((F.lit(1) + e % 13).cast("string"), 2, "0")
    dd = F.lpad((F.lit(1) + e % 31).cast("string"), 2, "0")
    iso = D.iso_with_offset("ts")
    name = (F.when(e % 4 == 0, F.concat(F.lit("IMG_2018"), mm, dd, F.lit("_213006.jpg")))
            .when(e % 4 == 1, F.concat(F.lit("2018-"), mm, F.lit("-"), dd, F.lit(" 21-30-06.JPG")))
            .when(e % 4 == 2, F.concat(F.lit("2021-"), mm, F.lit("-"), dd, F.lit("T12:22:19.mp4")))
            .otherwise(F.concat(F.lit("DSC_"), e, F.lit(".jpg"))))
    sizes_w = F.array(*[F.lit(v) for v in (1179, 2556, 1185, 1920, 1290)])
    sizes_h = F.array(*[F.lit(v) for v in (2556, 1179, 2550, 1080, 2796)])
    pick = (e % 5).cast("int") + 1
    width = F.when(e % 11 == 0, F.lit(None).cast("int")).otherwise(F.element_at(sizes_w, pick))
    height = F.when(e % 11 == 0, F.lit(None).cast("int")).otherwise(F.element_at(sizes_h, pick))
    dto = (F.when(e % 13 == 0, F.lit(None).cast("string"))
           .when(e % 29 == 0, F.lit("n/a"))
           .when(e % 3 == 0, F.concat(F.lit("2025"), F.substring(iso, 5, 100)))
           .otherwise(iso))
    return ev.select(
        e.cast("string").alias("id"),
        F.when(e % 10 < 8, "IMAGE").otherwise("VIDEO").alias("type"),
        (e % 23 == 0).alias("isTrashed"),
        name.alias("originalFileName"),
        F.struct(width.alias("exifImageWidth"), height.alias("exifImageHeight"),
                 dto.alias("dateTimeOriginal")).alias("exifInfo"),
        F.col("event_type").alias("album"),
    )


def asset_lines_path(spark: SparkSession, sf_dir: str) -> str:
    """The assets as JSON lines in a text folder; some are followed by a bad line (e modulo 50: 7 the record
    broken off in the middle, 8 a width that is no number, 9 no object, 10 no id)."""
    def write(folder: str) -> None:
        a = assets(spark, sf_dir)
        e, line = F.col("id").cast("long") % 50, F.to_json(F.struct(
            "id", "type", "isTrashed", "originalFileName", "exifInfo"))
        bad = (F.when(e == 7, F.substring(line, 1, 30))
               .when(e == 8, F.concat(F.lit('{"id":"'), "id", F.lit('","exifInfo":{"exifImageWidth":"wide"}}')))
               .when(e == 9, F.lit("proxy error")).when(e == 10, F.lit('{"type":"IMAGE"}')))
        both = F.array_compact(F.array(line, bad))
        a.select(F.explode(both).alias("value")).write.mode("overwrite").text(folder)
    return landed_path(spark, "asset-lines", [_src(sf_dir, "events")], write, RULES_VERSION)


def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album membership as rows (album id, album name, asset id) — the scalable form."""
    a = assets(spark, sf_dir)
    return a.select(F.concat(F.lit("album-"), F.col("album")).alias("album_id"),
                    F.col("album").alias("albumName"), F.col("id").alias("asset_id"))


def shared_name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album membership where three albums share each name; asset i is in the one numbered i modulo 3."""
    number = (F.col("asset_id").cast("long") % 3).cast("string")
    return album_members(spark, sf_dir).withColumn("album_id", F.concat("album_id", F.lit("-"), number))


def shared_name_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of those albums: of each name the one with the largest number comes first."""
    return (shared_name_members(spark, sf_dir).select("album_id", "albumName").distinct()
            .withColumn("ordinal", -F.substring_index("album_id", "-", -1).cast("long")))


def crowded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's files under a few names: each in a folder of its own below ``in``, named by id modulo
    97, but for every 89th, which lies in the library itself under a numbered form of such a name."""
    row, ext = F.col("id"), P.extension(F.col("file_path"))
    name = F.concat(F.lit("photo"), (row % 97).cast("string"))
    return media_files(spark, sf_dir).select(
        F.when(row % 89 == 0, F.concat(F.lit("/library/"), name, F.lit("_"), (row % 5 + 1).cast("string"), ext))
        .otherwise(F.concat(F.lit("/library/in/"), row.cast("string"), F.lit("/"), name, ext)).alias("file_path"),
        "file_size")
