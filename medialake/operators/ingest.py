"""Catalog building from scan records.

A scan record is what a file walker and the probe tools report for one file
(``schema.SCAN_RECORDS_SCHEMA``): path, size, mtime, content MD5, the video probe
JSON, the EXIF JSON, image size/format and an error kind.  Building the catalog is:

  inventory (A1) -> freshness anti join (J2) -> parse + classify (A7/A8, C11/C12)
  -> upsert (B1) -> per-file status and counters (D12)

All steps are narrow projections except J2 and B1, which shuffle once on
``file_path`` (a unique key, so no hot key can form there).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import dates as D
from ..functions import paths as P
from ..session import cut_lineage
from ..sources.landing import task_filesystem


def _root_prefix(root: str) -> str:
    return root.rstrip("/") + "/"


def media_inventory(scan: DataFrame, root: str, pattern: str | None = None) -> DataFrame:
    """A1 + C3 + C13 + C2: scan records with an ``inventory_status``:

    ``hidden_dir`` (some directory below the root starts with ``.``; not counted by
    the reference), ``nonmedia`` (dot file or unsupported extension), ``pattern``
    (supported but without the substring) or ``media`` (kept).
    """
    prefix = _root_prefix(root)
    rel = F.when(F.col("file_path").startswith(prefix),
                 F.substr(F.col("file_path"), F.lit(len(prefix) + 1))) \
        .otherwise(F.col("file_path"))
    rel_dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    hidden_dir = F.exists(rel_dirs, lambda c: c.startswith("."))
    name = P.basename(F.col("file_path"))
    ext = P.lower_extension(F.col("file_path"))
    status = (F.when(hidden_dir, F.lit("hidden_dir"))
              .when(name.startswith(".") | ~ext.isin(*S.SUPPORTED_EXTENSIONS), F.lit("nonmedia")))
    if pattern:
        status = status.when(~F.col("file_path").contains(F.lit(pattern)), F.lit("pattern"))
    return scan.withColumn("inventory_status", status.otherwise(F.lit("media")))


def inventory_counts(inv: DataFrame) -> DataFrame:
    """A1 counters in one aggregate."""
    s = F.col("inventory_status")
    return inv.agg(F.count_if(s == "media").alias("media_files"),
                   F.count_if(s == "nonmedia").alias("skipped_nonmedia"),
                   F.count_if(s == "pattern").alias("skipped_pattern"))


def content_hash(files: DataFrame, content_col: str = "content") -> DataFrame:
    """A2: MD5 hex of the content (a binary or text column)."""
    return files.withColumn("file_hash", F.md5(F.col(content_col).cast("binary")))


def _md5(path: str, chunk_bytes: int) -> str | None:
    fs, inner = task_filesystem(path)
    md5 = hashlib.md5()
    try:
        with fs.open_input_stream(inner) as fh:
            while chunk := fh.read(chunk_bytes):
                md5.update(chunk)
    except OSError:
        return None
    return md5.hexdigest()


def hash_files(files: DataFrame, path_col: str = "file_path", chunk_bytes: int = 8 << 20) -> DataFrame:
    """A2 over the files that a table names: ``files`` plus ``file_hash``, the MD5 hex of the bytes of the
    file (a path or URI that pyarrow can open on the executors), NULL where there is none or it cannot be
    read.  Files of any size are read in chunks of ``chunk_bytes``; nothing is listed."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [path and _md5(path, chunk_bytes) for path in batch.column(path_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())],
                                             [*batch.schema.names, "file_hash"])

    return files.mapInArrow(hashed, T.StructType([*files.schema.fields, T.StructField("file_hash", T.StringType())]))


def read_binary_hashes(spark, root: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """A2 over the files below ``root`` (a local, HDFS or object-store URI).

    ``binaryFile`` only lists the files (its ``content`` column, which must fit in memory, is
    not read) and packs them into tasks by their size.  It lists neither empty files nor those whose names
    begin with ``_`` or ``.``; ``hash_files`` over an inventory has no such exception.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path"))
    return hash_files(files, "path", chunk_bytes).select(
        F.regexp_replace("path", "^file:", "").alias("file_path"), "file_hash")


def with_file_hashes(scan: DataFrame, spark, root: str) -> DataFrame:
    """A2 as the reference computes it: MD5 of the bytes; the scan record's ``content_md5``
    only for paths that are not below ``root`` or cannot be read."""
    below = F.when(F.startswith("file_path", F.lit(root.rstrip("/") + "/")), F.col("file_path"))
    hashed = hash_files(scan.withColumn("_file", below), "_file")
    return (hashed.withColumn("content_md5", F.coalesce("file_hash", "content_md5"))
            .drop("_file", "file_hash"))


def incremental_skip(scan: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Drop a scanned file when the catalog already holds that path with
    ``modified_at >= mtime``; ``force`` keeps everything."""
    if force:
        return scan
    cat = catalog.select(F.col("file_path").alias("_cp"), F.col("modified_at").alias("_cm"))
    cond = (F.col("file_path") == F.col("_cp")) & (F.col("_cm") >= F.col("modified_at"))
    return scan.join(cat, cond, "left_anti")


# --- parsing and classification ---------------------------------------------------

def parse_probe(probe_json: Column) -> Column:
    return F.from_json(probe_json, S.PROBE_SCHEMA)


def video_columns(doc: Column) -> dict[str, Column]:
    """Typed video metadata from a parsed probe document (first ``video``
    stream).  Parse once (``parse_probe``) into a column and pass that column, so
    the JSON is not re-parsed for every field."""
    vs = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), 0)
    fmt = doc["format"]
    dur_txt = F.coalesce(fmt["duration"], F.lit("0"))
    br_txt = F.coalesce(fmt["bit_rate"], F.lit("0"))
    return {
        "_doc_ok": doc.isNotNull(),
        "_has_video": vs.isNotNull(),
        "_dur_txt": dur_txt,
        "_br_txt": br_txt,
        "duration": dur_txt.try_cast("double"),
        "width": F.coalesce(vs["width"], F.lit(0)).cast("int"),
        "height": F.coalesce(vs["height"], F.lit(0)).cast("int"),
        "codec_name": F.coalesce(vs["codec_name"], F.lit("")),
        "codec_long_name": F.coalesce(vs["codec_long_name"], F.lit("")),
        "bit_rate": br_txt.try_cast("bigint"),
        "format_name": F.coalesce(fmt["format_name"], F.lit("")),
        "format_long_name": F.coalesce(fmt["format_long_name"], F.lit("")),
        "frame_rate": D.frame_rate(vs["r_frame_rate"]),
        "creation_date": D.iso_creation_time(fmt["tags"]["creation_time"]),
    }


def exif_date(exif_json: Column) -> Column:
    """Creation date from the EXIF JSON."""
    return D.exif_creation_date(F.from_json(exif_json, S.EXIF_SCHEMA))


def _critical(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    cond = None
    for phrase in S.CRITICAL_IMAGE_ERRORS:
        c = low.contains(F.lit(phrase))
        cond = c if cond is None else (cond | c)
    return cond


_VIDEO_FIELDS = ["duration", "width", "height", "codec_name", "codec_long_name", "bit_rate",
                 "format_name", "format_long_name", "frame_rate", "creation_date"]


def analyze(records: DataFrame, skip_hash: bool = False, now: str | None = None) -> DataFrame:
    """C11 + C12 + A7 + A8 + A2: scan records -> catalog rows (without ``id``) plus
    ``outcome`` (``ok`` / ``corrupted`` / ``error``).

    Staged projections: the JSON documents are parsed once, the video fields and
    the error flags computed once, and only then combined (Catalyst keeps the
    stages apart because they hold non-cheap expressions used several times).
    ``now`` fixes ``analyzed_at`` (``yyyy-MM-dd HH:mm:ss``) for deterministic runs.
    """
    ext = P.lower_extension(F.col("file_path"))
    parsed = records.select(
        "*", ext.alias("_ext"), parse_probe(F.col("probe_json")).alias("_doc"),
        D.exif_creation_date(F.from_json(F.col("exif_json"), S.EXIF_SCHEMA)).alias("_exif_date"))
    v = video_columns(F.col("_doc"))
    kind = F.col("error_kind")
    stage2 = parsed.select(
        "*",
        F.col("_ext").isin(*S.VIDEO_EXTENSIONS).alias("_is_video"),
        F.col("_ext").isin(*S.RAW_EXTENSIONS).alias("_is_raw"),
        F.col("_ext").isin(*S.IMAGE_EXTENSIONS).alias("_is_image"),
        *[v[c].alias("_v_" + c) for c in _VIDEO_FIELDS],
        v["_doc_ok"].alias("_doc_ok"), v["_has_video"].alias("_has_video"),
        v["_dur_txt"].alias("_dur_txt"), v["_br_txt"].alias("_br_txt"),
        F.coalesce(kind.isin(*S.IMAGE_ERROR_KINDS), F.lit(False)).alias("_img_err"),
        F.coalesce(kind == "image_error_exif_failed", F.lit(False)).alias("_exif_failed"),
        _critical(F.col("error_text")).alias("_critical_text"))
    text = F.coalesce(F.col("error_text"), F.lit(""))
    c = F.col
    pil_fail = c("_img_err") & ~c("_is_raw")
    critical = pil_fail & c("_critical_text")
    stage3 = stage2.select(
        "*",
        (F.when(kind == "corrupted", F.concat(F.lit("ffprobe error: "), text))
         .when(kind == "timeout", F.lit("ffprobe timeout (30s)"))
         .when(kind == "probe_failed", F.concat(F.lit("Subprocess error: "), text))
         .when(~c("_doc_ok"), F.lit("JSON decode error"))
         .when(~c("_has_video"), F.lit("No video stream found in file"))).alias("_vid_msg"),
        (F.when(c("_v_duration").isNull(),
                F.format_string("Processing error: could not convert string to float: '%s'",
                                c("_dur_txt")))
         .when(c("_v_bit_rate").isNull(),
               F.format_string("Processing error: invalid literal for int() with base 10: '%s'",
                               c("_br_txt")))).alias("_vid_err"),
        (F.when(critical, F.concat(F.lit("Critical image corruption: "), text))
         .when(pil_fail & c("_exif_failed"),
               F.concat(F.lit("PIL error (continuing with exiftool): "), text,
                        F.lit(" | Exiftool also failed")))
         .when(pil_fail, F.concat(F.lit("PIL error (continuing with exiftool): "), text)))
        .alias("_img_msg"),
        (critical | (pil_fail & c("_exif_failed"))).alias("_img_corrupt"),
        (~c("_is_raw") & ~pil_fail).alias("_img_ok_dims"),
        (~c("_is_video") & ~c("_is_image")).alias("_unsupported"))
    corrupted = (F.when(c("_unsupported"), F.lit(True))
                 .when(c("_is_video"), c("_vid_msg").isNotNull() | c("_vid_err").isNotNull())
                 .otherwise(c("_img_corrupt")))
    stage4 = stage3.select(
        "*", corrupted.alias("_corrupted"),
        (F.when(c("_unsupported"), F.concat(F.lit("Processing error: Unsupported file type: "),
                                            c("_ext")))
         .when(c("_is_video"), F.coalesce(c("_vid_msg"), c("_vid_err")))
         .otherwise(c("_img_msg"))).alias("_message"),
        (F.when(c("_unsupported") | (c("_is_video") & c("_vid_msg").isNull()
                                     & c("_vid_err").isNotNull()), F.lit("error"))
         .when(corrupted, F.lit("corrupted")).otherwise(F.lit("ok"))).alias("_outcome"))
    video_ok = c("_is_video") & ~c("_corrupted")
    image_ok = c("_is_image") & ~c("_img_corrupt") & ~c("_unsupported")
    ext_name = F.substr(c("_ext"), F.lit(2))
    has_fmt = c("image_format").isNotNull() & c("_img_ok_dims")
    img_format = F.when(has_fmt, F.lower("image_format")).otherwise(ext_name)
    img_long = (F.when(c("_is_raw"), F.concat(F.upper(ext_name), F.lit(" RAW Image")))
                .when(has_fmt, F.concat(c("image_format"), F.lit(" Image")))
                .otherwise(F.concat(F.upper(ext_name), F.lit(" Image"))))
    analyzed_at = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()

    def vcol(name):
        return F.when(video_ok, c("_v_" + name))

    return stage4.select(
        "file_path",
        P.basename(c("file_path")).alias("file_name"),
        "file_size",
        (F.lit(None).cast("string") if skip_hash else
         F.when(~c("_corrupted"), c("content_md5"))).alias("file_hash"),
        F.when(c("_is_video"), F.lit("video")).otherwise(F.lit("image")).alias("media_type"),
        F.when(video_ok, c("_v_creation_date")).when(image_ok, c("_exif_date")).alias("creation_date"),
        vcol("duration").alias("duration"),
        F.when(video_ok, c("_v_width")).when(image_ok & c("_img_ok_dims"), c("width")).alias("width"),
        F.when(video_ok, c("_v_height")).when(image_ok & c("_img_ok_dims"), c("height")).alias("height"),
        vcol("codec_name").alias("codec_name"),
        vcol("codec_long_name").alias("codec_long_name"),
        vcol("bit_rate").alias("bit_rate"),
        vcol("frame_rate").alias("frame_rate"),
        # Images keep the extension-derived format even when corrupted (the
        # reference fills it in before decoding); corrupted videos keep nothing.
        F.when(video_ok, c("_v_format_name")).when(c("_is_image"), img_format).alias("format_name"),
        F.when(video_ok, c("_v_format_long_name")).when(c("_is_image"), img_long)
        .alias("format_long_name"),
        c("_corrupted").alias("is_corrupted"),
        c("_message").alias("error_message"),
        analyzed_at.alias("analyzed_at"),
        "modified_at",
        c("_outcome").alias("outcome"),
    )


def newest_per_path(rows: DataFrame, order_col: str = "modified_at") -> DataFrame:
    """Within one batch keep the newest row per path (partial aggregation of one struct;
    a path repeated many times costs one row per map task).  A NULL ``order_col`` is older
    than any other; ties go to the greatest of the remaining columns, in their order."""
    cols = [c for c in rows.columns if c not in ("file_path", order_col)]
    best = F.max(F.struct(order_col, *cols))
    return rows.groupBy("file_path").agg(best.alias("_r")).select(
        *[F.col(c) if c == "file_path" else F.col("_r")[c].alias(c) for c in rows.columns])


def upsert(catalog: DataFrame, new_rows: DataFrame) -> DataFrame:
    """B1: insert-or-replace by ``file_path``; new rows always win, and of several new rows
    for one path the newest (``newest_per_path``)."""
    cols = [c for c in S.MEDIA_COLUMNS if c != "id"]
    new = newest_per_path(new_rows.select(*cols))
    kept = catalog.select(*cols).join(new.select("file_path"), "file_path", "left_anti")
    merged = kept.unionByName(new)
    # Surrogate id: stable per path (the reference's autoincrement changes on replace).
    return merged.select(F.xxhash64("file_path").alias("id"), *cols)


def fresh_rows(catalog: DataFrame, scan: DataFrame, root: str, pattern: str | None = None,
               force: bool = False, skip_hash: bool = False, now: str | None = None,
               max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(inventory, stored rows to upsert): the scanned media files, and the analyzed rows of those
    that ``catalog`` does not hold as new.  ``catalog`` need hold no other paths than the scan's."""
    inv = media_inventory(scan, root, pattern).where(F.col("inventory_status") == "media")
    if max_files:
        # the first n files found (by path; the walker's order is unspecified).
        inv = inv.orderBy("file_path").limit(max_files)
    todo = incremental_skip(inv, catalog, force)
    # The parsed rows feed both the upsert and the status table: write them once.
    return inv, cut_lineage(analyze(newest_per_path(todo), skip_hash=skip_hash, now=now), "analyzed")


def build_catalog(catalog: DataFrame, scan: DataFrame, root: str, **how) -> tuple[DataFrame, DataFrame]:
    """(new catalog, per-file status).  Status is ``skipped`` for files the
    freshness test drops, else the analysis outcome (ok / corrupted / error).  ``how``: see ``fresh_rows``.

    The new catalog is the whole of it; ``sinks.bucketed_catalog`` stores the same rows
    without writing the untouched ones again."""
    inv, rows = fresh_rows(catalog, scan, root, **how)
    new_catalog = upsert(catalog, rows)
    status = (inv.select("file_path").distinct()
              .join(rows.select("file_path", "outcome"), "file_path", "left")
              .select("file_path", F.coalesce(F.col("outcome"), F.lit("skipped")).alias("status")))
    return new_catalog, status


def status_counters(status: DataFrame) -> DataFrame:
    """Processed / skipped / corrupted / errors, one row.  As in the reference,
    corrupted files count as processed too."""
    s = F.col("status")
    return status.agg(F.count_if(s.isin("ok", "corrupted")).alias("processed"),
                      F.count_if(s == "skipped").alias("skipped"),
                      F.count_if(s == "corrupted").alias("corrupted"),
                      F.count_if(s == "error").alias("errors"))
