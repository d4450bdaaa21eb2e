"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the catalog-shaped views of
``sources.fixtures``) over their whole extent; the matching DuckDB statement is
in ``medialake.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from . import schema as S
from .functions import dates as D
from .functions import formats as FM
from .functions import media as MD
from .functions import paths as P
from .operators import assets as A
from .operators import directories as dr
from .operators import duplicates as dup
from .operators import ingest as I
from .operators import reports as rp
from .plans import common as PC
from .plans import conversion as CV
from .plans import creation_time as K6
from .plans import deletion as K1
from .plans import empty_dirs as K3
from .plans import flatten as K2
from .plans import name_dates as K7
from .plans import resolution_album as K8
from .session import shared_path
from .sinks import bucketed_catalog as BC
from .sinks import text as TX
from .sources import fixtures as fx
from .sources import lists as L

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- duplicates ------------------------------------------------------------------

PAT = list(oracle.DUP_PATTERNS)


@register("duplicate_groups")
def q_duplicate_groups(spark, sf):
    return dup.duplicate_groups(fx.media_files(spark, sf))


@register("original_vs_copies")
def q_original_vs_copies(spark, sf):
    return dup.classify_duplicates(fx.media_files(spark, sf), PAT).select(
        "file_hash", "file_path", "file_size", "matches_pattern", "file_count", "is_original")


@register("copy_and_group_numbers")
def q_copy_and_group_numbers(spark, sf):
    return dup.duplicate_report(fx.media_files(spark, sf), PAT).select(
        "file_hash", "file_path", "copy_no", F.col("group_no").alias("group_no_all"),
        "file_count")


@register("duplicate_delete_list")
def q_duplicate_delete_list(spark, sf):
    return dup.copies_to_delete(fx.media_files(spark, sf), PAT)


@register("wasted_space")
def q_wasted_space(spark, sf):
    return dup.wasted_space(fx.media_files(spark, sf), PAT)


# --- catalog reports ---------------------------------------------------------------


def _cat(spark, sf):
    return fx.media_files(spark, sf)


_SIMPLE = {
    "raw_files": rp.raw_files,
    "raw_by_extension": rp.raw_by_extension,
    "outdated_videos": lambda c: rp.outdated_videos(c).drop(),
    "outdated_by_codec_format": rp.outdated_tags,
    "corrupted_files": rp.corrupted_files,
    "corrupted_by_type": rp.corrupted_by_type,
    "high_bitrate_export": lambda c: rp.high_bitrate_export(c, 15, 50),
    "export_summary": lambda c: rp.export_summary(rp.outdated_videos(c)),
    "library_stats": rp.library_stats,
    "group_by_codec": rp.codec_counts,
    "group_by_resolution": rp.resolution_counts,
    "top_codecs": lambda c: rp.top_codecs(c, 10),
    "top_resolutions": lambda c: rp.top_resolutions(c, 10),
    "largest_files": lambda c: rp.largest_files(c, 20),
    "high_bitrate_top": lambda c: rp.high_bitrate_top(c, 10, 20),
    "longest_files": lambda c: rp.longest_files(c, 20),
    "default_report": lambda c: rp.default_report(c, 10, 20),
    "max_files": lambda c: rp.first_files(c, 25),
    "suffix_with_original": lambda c: rp.suffix_with_original(c, "_720p"),
    "catalog_scan": lambda c: c.where("NOT is_corrupted").select(
        "file_path", "file_size", "media_type"),
    "catalog_paths": lambda c: c.select("file_path").distinct(),
    "catalog_nonempty_guard": lambda c: c.agg(F.count(F.lit(1)).alias("total_records"))
        .withColumn("has_records", F.col("total_records") > 0),
}

for _name, _fn in _SIMPLE.items():
    register(_name)(lambda spark, sf, _fn=_fn: _fn(_cat(spark, sf)))


# --- directory rollup -----------------------------------------------------------


def _tree(spark, sf):
    return dr.directory_tree(_cat(spark, sf))


register("dir_direct_stats")(lambda spark, sf: dr.direct_stats(_cat(spark, sf)))
register("dir_rollup")(_tree)
register("dir_subdir_count")(lambda spark, sf: _tree(spark, sf).where("subdirs_count > 0")
                             .select("dir_path", "subdirs_count"))
register("dir_parent_edges")(lambda spark, sf: _tree(spark, sf).where("parent_path IS NOT NULL")
                             .select("parent_path", "dir_path"))
register("largest_dirs")(lambda spark, sf: dr.largest_dirs(_tree(spark, sf), 5))
@register("tree_preorder")
def q_tree_preorder(spark, sf):
    """F7 + B4 lines with each directory's position in the tree pre-order."""
    from .operators.ranking import global_row_number
    lines = dr.tree_lines(_tree(spark, sf))
    return global_row_number(lines, [F.col("order_key")], "position").drop("order_key", "direct_size")


@register("common_root")
def q_common_root(spark, sf):
    direct = dr.direct_stats(_cat(spark, sf))
    return direct.agg(dr.common_root_expr(direct).alias("root"))


@register("root_directories")
def q_root_directories(spark, sf):
    from .session import cut_lineage
    direct = cut_lineage(dr.direct_stats(_cat(spark, sf)), "dir-direct")
    root = direct.agg(dr.common_root_expr(direct).alias("root")).scalar()
    dirs = direct.where(F.col("dir_path") != root).select("dir_path")
    return dr.root_directories(dirs)


# --- dates and assets -------------------------------------------------------------


register("datetime_from_path")(lambda spark, sf: _cat(spark, sf).select(
    "file_path", D.ts_text(D.datetime_from_path(F.col("file_path"))).alias("path_date")))
register("no_creation_date")(lambda spark, sf: rp.no_creation_date(_cat(spark, sf)))
register("datetime_from_filename")(lambda spark, sf: fx.assets(spark, sf).select(
    "id", "originalFileName",
    D.ts_text(D.datetime_from_filename(F.col("originalFileName"))).alias("name_date")))
register("assets_scan")(lambda spark, sf: A.live_assets(fx.assets(spark, sf), "IMAGE").select("id"))
register("assets_first")(lambda spark, sf: A.live_assets(fx.assets(spark, sf), "IMAGE", limit=100).select("id"))
register("asset_records_scan")(lambda spark, sf: A.live_assets(
    A.read_assets(spark, fx.asset_lines_path(spark, sf)), "IMAGE").select(
        "id", "originalFileName", F.col("exifInfo.exifImageWidth").alias("width"),
        F.col("exifInfo.dateTimeOriginal").alias("dateTimeOriginal")))
register("asset_line_counts")(lambda spark, sf: A.line_counts(
    A.asset_lines(spark, fx.asset_lines_path(spark, sf))))
register("asset_detail")(lambda spark, sf: A.asset_detail(fx.assets(spark, sf)))
register("album_assets")(lambda spark, sf: A.album_assets(
    fx.album_members(spark, sf), fx.assets(spark, sf), "purchase").select("id", "originalFileName"))
register("album_first_assets")(lambda spark, sf: A.album_assets(
    fx.shared_name_members(spark, sf), fx.assets(spark, sf), "purchase",
    albums=fx.shared_name_albums(spark, sf)).select("id", "originalFileName"))
register("resolution_match")(lambda spark, sf: K8.matching_images(
    fx.assets(spark, sf), "1179x2556").where("matches").select("id"))
register("resolution_match_counts")(lambda spark, sf: K8.match_counts(
    fx.assets(spark, sf), "1179x2556"))
register("target_year_filter")(lambda spark, sf: A.target_year_filter(
    fx.assets(spark, sf), 2025).select("id", "exif_year"))
register("date_from_name_plan")(lambda spark, sf: K7.date_from_name_plan(
    fx.album_members(spark, sf), fx.assets(spark, sf), "purchase", 2025))
register("album_by_resolution_plan")(lambda spark, sf: K8.album_plan(
    fx.assets(spark, sf), "1179x2556", "Screenshots"))


# --- ingest -------------------------------------------------------------------------


RUN_CLOCK = oracle.RUN_CLOCK
LIB_ROOT = "/library"


def _scan(spark, sf):
    return fx.scan_records(spark, sf)


def _media_scan(spark, sf):
    return I.media_inventory(_scan(spark, sf), LIB_ROOT).where("inventory_status = 'media'")


register("media_inventory")(lambda spark, sf: I.media_inventory(_scan(spark, sf), LIB_ROOT)
                            .select("file_path", "inventory_status"))
register("inventory_counts")(lambda spark, sf: I.inventory_counts(
    I.media_inventory(_scan(spark, sf), LIB_ROOT, "Camera Uploads")))
@register("file_content_hash")
def _file_content_hash(spark, sf):
    folder = fx.document_files(spark, sf)
    files = fx.media_files(spark, sf).select("file_path", F.concat(
        F.lit(folder + "/"), fx.file_name(F.col("file_path"))).alias("_file"))
    return I.hash_files(files, "_file").select("file_path", "file_hash")


register("content_hash")(lambda spark, sf: I.content_hash(fx.documents_content(spark, sf))
                         .select("file_path", "file_hash"))


@register("probe_json_ingest")
def q_probe_json_ingest(spark, sf):
    cols = ["duration", "width", "height", "codec_name", "codec_long_name", "bit_rate",
            "format_name", "format_long_name", "frame_rate", "creation_date"]
    docs = _scan(spark, sf).where(F.col("probe_json").isNotNull()).select(
        "file_path", I.parse_probe(F.col("probe_json")).alias("doc"))
    v = I.video_columns(F.col("doc"))
    return docs.select("file_path", *[v[c].alias(c) for c in cols])


register("exif_json_ingest")(lambda spark, sf: _scan(spark, sf).where(
    F.col("exif_json").isNotNull()).select("file_path", I.exif_date(F.col("exif_json")).alias(
        "creation_date")))
register("corruption_classes")(lambda spark, sf: I.analyze(_media_scan(spark, sf), now=RUN_CLOCK)
                               .where(F.col("error_message").isNotNull())
                               .select("file_path", "is_corrupted", "error_message"))
register("incremental_skip")(lambda spark, sf: I.incremental_skip(
    _media_scan(spark, sf), _cat(spark, sf)).select("file_path"))

_CATALOG_OUT = [c for c in S.MEDIA_COLUMNS if c != "id"]


@register("incremental_catalog_build")
def q_incremental_catalog_build(spark, sf):
    new_catalog, _ = I.build_catalog(_cat(spark, sf), _scan(spark, sf), LIB_ROOT, now=RUN_CLOCK)
    return new_catalog.select(*_CATALOG_OUT)


def _stored_catalog(spark, sf):
    """A new bucketed catalog in the shared folder that holds the catalog as version 0."""
    base = shared_path(spark, "catalog-" + uuid.uuid4().hex)
    BC.upsert(base, _cat(spark, sf), buckets=16)
    return base


@register("catalog_upsert")
def q_catalog_upsert(spark, sf):
    """B1 through the bucketed store: the catalog is version 0, the batch version 1."""
    base = _stored_catalog(spark, sf)
    BC.upsert(base, I.analyze(_media_scan(spark, sf), now=RUN_CLOCK))
    return BC.read(spark, base).select(*_CATALOG_OUT)


@register("bucketed_catalog_build")
def q_bucketed_catalog_build(spark, sf):
    """K10 through the bucketed store: the scan meets the touched buckets only."""
    base, scan = _stored_catalog(spark, sf), _scan(spark, sf)
    _, rows = I.fresh_rows(BC.read_touched(spark, base, scan), scan, LIB_ROOT, now=RUN_CLOCK)
    BC.upsert(base, rows)
    return BC.read(spark, base).select(*_CATALOG_OUT)


@register("status_counters")
def q_status_counters(spark, sf):
    _, status = I.build_catalog(_cat(spark, sf), _scan(spark, sf), LIB_ROOT, now=RUN_CLOCK)
    return I.status_counters(status)


@register("stream_catalog_upsert")
def q_stream_catalog_upsert(spark, sf):
    """S1 end to end: land the scan records as files, stream them into a bucketed
    catalog seeded with the current catalog, return the final version."""
    from .streaming import catalog_stream as ST
    run = shared_path(spark, "stream-" + uuid.uuid4().hex)
    records_dir, base, ckpt = f"{run}/records", _stored_catalog(spark, sf), f"{run}/checkpoint"
    _scan(spark, sf).repartition(4).write.parquet(records_dir)
    q = ST.start(spark, records_dir, base, ckpt, LIB_ROOT, now=RUN_CLOCK, max_files_per_trigger=1)
    q.awaitTermination()
    return BC.read(spark, base).select(*_CATALOG_OUT)


# --- plans ----------------------------------------------------------------------------


def _listed(spark, sf):
    return L.parse_file_list(fx.file_list_lines(spark, sf))


def _listed_raw(spark, sf):
    """The deletion and directory-list readers strip and skip comments but do not
    NFC-normalise."""
    return L.parse_file_list(fx.file_list_lines(spark, sf), normalize=False)


def _inv(spark, sf):
    return fx.inventory(spark, sf)


register("file_list_scan")(_listed)
register("missing_files")(lambda spark, sf: PC.split_existing(_listed(spark, sf), _inv(spark, sf))[1])
register("directory_list_union")(lambda spark, sf: _listed_raw(spark, sf).select(
    P.dirname(F.col("file_path")).alias("dir_path")).unionByName(
    spark.range(1).select(F.lit(LIB_ROOT).alias("dir_path"))))
register("deletion_plan")(lambda spark, sf: K1.deletion_plan(
    _listed_raw(spark, sf), _inv(spark, sf), "Camera Uploads"))
register("deletion_totals")(lambda spark, sf: K1.deletion_totals(K1.deletion_plan(
    _listed_raw(spark, sf), _inv(spark, sf), "Camera Uploads")))
register("empty_dirs")(lambda spark, sf: K3.empty_directories(
    fx.directory_entries(spark, sf), _cat(spark, sf), LIB_ROOT))


def _encode(spark, sf):
    return CV.encode_plan(_listed(spark, sf), _inv(spark, sf), _cat(spark, sf), "_encoded")


def _raw_plan(spark, sf):
    images = _cat(spark, sf).where("media_type = 'image' AND NOT is_corrupted").select("file_path")
    return CV.raw_convert_plan(images, _inv(spark, sf), _cat(spark, sf), "_jpg")


register("encode_plan")(lambda spark, sf: _encode(spark, sf).select(
    "input_path", "output_path", "status", "original_size", "estimated_size", "output_exists"))
register("encode_totals")(lambda spark, sf: PC.conversion_totals(_encode(spark, sf), "encode"))
register("raw_convert_plan")(lambda spark, sf: _raw_plan(spark, sf).select(
    "input_path", "output_path", "status", "original_size", "estimated_size", "output_exists"))
register("raw_convert_totals")(lambda spark, sf: PC.conversion_totals(_raw_plan(spark, sf), "convert"))
register("conversion_log")(lambda spark, sf: TX.conversion_log(_raw_plan(spark, sf)).select(
    "input_path", "output_path", "message"))


def _suggestions(spark, sf):
    """B2 -> A6 round trip: the missing-date export is written as a suggestion list
    into the shared folder and parsed back with its line numbers."""
    import uuid
    rows = rp.no_creation_date(_cat(spark, sf)).join(
        _cat(spark, sf).select("file_path", "modified_at"), "file_path")
    out = shared_path(spark, "exports", "no-metadata-" + uuid.uuid4().hex)
    TX.write_blocks(TX.export_blocks(rows, "files without creation_date metadata",
                                     with_dates=True), out)
    return L.read_suggestion_list(spark, out)


register("suggestion_list_scan")(lambda spark, sf: _suggestions(spark, sf).select(
    "file_path", D.ts_text(F.col("suggested")).alias("suggested")))


def _k6(spark, sf):
    return K6.creation_time_plan(_suggestions(spark, sf), _inv(spark, sf), _cat(spark, sf))


register("creation_time_plan")(lambda spark, sf: _k6(spark, sf).select(
    "input_path", D.ts_text(F.col("suggested")).alias("suggested"), "status", "method"))
register("creation_time_counters")(lambda spark, sf: K6.creation_time_counters(_k6(spark, sf)))
register("flatten_plan")(lambda spark, sf: K2.flatten_plan(
    _cat(spark, sf).select("file_path", "file_size"), LIB_ROOT,
    fx.directory_entries(spark, sf)).select("source_path", "target_name", "renamed", "target_path"))
register("move_totals")(lambda spark, sf: K2.move_totals(K2.flatten_plan(
    _cat(spark, sf).select("file_path", "file_size"), LIB_ROOT, fx.directory_entries(spark, sf))))
register("flatten_conflicts_plan")(lambda spark, sf: K2.flatten_plan(
    fx.crowded_files(spark, sf), LIB_ROOT).select("source_path", "target_name", "renamed", "target_path"))
register("flatten_conflicts_totals")(lambda spark, sf: K2.move_totals(K2.flatten_plan(
    fx.crowded_files(spark, sf), LIB_ROOT)))


@register("export_list")
def q_export_list(spark, sf):
    rows = rp.outdated_videos(_cat(spark, sf))
    return TX.export_blocks(rows, "video files with outdated codecs/formats").select(
        "section", "block")


register("format_labels")(lambda spark, sf: _cat(spark, sf).select(
    "file_path", FM.file_size_label(F.col("file_size")).alias("size_label"),
    FM.plan_size_label(F.col("file_size")).alias("plan_size_label"),
    FM.bitrate_label(F.col("bit_rate")).alias("bitrate_label"),
    FM.duration_label(F.col("duration")).alias("duration_label"),
    FM.short_hash(F.col("file_hash")).alias("short_hash"),
    FM.short_codec(F.col("codec_name"), 7).alias("short_codec"),
    FM.status_label(F.col("is_corrupted")).alias("status")))


# --- remaining inventory items ------------------------------------------------------------


register("media_type_of")(lambda spark, sf: _scan(spark, sf).select(
    "file_path", MD.media_kind(F.col("file_path")).alias("kind")))
register("adhoc_filters")(lambda spark, sf: rp.adhoc_filter(
    _cat(spark, sf), min_size=1 << 20, max_size=40 << 20, media_type="image",
    date_from="2022-06-01", date_to="2023-01-01", pattern="photos").select(
    "file_path", "file_size", "creation_date"))
register("examples_per_group")(lambda spark, sf: rp.examples_per_group(
    rp.raw_files(_cat(spark, sf)).withColumn("extension", P.lower_extension(F.col("file_path"))),
    "extension", 2).select("extension", "example_no", "file_path", "file_size"))
register("examples_overlapping")(lambda spark, sf: _examples(rp.outdated_videos(_cat(spark, sf))))


def _examples(rows):
    """An outdated video under its codec, its container, its type and all of them, three each."""
    return rp.examples_of_groups(rows, {
        "codec": F.when(F.col("codec_name").isin(*S.OUTDATED_CODECS), F.col("codec_name")),
        "format": F.when(F.col("format_name").isin(*S.OUTDATED_FORMATS), F.col("format_name")),
        "type": F.col("media_type"), "all": F.lit("")}, 3, "file_size")


register("depth_order")(lambda spark, sf: rp.depth_order_numbers(
    rp.corrupted_files(_cat(spark, sf))).select("position", "file_path"))
register("date_changes")(lambda spark, sf: K7.date_changes(K7.date_from_name_plan(
    fx.album_members(spark, sf), fx.assets(spark, sf), "purchase", 2025)))
register("parse_resolution")(lambda spark, sf: fx.assets(spark, sf).select(
    "id", K8.resolution_column(F.concat_ws("X", F.col("exifInfo.exifImageWidth"),
                                            F.col("exifInfo.exifImageHeight"))).alias("r"))
    .select("id", F.col("r.width").alias("width"), F.col("r.height").alias("height")))
register("format_labels_plans")(lambda spark, sf: _cat(spark, sf).select(
    "file_path", FM.move_size_label(F.col("file_size")).alias("move_size_label"),
    FM.minutes_label(F.col("duration")).alias("minutes_label"),
    FM.encoder_duration_label(F.coalesce(F.col("duration"), F.lit(0.0))).alias("encoder_label"),
    FM.size_severity(F.col("file_size")).alias("severity"),
    FM.bitrate_severity(F.col("bit_rate")).alias("bitrate_severity"),
    FM.duration_severity(F.col("duration")).alias("duration_severity")))


@register("export_duplicates_report")
def q_export_duplicates_report(spark, sf):
    rep = dup.duplicate_report(_cat(spark, sf), PAT)
    return TX.duplicates_report_blocks(rep, PAT[0])


@register("export_dir_tree")
def q_export_dir_tree(spark, sf):
    return TX.tree_blocks(dr.tree_lines(_tree(spark, sf))).select("section", "block")


@register("protected_output_check")
def q_protected_output_check(spark, sf):
    """J4 as a table: encode tasks (suffix ``_720p``) over the whole catalog whose
    output path is already a catalogued file -- the rows that make a run abort."""
    tasks = _cat(spark, sf).select(F.col("file_path").alias("input_path"),
                                   P.output_path(F.col("file_path"), "_720p").alias("output_path"))
    return PC.protected_outputs(tasks, _cat(spark, sf))


# --- one query per remaining SURVEY §2 name --------------------------------------------

@register("album_lookup")
def q_album_lookup(spark, sf):
    """The album called 'purchase' (error if absent) with its member count."""
    members = fx.album_members(spark, sf).where(F.col("albumName") == "purchase")
    if members.limit(1).count() == 0:
        raise ValueError("Album 'purchase' not found")
    return members.groupBy("album_id", "albumName").agg(F.count(F.lit(1)).alias("assets"))


@register("path_pattern_filter")
def q_path_pattern_filter(spark, sf):
    """Catalog files before and after the case-sensitive substring filter."""
    cat = _cat(spark, sf)
    return cat.agg(F.count(F.lit(1)).alias("before"),
                   F.count_if(F.col("file_path").contains(F.lit("Camera Uploads"))).alias("after"))


register("hidden_filter")(lambda spark, sf: I.media_inventory(_scan(spark, sf), LIB_ROOT).select(
    "file_path", (F.col("inventory_status") == "hidden_dir").alias("in_hidden_dir"),
    P.basename(F.col("file_path")).startswith(".").alias("hidden_file")))
register("supported_media_filter")(lambda spark, sf: _scan(spark, sf).select(
    "file_path", MD.is_supported(F.col("file_path")).alias("supported")))
register("metadata_writable")(lambda spark, sf: _cat(spark, sf).select(
    "file_path", K6.write_method(F.col("file_path")).alias("method")))
register("image_corruption_class")(lambda spark, sf: I.analyze(_media_scan(spark, sf), now=RUN_CLOCK)
                                   .where("media_type = 'image' AND error_message IS NOT NULL")
                                   .select("file_path", "is_corrupted", "error_message"))
register("video_corruption_class")(lambda spark, sf: I.analyze(_media_scan(spark, sf), now=RUN_CLOCK)
                                   .where("media_type = 'video' AND error_message IS NOT NULL")
                                   .select("file_path", "is_corrupted", "error_message"))
register("listed_existing_split")(lambda spark, sf: PC.mark_existing(
    _listed(spark, sf), _inv(spark, sf)).select("file_path", "exists", "original_size"))
register("has_creation_metadata")(lambda spark, sf: _listed(spark, sf).join(
    _cat(spark, sf).select("file_path", F.col("creation_date").isNotNull().alias("has_metadata")),
    "file_path", "left").select("file_path", F.coalesce("has_metadata", F.lit(False))
                                .alias("has_metadata")))
register("duplicate_detail")(lambda spark, sf: rp.with_resolution(
    dup.classify_duplicates(_cat(spark, sf), PAT)).select(
    "file_hash", "file_path", "file_size", "duration", "bit_rate", "resolution", "codec_name"))
