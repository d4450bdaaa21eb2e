"""Catalog reports.

Each report is one scan of the catalog with pushed-down predicates; statistics are
single aggregates with conditional counts (the reference runs one SQL per number);
top-k lists plan as TakeOrderedAndProject (no full sort, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import formats as FM
from ..functions import paths as P
from .ranking import rank_top_k

REPORT_COLUMNS = ["file_path", "file_name", "file_size", "media_type", "duration",
                  "bit_rate", "resolution", "codec_name"]


def valid(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.col("is_corrupted"))


def with_resolution(df: DataFrame) -> DataFrame:
    return df.withColumn("resolution", FM.resolution_label(F.col("width"), F.col("height")))


def report_rows(df: DataFrame) -> DataFrame:
    """The report projection (path, name, size, type, duration, bitrate,
    resolution, codec)."""
    return with_resolution(df).select(*REPORT_COLUMNS)


def depth_order(df: DataFrame, path_col: str = "file_path") -> DataFrame:
    """deepest directory first, then directory, then name (a global sort)."""
    d = P.dirname(F.col(path_col))
    return (df.withColumn("_dir", d)
            .orderBy(P.depth(F.col("_dir")).desc(), F.col("_dir"), P.basename(F.col(path_col)))
            .drop("_dir"))


def path_filter(df: DataFrame, pattern: str | None, path_col: str = "file_path") -> DataFrame:
    """Case-sensitive substring filter (composes with any report)."""
    return df if not pattern else df.where(F.col(path_col).contains(F.lit(pattern)))


# --- filtered lists ---------------------------------------------------------------

def raw_files(catalog: DataFrame) -> DataFrame:
    """C4: valid images whose last four path characters are a RAW extension."""
    tail = F.lower(F.substring(F.col("file_path"), -4, 4))
    return report_rows(valid(catalog).where((F.col("media_type") == "image")
                                            & tail.isin(*S.RAW_EXTENSIONS)))


def raw_by_extension(catalog: DataFrame) -> DataFrame:
    """RAW count and bytes per lower-case extension."""
    return (raw_files(catalog)
            .groupBy(P.lower_extension(F.col("file_path")).alias("extension"))
            .agg(F.count(F.lit(1)).alias("files"),
                 F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size")))


def outdated_videos(catalog: DataFrame) -> DataFrame:
    """Valid videos with an outdated codec or container; ``codec_label`` is the
    reference's ``codec (format: x)``."""
    fmt_old = F.col("format_name").isin(*S.OUTDATED_FORMATS)
    rows = with_resolution(valid(catalog).where(
        (F.col("media_type") == "video")
        & (F.col("codec_name").isin(*S.OUTDATED_CODECS) | fmt_old)))
    label = F.concat(
        F.when(F.col("codec_name").isNull() | (F.col("codec_name") == ""), F.lit("N/A"))
        .otherwise(F.col("codec_name")),
        F.when(fmt_old, F.concat(F.lit(" (format: "), F.col("format_name"), F.lit(")")))
        .otherwise(F.lit("")))
    return rows.select(*REPORT_COLUMNS, "format_name", label.alias("codec_label"))


def outdated_tags(catalog: DataFrame) -> DataFrame:
    """One row per (kind, name) with counts; a file may count under both kinds."""
    rows = outdated_videos(catalog)
    tags = F.array_compact(F.array(
        F.when(F.col("codec_name").isin(*S.OUTDATED_CODECS),
               F.struct(F.lit("codec").alias("kind"), F.col("codec_name").alias("name"))),
        F.when(F.col("format_name").isin(*S.OUTDATED_FORMATS),
               F.struct(F.lit("format").alias("kind"), F.col("format_name").alias("name")))))
    return (rows.select(F.explode(tags).alias("t"), "file_size")
            .groupBy(F.col("t.kind").alias("kind"), F.col("t.name").alias("name"))
            .agg(F.count(F.lit(1)).alias("files"),
                 F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size")))


def corrupted_files(catalog: DataFrame) -> DataFrame:
    """C6."""
    return report_rows(catalog.where(F.col("is_corrupted")))


def corrupted_by_type(catalog: DataFrame) -> DataFrame:
    """D11c."""
    return (corrupted_files(catalog).groupBy("media_type")
            .agg(F.count(F.lit(1)).alias("files"),
                 F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size")))


def high_bitrate_export(catalog: DataFrame, min_mbit: float = 15, min_mb: float = 50) -> DataFrame:
    """Bitrate >= min_mbit * 10^6 and size >= min_mb * 1024^2, valid files."""
    return report_rows(valid(catalog).where(
        F.col("bit_rate").isNotNull() & (F.col("bit_rate") >= F.lit(min_mbit * 1_000_000))
        & F.col("file_size").isNotNull() & (F.col("file_size") >= F.lit(min_mb * 1024 * 1024))))


def export_summary(rows: DataFrame) -> DataFrame:
    """Files, videos, images, bytes and seconds of an exported list."""
    return rows.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.count_if(F.col("media_type") == "image").alias("images"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
    )


# --- statistics ---------------------------------------------------------------------

def library_stats(catalog: DataFrame) -> DataFrame:
    """The reference's eight statistics queries as one aggregate."""
    ok = ~F.col("is_corrupted")
    return catalog.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("media_type") == "video").alias("video_files"),
        F.count_if(F.col("media_type") == "image").alias("image_files"),
        F.count_if(F.col("is_corrupted")).alias("corrupted_files"),
        F.count_if(~F.col("is_corrupted")).alias("valid_files"),
        F.coalesce(F.sum(F.when(ok, F.col("file_size"))), F.lit(0)).cast("bigint")
        .alias("total_size"),
        F.coalesce(F.sum(F.when(ok & (F.col("media_type") == "video"), F.col("duration"))),
                   F.lit(0.0)).alias("total_duration"),
    ).select("*",
             F.round(F.col("total_size") / F.lit(1024.0 ** 3), 6).alias("total_size_gb"),
             F.round(F.col("total_duration") / F.lit(3600.0), 6).alias("total_duration_hours"))


def codec_counts(catalog: DataFrame) -> DataFrame:
    """Videos per codec (valid videos, codec present)."""
    return (valid(catalog).where((F.col("media_type") == "video") & F.col("codec_name").isNotNull())
            .groupBy("codec_name").agg(F.count(F.lit(1)).alias("count")))


def resolution_counts(catalog: DataFrame) -> DataFrame:
    """Files per (width, height), both > 0, valid files."""
    return (valid(catalog).where((F.col("width") > 0) & (F.col("height") > 0))
            .groupBy("width", "height").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("resolution", FM.resolution_label(F.col("width"), F.col("height"))))


def top_codecs(catalog: DataFrame, k: int = 10) -> DataFrame:
    """D2 (ties broken by codec name; the reference leaves them unordered)."""
    return rank_top_k(codec_counts(catalog), [F.col("count").desc(), F.col("codec_name")], k)


def top_resolutions(catalog: DataFrame, k: int = 10) -> DataFrame:
    """D3 (ties broken by width, height)."""
    return rank_top_k(resolution_counts(catalog),
                      [F.col("count").desc(), F.col("width"), F.col("height")], k)


# --- top-k reports ------------------------------------------------------------------

def _top(df: DataFrame, key: Column, k: int) -> DataFrame:
    rows = with_resolution(df).select(
        "file_path", "file_name", "file_size", "duration", "bit_rate", "resolution",
        "codec_name", "is_corrupted")
    return rank_top_k(rows, [key.desc(), F.col("file_path")], k)


def largest_files(catalog: DataFrame, k: int = 20) -> DataFrame:
    """by size, size present, corrupted files included."""
    return _top(catalog.where(F.col("file_size").isNotNull()), F.col("file_size"), k)


def high_bitrate_top(catalog: DataFrame, min_mbit: float = 10, k: int = 20) -> DataFrame:
    """F3."""
    df = valid(catalog).where(F.col("bit_rate").isNotNull()
                              & (F.col("bit_rate") >= F.lit(min_mbit * 1_000_000)))
    return _top(df, F.col("bit_rate"), k)


def longest_files(catalog: DataFrame, k: int = 20) -> DataFrame:
    """F4."""
    df = valid(catalog).where(F.col("duration").isNotNull() & (F.col("duration") > 0))
    return _top(df, F.col("duration"), k)


def default_report(catalog: DataFrame, min_mbit: float = 10, k: int = 20) -> DataFrame:
    """F8: the three default reports in one frame, told apart by ``report``."""
    parts = [("largest", largest_files(catalog, k)),
             ("high_bitrate", high_bitrate_top(catalog, min_mbit, k)),
             ("longest", longest_files(catalog, k))]
    out = None
    for name, df in parts:
        df = df.withColumn("report", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def first_files(catalog: DataFrame, n: int) -> DataFrame:
    """the first ``n`` files (by path; the reference's order is unspecified)."""
    return catalog.select("file_path", "file_size").orderBy("file_path").limit(n)


# --- suffix pairs -------------------------------------------------------------------

def suffix_with_original(catalog: DataFrame, suffix: str) -> DataFrame:
    """Valid files whose stem ends with ``suffix`` while the same directory holds
    a valid file whose stem is that stem without the suffix (any extension).

    A left-semi join on (directory, stem): each side shuffles once by the key and the
    original side is reduced to distinct keys before the shuffle.
    """
    files = valid(catalog).withColumn("_dir", P.dirname(F.col("file_path"))) \
        .withColumn("_stem", P.stem(F.col("file_path")))
    with_suffix = files.where(F.col("_stem").endswith(F.lit(suffix))).withColumn(
        "original_base",
        F.expr(f"substring(_stem, 1, length(_stem) - {len(suffix)})"))
    originals = files.select(F.col("_dir").alias("o_dir"),
                             F.col("_stem").alias("o_stem")).distinct()
    hit = with_suffix.join(originals, (F.col("_dir") == F.col("o_dir"))
                           & (F.col("original_base") == F.col("o_stem")), "left_semi")
    return with_resolution(hit).select(*REPORT_COLUMNS, "original_base")


# --- missing dates ------------------------------------------------------------------

def no_creation_date(catalog: DataFrame) -> DataFrame:
    """Valid files without a creation date, with candidate dates as text:
    ``path_date`` (H10), ``mtime_date`` (catalog mtime, UTC) and ``suggested_date``
    (path first, as the suggestion list writes it)."""
    from ..functions import dates as D
    rows = with_resolution(valid(catalog).where(F.col("creation_date").isNull()))
    # Two stages: the path rules run once per row, then the suggestion reuses them.
    dated = rows.select(*REPORT_COLUMNS,
                        D.ts_text(D.datetime_from_path(F.col("file_path"))).alias("path_date"),
                        D.ts_text(D.epoch_to_naive_utc(F.col("modified_at"))).alias("mtime_date"))
    return dated.withColumn("suggested_date", F.coalesce("path_date", "mtime_date"))


# --- ad-hoc filters and examples ---------------------------------------------------------

def adhoc_filter(catalog: DataFrame, min_size: int | None = None, max_size: int | None = None,
                 media_type: str | None = None, date_from=None, date_to=None,
                 pattern: str | None = None) -> DataFrame:
    """The documented ad-hoc filters (size range, media type, creation-date range,
    path substring) as one pushed-down predicate."""
    cond = F.lit(True)
    if min_size is not None:
        cond = cond & (F.col("file_size") >= min_size)
    if max_size is not None:
        cond = cond & (F.col("file_size") <= max_size)
    if media_type:
        cond = cond & (F.col("media_type") == media_type)
    if date_from is not None:
        cond = cond & (F.col("creation_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        cond = cond & (F.col("creation_date") < F.lit(date_to).cast("timestamp_ntz"))
    if pattern:
        cond = cond & F.col("file_path").contains(F.lit(pattern))
    return catalog.where(cond)


def examples_per_group(rows: DataFrame, group_col, n: int) -> DataFrame:
    """The first ``n`` rows per group in F1 order (deepest directory first).

    A per-group window with a rank cut-off: Spark plans it as a window group
    limit, which keeps only ``n`` rows per group before the shuffle.
    """
    from pyspark.sql import Window
    g = F.col(group_col) if isinstance(group_col, str) else group_col
    d = P.dirname(F.col("file_path"))
    w = Window.partitionBy(g).orderBy(P.depth(d).desc(), d, P.basename(F.col("file_path")))
    return (rows.withColumn("_g", g).withColumn("example_no", F.row_number().over(w))
            .where(F.col("example_no") <= n).drop("_g"))


def examples_of_groups(rows: DataFrame, groups: dict, n: int, *columns: str) -> DataFrame:
    """E3 for overlapping groups in one pass: ``groups`` maps the name of a grouping to its key column (NULL:
    the row has none), and a row may be in one group of each grouping.

    A row is tagged with its groups and the tagged rows are ranked once; Spark plans the cut-off as a window group
    limit, so a task hands on at most ``n`` rows per group and the table is read and moved once
    however many groupings there are.  Columns: grouping, group, example_no, file_path, ``columns``.
    """
    from pyspark.sql import Window
    d = P.dirname(F.col("file_path"))
    tags = F.array_compact(F.array(*[
        F.when(key.isNotNull(), F.struct(F.lit(name).alias("grouping"), key.cast("string").alias("group")))
        for name, key in groups.items()]))
    tagged = rows.select(F.explode(tags).alias("tag"), "file_path", *columns).select("tag.*", "file_path", *columns)
    order = Window.partitionBy("grouping", "group").orderBy(P.depth(d).desc(), d, P.basename(F.col("file_path")))
    return tagged.withColumn("example_no", F.row_number().over(order)).where(F.col("example_no") <= n).select(
        "grouping", "group", "example_no", "file_path", *columns)


def depth_order_numbers(rows: DataFrame) -> DataFrame:
    """F1 as numbers: each row's 1-based position in the deepest-first order (a
    distributed global numbering, so the order itself can be checked)."""
    from .ranking import global_row_number
    d = P.dirname(F.col("file_path"))
    keyed = rows.withColumn("_k1", -P.depth(d)).withColumn("_k2", d) \
        .withColumn("_k3", P.basename(F.col("file_path")))
    return global_row_number(keyed, [F.col("_k1"), F.col("_k2"), F.col("_k3")], "position") \
        .drop("_k1", "_k2", "_k3")
