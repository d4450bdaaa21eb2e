"""Text exports (B2 file lists, B3 duplicate report, B4 directory tree).

Each export is a DataFrame of text *blocks* (one block = the lines of one entry)
with sort keys; header and summary blocks come from one-row aggregates.  Writing
sorts by the keys (a range-partitioned sort, not a single task) and writes the
blocks as text, so part files concatenate to the report in order and no entry is
split across files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import formats as FM
from ..functions import paths as P
from ..session import cut_lineage

RULE = "#" + "=" * 100


def _depth_keys(path: Column) -> list[Column]:
    d = P.dirname(path)
    return [(-P.depth(d)).alias("k1"), d.alias("k2"), P.basename(path).alias("k3")]


def export_blocks(rows: DataFrame, export_type: str, short: bool = False,
                  now: str = "2024-01-15 10:30:00", criteria: str | None = None,
                  with_dates: bool = False) -> DataFrame:
    """B2 + D10: blocks of an export list in the reference's layout.

    ``rows`` has the report columns (file_path, file_size, media_type, duration,
    bit_rate, resolution, codec_name; plus path_date, modified_at when
    ``with_dates``).  Result columns: section, k1, k2, k3, block.
    """
    keys = _depth_keys(F.col("file_path"))
    if short:
        body = rows.select(F.lit(1).alias("section"), *keys,
                           F.concat(F.col("file_path"), F.lit("\n")).alias("block"))
        return body
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    dur = F.when(F.col("duration").isNotNull() & (F.col("duration") != 0),
                 FM.duration_label(F.col("duration"))).otherwise(F.lit("N/A"))
    br = F.when(F.col("bit_rate").isNotNull() & (F.col("bit_rate") != 0),
                FM.bitrate_label(F.col("bit_rate"))).otherwise(F.lit("N/A"))
    codec = F.when(F.col("codec_name").isNull() | (F.col("codec_name") == ""), F.lit("N/A")) \
        .otherwise(F.col("codec_name"))
    res = F.when(F.col("resolution").isNull() | (F.col("resolution") == ""), F.lit("N/A")) \
        .otherwise(F.col("resolution"))
    head = F.concat_ws(" | ", F.concat(F.lit("# "), F.upper(na(F.col("media_type")))),
                       FM.file_size_label(F.col("file_size")), dur, br, res, codec)
    if with_dates:
        mtime = D.ts_text(D.epoch_to_naive_utc(F.col("modified_at")))
        head = F.concat(head, F.lit(" | "), na(mtime))
        pd_, md = F.col("path_date"), mtime
        sugg = (F.when(pd_.isNotNull() & md.isNotNull(), F.concat(
                    F.lit("# From path:\nCREATION_TIME "), pd_,
                    F.lit("\n# From mtime:\n# CREATION_TIME "), md, F.lit("\n")))
                .when(pd_.isNotNull(), F.concat(F.lit("# From path:\nCREATION_TIME "), pd_, F.lit("\n")))
                .when(md.isNotNull(), F.concat(F.lit("# From mtime:\nCREATION_TIME "), md, F.lit("\n")))
                .otherwise(F.lit("")))
        block = F.concat(head, F.lit("\n"), F.col("file_path"), F.lit("\n"), sugg, F.lit("\n"))
    else:
        block = F.concat(head, F.lit("\n"), F.col("file_path"), F.lit("\n\n"))
    body = rows.select(F.lit(1).alias("section"), *keys, block.alias("block"))

    stats = rows.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("media_type") == "video").alias("v"),
                     F.count_if(F.col("media_type") == "image").alias("i"),
                     F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"),
                     F.coalesce(F.sum("duration"), F.lit(0.0)).alias("dur"))
    fmt_line = ("# Format: file_path | type | size | duration | bitrate | resolution | codec"
                + (" | mtime" if with_dates else ""))
    header = stats.select(F.lit(0).alias("section"), F.lit(0).alias("k1"), F.lit("").alias("k2"),
                          F.lit("").alias("k3"), F.concat(
        F.lit(f"# List of {export_type}\n# Found "), F.col("n").cast("string"),
        F.lit(f" files\n# Created: {now}\n"),
        F.lit(f"# Criteria: {criteria}\n" if criteria else ""),
        F.lit(f"#\n{fmt_line}\n{RULE}\n\n")).alias("block"))
    summary = stats.select(F.lit(2).alias("section"), F.lit(0).alias("k1"), F.lit("").alias("k2"),
                           F.lit("").alias("k3"), F.concat(
        F.lit(f"{RULE}\n# SUMMARY:\n# Total files: "), F.col("n").cast("string"),
        F.when((F.col("v") > 0) | (F.col("i") > 0), F.format_string(
            " (Videos: %d, Images: %d)", F.col("v"), F.col("i"))).otherwise(F.lit("")),
        F.lit("\n# Total size: "), FM.file_size_label(F.col("size")),
        F.when(F.col("dur") > 0, F.concat(F.lit("\n# Total duration: "),
                                          FM.duration_label(F.col("dur")))).otherwise(F.lit("")),
        F.lit("\n")).alias("block"))
    return header.unionByName(body).unionByName(summary)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Write blocks in order as text part files.  Blocks carry their own newlines;
    the text writer ends every row with one, so one trailing newline is dropped
    first and the part files concatenate to the exact report."""
    (blocks.orderBy("section", "k1", "k2", "k3")
     .select(F.regexp_replace("block", r"\n\z", "").alias("value"))
     .write.mode("overwrite").text(path))


def tree_blocks(lines: DataFrame, now: str = "2024-01-15 10:30:00") -> DataFrame:
    """Directory tree export (lines from ``directories.tree_lines``) with header
    and a summary block: directories and the true total size, the sum of what lies directly in each (the
    reference's sum of recursive sizes counts bytes several times; not reproduced)."""
    body = lines.select(F.lit(1).alias("section"), F.col("order_key"), F.col("line").alias("block"))
    n = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("direct_size"), F.lit(0)).cast("bigint").alias("size"))
    header = n.select(F.lit(0).alias("section"), F.array().cast("array<string>").alias("order_key"),
                      F.concat(F.lit(f"# Directory Structure Analysis\n# Created: {now}\n"
                                     "# Total directories analyzed: "), F.col("n").cast("string"),
                               F.lit("\n#\n# Format: [subdirs count, files breakdown, total size]\n"
                                     "# Legend: dir/ = directory, empty = no files, "
                                     f"images/videos/files = media types\n{RULE}\n")).alias("block"))
    summary = n.select(F.lit(2).alias("section"), F.array().cast("array<string>").alias("order_key"),
                       F.concat(F.lit(f"\n{RULE}\n# SUMMARY:\n# Directories exported: "), F.col("n").cast("string"),
                                F.lit("\n# Total size: "), FM.file_size_label(F.col("size")), F.lit("\n")).alias("block"))
    return header.unionByName(body).unionByName(summary)


def conversion_log(plan: DataFrame) -> DataFrame:
    """One log record per planned conversion (dry run: estimated sizes)."""
    ok = F.col("status").isin("encode", "convert")
    pct = FM.compression_percent(F.col("original_size"), F.col("estimated_size"))
    msg = F.when(ok, F.format_string(
        "CONVERT_SUCCESS: %s -> %s | Size: %s -> %s (-%.1f%%) | Resolution: Unknown | Duration: 00:00",
        F.col("input_path"), F.col("output_path"),
        FM.plan_size_label(F.col("original_size")), FM.plan_size_label(F.col("estimated_size")),
        F.bround(pct, 1)))
    return plan.where(ok).select("input_path", "output_path", "original_size", "estimated_size",
                                 pct.alias("compression_percent"), msg.alias("message"))


def duplicates_report_blocks(report: DataFrame, pattern: str | None = None,
                             now: str = "2024-01-15 10:30:00") -> DataFrame:
    """The duplicate report (``duplicates.duplicate_report`` rows) as ordered
    line blocks keyed by (group_no, part, copy_no): group header, classification
    lines, the files to delete.  Groups without a copy to delete are left out, but
    keep their number.  Every line is its own row, so a huge group spreads over
    the sort's partitions."""
    matches = F.lit(True) if not pattern else F.col("file_path").contains(F.lit(pattern))
    # The numbered rows feed six kinds of blocks: write them once.
    rows = cut_lineage(report.withColumn("_match", matches).withColumn(
        "_delete", (F.col("copy_no") > 0) & F.col("_match")), "dup-report")
    per_group = rows.groupBy("file_hash", "group_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("file_size").alias("gsize"),
        F.count_if("_delete").alias("n_delete"))
    live = per_group.where(F.col("n_delete") > 0)
    rows = rows.join(live.select("file_hash"), "file_hash", "left_semi")
    # The reference prints Python's None for a missing resolution here.
    res = F.coalesce(FM.resolution_label(F.col("width"), F.col("height")), F.lit("None"))
    dur = FM.duration_label(F.col("duration"))
    line = F.concat(
        F.when(F.col("copy_no") == 0, F.lit("# ORIGINAL: "))
        .otherwise(F.concat(F.lit("# COPY "), F.col("copy_no").cast("string"), F.lit(": "))),
        F.concat_ws(" | ", FM.file_size_label(F.col("file_size")), dur,
                    FM.bitrate_label(F.col("bit_rate")), res, FM.short_codec(F.col("codec_name"), 8)),
        F.when(F.col("_match"), F.lit(" ← MATCHES PATTERN")).otherwise(F.lit("")),
        F.lit("\n# "), F.col("file_path"))
    cols = ["group_no", "part", "seq", "block"]
    member_lines = rows.select("group_no", F.lit(1).alias("part"), F.col("copy_no").alias("seq"),
                               line.alias("block"))
    delete_lines = rows.where("_delete").select("group_no", F.lit(3).alias("part"),
                                                F.col("copy_no").alias("seq"),
                                                F.col("file_path").alias("block"))
    heads = live.select("group_no", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.concat(
        F.lit("# Group "), F.col("group_no").cast("string"), F.lit(": "), F.col("n").cast("string"),
        F.lit(" files total, "), F.col("n_delete").cast("string"), F.lit(" copies to process, hash: "),
        FM.short_hash(F.col("file_hash")), F.lit("...\n# Total size: "),
        FM.file_size_label(F.col("gsize") * F.col("n")), F.lit(", wasted: "),
        FM.file_size_label(F.col("gsize") * (F.col("n") - 1)),
        F.lit("\n#\n# File classification:")).alias("block"))
    mids = live.select("group_no", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("seq"),
                       F.lit("#\n# Files to delete (copies matching pattern):").alias("block"))
    tails = live.select("group_no", F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("seq"),
                        F.lit("#").alias("block"))
    n_groups = per_group.agg(F.count(F.lit(1)).alias("g"))
    header = n_groups.select(F.lit(0).cast("bigint").alias("group_no"), F.lit(0).alias("part"),
                             F.lit(0).cast("bigint").alias("seq"), F.concat(
        F.lit("# Duplicate list by hash\n# Found "), F.col("g").cast("string"),
        F.lit(" duplicate groups\n"),
        F.lit(f"# Filtered by pattern: {pattern}\n" if pattern else ""),
        F.lit(f"# Created: {now}\n#\n{RULE}\n")).alias("block"))
    return (header.select(*cols).unionByName(heads.select(*cols))
            .unionByName(member_lines.select(*cols)).unionByName(mids.select(*cols))
            .unionByName(delete_lines.select(*cols)).unionByName(tails.select(*cols)))


def write_ordered(blocks: DataFrame, keys: list[str], path: str) -> None:
    """Write blocks sorted by ``keys`` as text part files."""
    blocks.orderBy(*keys).select(F.col("block").alias("value")).write.mode("overwrite").text(path)


def append_log(log: DataFrame, path: str) -> None:
    """B7 sink: append the conversion records to a Parquet log (one file set per run)."""
    log.write.mode("append").parquet(path)
