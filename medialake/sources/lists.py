"""Text lists (A5 file lists, A6 suggestion lists) and line numbering.

Line numbers are needed to attach a ``CREATION_TIME`` line to the path above it.
Reading with ``wholetext`` would put a whole list file into one row; instead the
text is read line by line (splittable), and each line's number inside its file is
derived from the split it came from (``_metadata.file_block_start``), its position
inside the split (``monotonically_increasing_id`` taken right after the scan) and
the line counts of the file's earlier splits (a table with one row per split).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import make_ts

# Python's str.strip() whitespace, as far as it occurs in text lists.
STRIP_CHARS = " \t\n\r\x0b\x0c"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (Arrow batches; Spark has no built-in normalizer)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else x)


def parse_file_list(lines: DataFrame, normalize: bool = True) -> DataFrame:
    """A5: ``value`` lines -> ``file_path``: stripped, optionally NFC-normalised,
    blank and ``#`` lines dropped; order and duplicates kept as rows."""
    v = F.btrim(F.col("value"), F.lit(STRIP_CHARS))
    if normalize:
        v = nfc(v)
    return (lines.select(v.alias("file_path"))
            .where((F.col("file_path") != "") & ~F.col("file_path").startswith("#")))


def read_file_list(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    return parse_file_list(spark.read.text(path), normalize)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with (``file``, ``line_no``) -- 0-based within each file."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"),
                                              F.min("mid").alias("first_mid"))
    # One row per split: the running line count of earlier splits of the same file.
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first_mid",
                            F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    return (raw.join(offsets, ["file", "block"])
            .select("file", (F.col("offset") + F.col("mid") - F.col("first_mid")).alias("line_no"),
                    "value"))


#: Lines of a file that are looked at together.
SEGMENT = 1 << 16


def attach_suggestions(lines: DataFrame, window: int = 4, segment: int = SEGMENT) -> DataFrame:
    """E5: path lines with the first ``CREATION_TIME`` line among the next ``window``
    lines, before the next path line.

    The numbered lines are cut into segments of ``segment`` lines of a file; each segment is handed the first
    ``window`` lines of the next one as well, so that its last paths see all their lines.  Within a segment
    one sorted pass looks ahead.  A line is thus moved once (a border line twice), nothing is joined, and a
    huge list is as many groups as it has segments.  A malformed timestamp on an attached line
    is an error, as in the reference.
    """
    t = F.btrim(F.col("value"), F.lit(STRIP_CHARS))
    kind = (F.when((t == "") | t.startswith("#"), "other").when(t.startswith("CREATION_TIME "), "time")
            .when(t.startswith("CREATION_TIME"), "other").otherwise("path"))
    at = F.floor(F.col("line_no") / segment).cast("long")
    early = (F.col("line_no") % segment < window) & (at > 0)
    # A segment shorter than the window would need lines of the one after next as well.
    back = F.when(early, F.sequence(at, F.greatest(F.lit(0), F.floor((F.col("line_no") - window) / segment)).cast("long"), F.lit(-1))) \
        .otherwise(F.array(at))
    dealt = lines.select("file", "line_no", t.alias("text"), kind.alias("kind"), at.alias("home"), F.explode(back).alias("segment"))
    ahead = Window.partitionBy("file", "segment").orderBy("line_no")
    found = F.lit(None).cast("string")
    for j in range(window, 0, -1):  # from the farthest line to the next one
        next_kind = F.lead("kind", j).over(ahead)
        found = (F.when(next_kind == "time", F.lead("text", j).over(ahead))
                 .when(next_kind == "path", F.lit(None).cast("string")).otherwise(found))
    paths = (dealt.withColumn("found", found).where((F.col("kind") == "path") & (F.col("home") == F.col("segment")))
             .withColumn("ts_text", F.btrim(F.substr(F.col("found"), F.lit(len("CREATION_TIME ") + 1)), F.lit(STRIP_CHARS))))
    # strptime('%Y-%m-%d %H:%M:%S'): four-digit year, other fields one or two digits.
    pat = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    ts = make_ts(*[F.regexp_extract(F.col("ts_text"), pat, j).try_cast("int") for j in range(1, 7)])
    suggested = F.when(F.col("ts_text").isNull(), F.lit(None).cast("timestamp_ntz")).when(
        ts.isNull(), F.raise_error(F.concat(F.lit("Invalid CREATION_TIME: "), F.col("ts_text")))
    ).otherwise(ts).cast("timestamp_ntz")
    return paths.select("file", F.col("line_no").alias("path_line"), F.col("text").alias("file_path"), suggested.alias("suggested"))


def read_suggestion_list(spark: SparkSession, path: str, window: int = 4) -> DataFrame:
    """``(file_path, suggested)`` per path line of suggestion-list files.

    The attach step passes over the numbered lines once, so they are not stored."""
    return attach_suggestions(numbered_lines(spark, path), window)
