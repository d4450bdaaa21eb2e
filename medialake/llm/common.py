"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of the white space that separates words (space and \t \n \v \f \r).
WS_RUN = "[\\x20\\x09-\\x0D]+"
#: One word.
WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (long); NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is.

    For a text of ASCII characters alone this is ``lower``, which is much cheaper.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def null_tag(col: Column) -> Column:
    """A key that is never NULL and keeps NULL apart from every value (sorts last)."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def fits_broadcast(df: DataFrame, bytes_per_row: int, bound: int = 64 << 20) -> bool:
    """True if ``df`` (already stored, so counting it is cheap) stays below ``bound``."""
    return df.count() * bytes_per_row <= bound


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is stored inside the block, so that a worker and
    the executor that feeds it hold little at once.  The session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def split_words(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The runs without ASCII white space of ``text``, in lists of about ``step`` bytes, so that a very long
    text is never held as one list.  A step ends at a space; a run without spaces is one item."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + step) if len(text) - at > step else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
