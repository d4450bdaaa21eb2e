"""Distributed numbering helpers.

``global_row_number`` numbers rows in a total order without an unpartitioned
window (which would pull every row into one task).  The range-partitioned sort is
planned and run once: its rows are stored together with the partition number and
the position that they had in it, so the per-partition counts and the rows they are
joined to always speak of the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | record number


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Append a 1-based row number in ``order`` (which must be a total order)."""
    stored = cut_lineage(
        df.orderBy(*order).withColumn("_gr_mid", F.monotonically_increasing_id()), "numbered")
    stored = (stored.withColumn("_gr_pid", F.shiftright(F.col("_gr_mid"), _LOW_BITS))
              .withColumn("_gr_pos", F.col("_gr_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))))
    # One row per non-empty partition: bounded by the partition count, safe to broadcast.
    sizes = stored.groupBy("_gr_pid").agg(F.count(F.lit(1)).alias("_gr_n"))
    offsets = sizes.select(
        "_gr_pid",
        F.coalesce(F.sum("_gr_n").over(
            Window.orderBy("_gr_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_gr_off"))
    number = F.coalesce(F.col("_gr_off"), F.raise_error(F.lit("partition without an offset")))
    return (stored.join(F.broadcast(offsets), "_gr_pid", "left")
            .withColumn(name, number.cast("long") + F.col("_gr_pos") + 1)
            .drop("_gr_mid", "_gr_pid", "_gr_pos", "_gr_off"))


def rank_top_k(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top ``k`` rows with a 1-based rank column (a top-k report's line number).

    ``limit`` after ``orderBy`` plans as TakeOrderedAndProject (per-partition top-k,
    then a merge of k rows per partition), so the window below sees only k rows.
    """
    top = df.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_within(df: DataFrame, keys: list[str], order: list[str],
                name: str = "rank") -> DataFrame:
    """0-based position of each row inside its ``keys`` group, in ``order``.

    One path for groups of every size: the global number minus the number of the
    group's first row, so no task ever needs a whole group.  The one-row-per-group
    side is stored before the join, which leaves a plain exchange on both sides; AQE
    can then split the partition of a hot group.
    """
    pos = global_row_number(df, [F.col(k) for k in keys + order], "_rw_pos")
    first = cut_lineage(pos.groupBy(*keys).agg(F.min("_rw_pos").alias("_rw_first")), "firsts")
    return (pos.join(first, keys).withColumn(name, F.col("_rw_pos") - F.col("_rw_first"))
            .drop("_rw_pos", "_rw_first"))
