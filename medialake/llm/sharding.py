"""Sharding by proportional stratified interleaving (native).

Rows of each source are put into a seeded random order; row number r (from 0) of a source
of n rows has the fraction (r + u) / n, where u in (0, 1) is a phase of the source's own, so
that sources of one size do not move in step.  Sorted by fraction, the sources interleave in
proportion, so cutting the order into equal pieces gives every shard the corpus's mixture:
each shard has, of every source, nearly the proportional number of rows (ends of a shard may be off by a row or two).

Scale: no window covers a source or the whole table.  The seeded order is that of an MD5
digest of id and tie hash (the other columns'), so NULL and repeated ids are dealt out too and
its first hex digits deal a source's rows evenly over buckets, whose number grows with the
table so that a bucket has about ``PER_BUCKET`` rows or fewer (the order does not depend on it); ranks
are row numbers inside (source, bucket) plus the counts of earlier buckets.  Fractions are
spread evenly by construction, so the second numbering uses as many buckets of the fraction.
What meets in one task are the rows of a bucket, and one row of counts per bucket.

Defined results: NULL text counts as empty (size 8, CRC 0); NULL source is a source of its
own, after the others; NULL or repeated ids are told apart by their remaining columns' hash,
and rows that are equal in everything are interchangeable (and share a bucket); an empty table gives no rows; with
fewer rows than shards some shards stay empty; further columns, whatever their names, come out as they
went in, but that columns named ``shard`` and ``slot`` are replaced by the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import fits_broadcast, null_tag

PER_BUCKET = 1 << 14
MIN_DIGITS = 3  # hex digits of the digest that name a bucket


def _offsets(counts: DataFrame, part: list[str], bucket: str, off: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(bucket) if part else Window.orderBy(bucket)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(off, F.coalesce(F.sum("_c").over(before), F.lit(0)).cast("long"))


def bucket_digits(n_rows: int) -> int:
    digits = MIN_DIGITS
    while n_rows > PER_BUCKET << 4 * digits:
        digits += 1
    return digits


def _keyed(rows: DataFrame, source: str, id_col: str, tie: list[str], seed: str, digits: int) -> DataFrame:
    """The whole row in ``_row``, and beside it what places it."""
    packed = rows.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), null_tag(F.col(source)).alias("_sk"),
                         (F.xxhash64(*tie) if tie else F.lit(0)).alias("_tie"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("null")),
                            F.lit(":"), F.col("_tie").cast("string")))
    return (packed.withColumn("_h", digest)
            .withColumn("_u", (F.conv(F.substring(F.md5("_sk"), 1, 8), 16, 10).cast("long") + 0.5) / (1 << 32))
            .withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int")))


def interleave(rows: DataFrame, n_shards: int = 24, *, source: str = "source",
               id_col: str = "doc_id", tie: list[str] | None = None,
               seed: str = "interleave") -> DataFrame:
    """``rows`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in a shard).

    ``tie``: columns that tell apart rows of one id (default: all others).
    """
    tie = [c for c in rows.columns if c != id_col] if tie is None else tie
    total = rows.count()
    digits = bucket_digits(total)
    buckets = 16 ** digits
    keyed = _keyed(rows, source, id_col, tie, seed, digits)
    counts = keyed.groupBy("_sk", "_b").agg(F.count(F.lit(1)).alias("_c"))
    per_bucket = cut_lineage(
        _offsets(counts, ["_sk"], "_b", "_off")
        .withColumn("_n", F.sum("_c").over(Window.partitionBy("_sk"))).drop("_c"), "shard-buckets")

    def fractions(part: DataFrame) -> DataFrame:
        in_bucket = Window.partitionBy("_sk", "_b").orderBy("_h", "_id", "_tie")
        ranked = (part.join(per_bucket, ["_sk", "_b"])
                  .withColumn("_r", F.row_number().over(in_bucket).cast("long") - 1 + F.col("_off")))
        return (ranked.withColumn("_frac", (F.col("_r") + F.col("_u")) / F.col("_n"))
                .withColumn("_fb", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)).cast("int")))

    # The counts need no other column, so this pass reads and moves slim rows only.
    slim = fractions(keyed.select("_sk", "_u", "_b", "_h", "_id", "_tie"))
    starts = cut_lineage(_offsets(slim.groupBy("_fb").agg(F.count(F.lit(1)).alias("_c")),
                                  [], "_fb", "_goff"), "shard-starts").drop("_c")  # a row per bucket at most
    starts = F.broadcast(starts) if fits_broadcast(starts, 24) else starts
    order = Window.partitionBy("_fb").orderBy("_frac", "_sk", "_h", "_id", "_tie")
    placed = (fractions(keyed).join(starts, "_fb")
              .withColumn("_p", F.row_number().over(order).cast("long") - 1 + F.col("_goff")))
    total = max(total, 1)
    shard = F.expr(f"_p * {n_shards}L div {total}L")
    first = F.expr(f"(_s * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("_s", shard).withColumn("_slot", (F.col("_p") - first).cast("long"))
            .select(*[F.col(f"_row.`{c}`") for c in rows.columns if c not in ("shard", "slot")],
                    F.col("_s").cast("int").alias("shard"), F.col("_slot").alias("slot")))


def shard_table(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The digest of every document's place: see ``interleave``; law ``rows``."""
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    return interleave(rows, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")
