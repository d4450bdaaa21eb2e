"""Mixing sources to target weights (native).

Words are summed per source (map-side combined, so a source with a third of all rows is one
row per task), every source gets a target share, its repetition rate is target / size, and a
document is emitted floor(rate) times plus once more if a hash of its id and text, read as a
number in [0, 1), lies below the rate's fraction.

Targets: sources in code point order (NULL last) take the weights in turn; they share the
corpus's total size.  A target stops at ``max_repeats`` times its source's size; the excess is
shared again by weight until no target is above.  That is one level L with target =
min(cap, L * weight); L is found by repeating one small aggregate over the table of sources.

Defined results: NULL text has size 0 and keeps its row; NULL source is a source of its own;
an empty table gives no rows; a source of size 0 has target 0 and rate 0; rows of one id, or of
none, draw by their texts, and only rows equal in both are taken alike; further columns, whatever
their names, come out as they went in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.ranking import global_row_number
from medialake.session import cut_lineage

from .common import fits_broadcast, null_tag, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes``: one row (_sk, source_size) per source -> the same plus target (double)."""
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.col("_no") - 1) % len(weights) + 1).cast("int"))
    weighted = cut_lineage(
        global_row_number(sizes, [F.col("_sk")], "_no").select(
            "_sk", "source_size", turn.cast("long").alias("_w"),
            (F.col("source_size") * max_repeats).alias("_cap")), "mix-sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each turn caps at least one more source; one row comes back
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        row = weighted.agg(
            F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0)).alias("cap"),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0)).alias("w")).first()
        if row["n"] == capped or not row["w"]:
            break
        level, capped = (total - row["cap"]) / row["w"], row["n"]
    return weighted.select("_sk", "source_size", F.least(
        F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def draw(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id and the text."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"),
                            F.coalesce(F.md5(text), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(1 << 52).cast("double")


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS,
                 max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sized``: rows (_sk, _size) -> stored table _sk, source_size, target, _rate."""
    sizes = sized.groupBy("_sk").agg(F.sum("_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return cut_lineage(source_targets(sizes, weights, max_repeats).withColumn("_rate", rate),
                       "mix-targets")


def with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (_sk, _draw and others) plus source_size, target, _rate and copies (long).

    The table of rates has one row per source: it is broadcast if it is below a checked
    bound, else joined by shuffle.
    """
    rates = F.broadcast(rates) if fits_broadcast(rates, 200) else rates
    whole = F.floor("_rate")
    extra = F.when(F.col("_draw") < F.col("_rate") - whole, 1).otherwise(0)
    return rows.join(rates, "_sk").withColumn("copies", (whole + extra).cast("long"))


def mix(docs: DataFrame, *, seed: str = "mix", weights: Sequence[int] = WEIGHTS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its source's rate says, with the
    columns of ``docs``.  Texts are read for counting and for the output; only counts move."""
    sized = docs.select(null_tag(F.col("source")).alias("_sk"), word_count(F.col("text")).alias("_size"))
    packed = docs.select(F.struct("*").alias("_doc"), null_tag(F.col("source")).alias("_sk"),
                         draw(F.col("doc_id"), F.col("text"), seed).alias("_draw"))
    taken = with_copies(packed, source_rates(sized, weights, max_repeats))
    return (taken.where("copies > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
            .select("_doc.*"))


def mixture_table(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: what the mix takes of it.  Words are counted once and stored."""
    sized = cut_lineage(docs.select(
        "doc_id", "source", null_tag(F.col("source")).alias("_sk"), word_count(F.col("text")).alias("_size"),
        draw(F.col("doc_id"), F.col("text"), seed).alias("_draw")), "mix-sizes")
    return with_copies(sized, source_rates(sized)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("copies")).alias("taken"), "copies", "source")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':'
                            || coalesce(md5(text), 'null')), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER p AS caps, sum(w) OVER () - sum(w) OVER p AS rest,
         lead(3.0::DOUBLE * source_size / w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source) AS next_ratio
  FROM s WINDOW p AS (ORDER BY 3.0::DOUBLE * source_size / w, source
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lv AS (
  SELECT min(level) AS level FROM (
    SELECT CAST(sum(source_size) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS level,
           min(3.0::DOUBLE * source_size / w) AS first_ratio FROM s HAVING level <= first_ratio
    UNION ALL
    SELECT CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE) AS level, next_ratio FROM o
    WHERE rest > 0 AND 3.0::DOUBLE * source_size / w < CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE)
      AND CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE) <= next_ratio)),
t AS (SELECT s.*, least(CAST(3 * source_size AS DOUBLE), coalesce(level, 0) * w) AS target FROM s, lv),
r AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies, source
FROM r
"""
