"""Joins shared by the plan tools (J3-J6, G3) and their totals.

A plan never touches files: existence comes from an ``inventory`` table (path,
size, mtime of files on disk) and protection from the catalog.  All lookups are
semi/anti joins on the path, which keep duplicates of the listed side (G3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ProtectedOutputError(RuntimeError):
    """A planned output path is a catalogued file (the run must not start)."""


def split_existing(listed: DataFrame, inventory: DataFrame, path_col: str = "file_path"
                   ) -> tuple[DataFrame, DataFrame]:
    """(existing, missing) -- list order and duplicates are kept."""
    inv = inventory.select(F.col("file_path").alias(path_col)).distinct()
    return (listed.join(inv, path_col, "left_semi"), listed.join(inv, path_col, "left_anti"))


def mark_existing(listed: DataFrame, inventory: DataFrame, path_col: str = "file_path") -> DataFrame:
    """J3 in one pass: ``exists`` flag and on-disk ``original_size`` from a single
    left join (inventory paths are unique), so the list is read once."""
    inv = inventory.select(F.col("file_path").alias(path_col),
                           F.col("file_size").alias("original_size"),
                           F.lit(True).alias("exists"))
    return (listed.join(inv, path_col, "left")
            .withColumn("exists", F.coalesce(F.col("exists"), F.lit(False))))


def with_size(listed: DataFrame, inventory: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Attach the on-disk size (inventory keys are unique paths)."""
    inv = inventory.select(F.col("file_path").alias(path_col), F.col("file_size").alias("original_size"))
    return listed.join(inv, path_col, "left")


def protected_outputs(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tasks whose output path is in the catalog."""
    return tasks.join(catalog.select(F.col("file_path").alias("output_path")),
                      "output_path", "left_semi")


def check_protected(tasks: DataFrame, catalog: DataFrame) -> None:
    """J4, fail fast: raise before any write if one output is catalogued (one row
    is fetched at most)."""
    hit = protected_outputs(tasks, catalog).select("output_path").limit(1).collect()
    if hit:
        raise ProtectedOutputError(f"Output file exists in database: {hit[0]['output_path']}")


def mark_existing_outputs(tasks: DataFrame, inventory: DataFrame, skip_existing: bool = True
                          ) -> DataFrame:
    """``output_exists`` flag from one left join; with ``skip_existing`` such tasks
    get status ``skipped`` (counted, not converted)."""
    inv = inventory.select(F.col("file_path").alias("output_path"),
                           F.lit(True).alias("output_exists")).distinct()
    out = tasks.join(inv, "output_path", "left").withColumn(
        "output_exists", F.coalesce(F.col("output_exists"), F.lit(False)))
    if skip_existing:
        out = out.withColumn("status", F.when(F.col("output_exists"), F.lit("skipped"))
                             .otherwise(F.col("status")))
    return out


def conversion_totals(plan: DataFrame, done_status: str) -> DataFrame:
    """Successes, skipped, errors, original and estimated bytes, percent saved."""
    ok = F.col("status") == done_status
    t = plan.agg(
        F.count_if(ok).alias("successes"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("original_size"))), F.lit(0)).cast("bigint")
        .alias("original_bytes"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("estimated_size"))), F.lit(0.0)), 2)
        .alias("estimated_bytes"))
    return t.withColumn("percent_saved", F.when(
        F.col("original_bytes") > 0,
        F.round((F.col("original_bytes") - F.col("estimated_bytes")) / F.col("original_bytes") * 100, 6)
    ).otherwise(F.lit(0.0)))
