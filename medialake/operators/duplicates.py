"""Exact duplicates by content hash.

Scale notes.  A single hash (say, every empty file) may hold a third of the
catalog.  Group statistics, the choice of the original and the number of files to delete
therefore use plain aggregates (partial aggregation before the shuffle): the original of a group is
``min(struct(matches_pattern, file_path))``, which equals the reference's rule
(first path without a pattern, else the first path).  The group table (one row per hash, its number
included) is stored before files are joined to it.  That join is the only operation
on the hash in its job, with a plain exchange on either side, so AQE's skew join can split
a hot hash; an aggregate or a second join on the hash beside it would forbid that.
Copy numbers come from the global numbering (``ranking.rank_within``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import global_row_number, rank_within


def matches_any(path: Column, patterns: Sequence[str] | None) -> Column:
    """Case-sensitive substring test against any pattern (never LIKE: ``_`` and ``%``)."""
    if not patterns:
        return F.lit(False)
    cond = None
    for p in patterns:
        c = path.contains(F.lit(p))
        cond = c if cond is None else (cond | c)
    return cond


def hashed_files(catalog: DataFrame) -> DataFrame:
    """Files that take part in duplicate detection: hash present and not corrupted."""
    return catalog.where(F.col("file_hash").isNotNull() & (F.col("file_hash") != "")
                         & ~F.col("is_corrupted"))


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    """D4 + D5: one row per hash with two or more files.

    Columns: file_hash, file_count, group_size (largest file), wasted_bytes
    (largest size times count - 1, the reference's estimate).
    """
    return (hashed_files(catalog)
            .groupBy("file_hash")
            .agg(F.count(F.lit(1)).alias("file_count"),
                 F.max("file_size").alias("group_size"))
            .where(F.col("file_count") >= 2)
            .withColumn("wasted_bytes", F.col("group_size") * (F.col("file_count") - 1)))


def _group_table(files: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """One row per duplicate hash: member count, largest size, the original, and how many copies
    the first pattern leaves on the delete list (all copies without patterns)."""
    listed = lambda path: path.contains(F.lit(patterns[0])) if patterns else F.lit(True)
    return (files.groupBy("file_hash")
            .agg(F.count(F.lit(1)).alias("file_count"),
                 F.max("file_size").alias("group_size"),
                 F.count_if(listed(F.col("file_path"))).alias("n_listed"),
                 F.min(F.struct("matches_pattern", "file_path")).alias("first"))
            .where(F.col("file_count") >= 2)
            .select("file_hash", "file_count", "group_size", F.col("first.file_path").alias("original_path"),
                    (F.col("n_listed") - listed(F.col("first.file_path")).cast("int")).alias("n_delete")))


def _marked(catalog: DataFrame, patterns: Sequence[str] | None) -> DataFrame:
    return hashed_files(catalog).withColumn("matches_pattern", matches_any(F.col("file_path"), patterns))


def _members(files: DataFrame, groups: DataFrame, *further: str) -> DataFrame:
    """The members of the groups (a stored table) with their role."""
    return (files.join(groups.select("file_hash", "file_count", "original_path", *further), "file_hash")
            .withColumn("is_original", F.col("file_path") == F.col("original_path"))
            .drop("original_path"))


def classify_duplicates(catalog: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """Every member of every duplicate group with its role.

    Columns: the catalog columns, matches_pattern, file_count, is_original.
    """
    files = _marked(catalog, patterns)
    return _members(files, cut_lineage(_group_table(files), "dup-groups"))


def duplicate_report(catalog: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """E1 + E2: the report's numbering.

    ``group_no`` orders groups by descending size (hash breaks ties; the reference
    leaves them unordered) and counts groups later left out; ``copy_no`` is 0 for
    the original and j for COPY j, in the order (matches_pattern, file_path).

    The groups are numbered first, as rows of the group table, and files join that table once.
    Copy numbers are the global numbering in (hash, matches, path) order minus the
    group's first position (``ranking.rank_within``, which stores the joined rows on the way), for groups
    of every size, so no task holds an unbounded group.
    """
    files = _marked(catalog, patterns)
    groups = cut_lineage(_group_table(files), "dup-groups")
    numbered = cut_lineage(global_row_number(groups, [F.col("file_count").desc(), F.col("file_hash")], "group_no"),
                           "dup-numbered")
    return rank_within(_members(files, numbered, "group_no"), ["file_hash"], ["matches_pattern", "file_path"], "copy_no")


def copies_to_delete(catalog: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """K9: copies whose path contains the first pattern (all copies without patterns).

    All patterns decide the original; only the first filters the delete list.
    """
    members = classify_duplicates(catalog, patterns).where(~F.col("is_original"))
    if patterns:
        members = members.where(F.col("file_path").contains(F.lit(patterns[0])))
    return members.select("file_path", "file_hash", "file_size")


def wasted_space(catalog: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """D5 summary, one row: groups, copies, wasted bytes over all groups (as the
    reference counts it, also groups the filter leaves out), files to delete and
    the wasted bytes of groups that still have a file to delete.

    One aggregate by hash gives all of it; no file is joined to its group."""
    wasted = F.col("group_size") * (F.col("file_count") - 1)
    return _group_table(_marked(catalog, patterns), patterns).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("file_count") - 1), F.lit(0)).cast("bigint").alias("copies"),
        F.coalesce(F.sum(wasted), F.lit(0)).cast("bigint").alias("wasted_bytes"),
        F.coalesce(F.sum("n_delete"), F.lit(0)).cast("bigint").alias("files_to_delete"),
        F.coalesce(F.sum(F.when(F.col("n_delete") > 0, wasted)), F.lit(0))
        .cast("bigint").alias("wasted_filtered"),
    )
