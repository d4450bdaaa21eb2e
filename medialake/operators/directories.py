"""Directory rollup (J7, J10, D6-D9, F5, F7, B4's lines).

Plan: aggregate files per directory first (D6; partial aggregation, one row per
directory), then explode each *directory* -- not each file -- into its ancestors
below the common root and aggregate again (D7), combined on the map side.  Rows after
the explode are directories x depth, independent of how many files a directory holds,
so a directory with a third of all files costs one row.  The same aggregate gives each
directory its parent (J10) and its own files, so that edges need no explode of their
own; what is counted by parent (D8) is one row per directory.  The common root (D9) is a
one-row aggregate over the per-directory table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as FM
from ..functions import paths as P
from ..session import cut_lineage

STAT_COLS = ["total_files", "images", "videos", "other_files", "total_size"]


def direct_stats(catalog: DataFrame) -> DataFrame:
    """Per directory, valid files only: files, images, videos, other, bytes."""
    files = catalog.where(~F.col("is_corrupted")).select(
        P.dirname(F.col("file_path")).alias("dir_path"), "file_size", "media_type")
    return files.groupBy("dir_path").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("media_type") == "image").alias("images"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.count_if(~F.col("media_type").isin("image", "video")
                   | F.col("media_type").isNull()).alias("other_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"))


def common_root_expr(dirs: DataFrame) -> Column:
    """D9 as an aggregate expression: longest common directory of ``dir_path``.

    Arrays order element-wise in Spark, so the common prefix of the smallest and the
    largest component array is the common prefix of all of them.
    """
    lo = F.min(F.split(F.col("dir_path"), "/"))
    hi = F.max(F.split(F.col("dir_path"), "/"))
    same = F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(same, False)
    n = F.when(first_diff > 0, first_diff - 1).otherwise(F.size(same))
    root = F.array_join(F.slice(lo, 1, n), "/")
    return F.when(root == "", F.lit("/")).otherwise(root)


def common_root(direct: DataFrame) -> str:
    """The one-row result as a string (a single value on the driver)."""
    return direct.agg(common_root_expr(direct).alias("root")).first()["root"]


def _root_depth(root: str) -> int:
    # Number of split components of the root; ancestors start below/at it.
    return 1 if root == "/" else len(root.split("/"))


def directory_tree(catalog: DataFrame, root: str | None = None) -> DataFrame:
    """D6 + D7 + D8 + J10: one row per directory of the tree.

    Columns: dir_path, depth (number of ``/``), direct_files, direct_size,
    total_files, images, videos, other_files, total_size (recursive),
    subdirs_count, parent_path (NULL at the root).
    """
    # One row per directory, read for the root and for the rollup: written once (one scan
    # of the catalog).
    direct = cut_lineage(direct_stats(catalog), "dir-direct")
    if root is None:
        root = common_root(direct)
    rd = _root_depth(root)
    if root == "/":
        chain = F.when(F.col("dir_path") == "/", F.array(F.lit("/"))).otherwise(
            F.concat(F.array(F.lit("/")), P.ancestors(F.col("dir_path"))))
    else:
        chain = P.ancestors(F.col("dir_path"), min_depth=rd)
    # Each directory contributes its stats to every ancestor down to the root, and each
    # entry of its chain knows the one before it, which is its parent.
    exploded = direct.select(chain.alias("_chain"), "dir_path", *STAT_COLS).select(
        F.posexplode("_chain").alias("pos", "anc"), "_chain", "dir_path", *STAT_COLS)
    own = F.col("anc") == F.col("dir_path")
    rollup = cut_lineage(exploded.groupBy(F.col("anc").alias("dir_path")).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in STAT_COLS],
        F.sum(F.when(own, F.col("total_files"))).alias("direct_files"),
        F.sum(F.when(own, F.col("total_size"))).alias("direct_size"),
        F.max(F.get("_chain", F.col("pos") - 1)).alias("parent_path")), "dir-rollup")
    subdirs = rollup.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("dir_path")).agg(
        F.count(F.lit(1)).alias("subdirs_count"))
    tree = rollup.join(subdirs, "dir_path", "left")
    # One row per directory, read by every consumer (tree lines, numbering, top-k):
    # written once.
    return cut_lineage(tree.select(
        "dir_path", P.depth(F.col("dir_path")).alias("depth"),
        F.coalesce("direct_files", F.lit(0)).cast("bigint").alias("direct_files"),
        F.coalesce("direct_size", F.lit(0)).cast("bigint").alias("direct_size"),
        *STAT_COLS,
        F.coalesce("subdirs_count", F.lit(0)).cast("bigint").alias("subdirs_count"),
        "parent_path"), "dir-tree")


def root_directories(dirs: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Directories none of whose proper ancestors (other than ``/``) is in the set.

    Rewritten from the reference's pairwise prefix test to an equi anti join over
    exploded ancestors.  ``/`` itself only counts when it holds files directly.
    """
    cand = dirs.select("dir_path")
    if direct is not None:
        has_files = direct.where(F.col("total_files") > 0).select("dir_path")
        cand = cand.where(F.col("dir_path") != "/").unionByName(
            cand.where(F.col("dir_path") == "/").join(has_files, "dir_path", "left_semi"))
    anc = cand.select("dir_path", F.explode(P.proper_ancestors(F.col("dir_path"))).alias("anc"))
    has_parent = (anc.join(cand.select(F.col("dir_path").alias("anc")), "anc", "left_semi")
                  .select("dir_path"))
    return cand.join(has_parent, "dir_path", "left_anti")


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word),
                    F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def tree_lines(tree: DataFrame) -> DataFrame:
    """B4 body: ``dir/ [N dirs, X images, Y videos, Z files, SIZE]`` per directory,
    with ``order_key`` giving the pre-order of the tree (sort by path components)."""
    parts = F.concat_ws(", ", F.array_compact(F.array(
        F.when(F.col("subdirs_count") > 0, _plural(F.col("subdirs_count"), "dir")),
        F.when(F.col("images") > 0, _plural(F.col("images"), "image")),
        F.when(F.col("videos") > 0, _plural(F.col("videos"), "video")),
        F.when(F.col("other_files") > 0, _plural(F.col("other_files"), "file")),
        FM.file_size_label(F.col("total_size")))))
    desc = F.when(F.col("total_files") == 0, F.lit("[empty]")).otherwise(
        F.concat(F.lit("["), parts, F.lit("]")))
    return tree.select("dir_path", F.split(F.col("dir_path"), "/").alias("order_key"),
                       F.concat(F.col("dir_path"), F.lit("/ "), desc).alias("line"), "direct_size")


def preorder(tree: DataFrame) -> DataFrame:
    """tree pre-order with sorted children = order by path components."""
    return tree.orderBy(F.split(F.col("dir_path"), "/"))


def largest_dirs(tree: DataFrame, k: int = 5) -> DataFrame:
    """top ``k`` directories by recursive bytes (ties: depth, path) plus the
    number of directories not shown."""
    from .ranking import rank_top_k
    top = rank_top_k(tree.select("dir_path", "depth", "total_size", "total_files"),
                     [F.col("total_size").desc(), F.col("depth"), F.col("dir_path")], k)
    n_dirs = tree.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    return top.select("rank", "dir_path", "total_size", "total_files",
                      F.greatest(n_dirs - k, F.lit(0)).alias("remaining_dirs"))
