"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links``: rows (a, b) of long ids -> stored rows (node, root), for linked nodes only.

    Each round takes the least label among a node's neighbours and then the label of that
    label.  Labels and links are stored tables, so both sides of every join are plain
    exchanges: the links of a node with very many of them can be split, and the least label
    is combined on the map side.  Nothing but one number per round reaches the driver.
    """
    both = cut_lineage(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        links.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "component-links")
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(
        F.least(F.min("dst"), F.col("node")).alias("root")), "component-labels")
    while True:
        told = (both.join(labels.select(F.col("node").alias("src"), "root"), "src")
                .groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("told")))
        near = cut_lineage(labels.join(told, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "told").alias("root")), "component-near")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = cut_lineage(near.join(jump, "root").select(
            "node", F.least("root", "far").alias("root"), "old"), "component-labels")
        if labels.where("root <> old").limit(1).count() == 0:
            return labels.select("node", "root")
