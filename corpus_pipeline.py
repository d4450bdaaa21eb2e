"""The corpus pipeline: documents in, an interleaved and sharded training mixture out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of documents.

Scratch tables.  What a stage writes for itself is needed until its result has been written, which is
so when the next stage begins: that stage then deletes it, unless its own input still reads it.
``run`` also deletes each stage's stored result when the one after it is stored.

Defined results.  Every stage takes nulls in any column, empty and very long texts, repeated rows, further
columns (kept as they are) and empty tables, as the docstrings of its operator say; an empty
table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medialake.llm import decontaminate, mixing, orderminhash, quality, sharding
from medialake.llm.common import table
from medialake.session import cut_lineage, drop_tables, table_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule, or whose host is rejected, go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one of least id."""
    return orderminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.interleave(docs)


#: Per application and number of a stage: the tables it wrote for itself when it last ran.
_scratch: dict[tuple[str, int], list[str]] = {}


def _stage(number: int, work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_tables(spark, _scratch.pop((app, number - 1), []), reader=docs)
        with table_scope() as made:
            out = work(spark, docs, sf_dir)
        _scratch[app, number] = made
        return out

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


STAGES = [(name, _stage(number, work)) for number, (name, work) in enumerate([
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
])]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with table_scope() as made:
            docs = cut_lineage(result, "pipeline-" + name.replace(" ", "-"))
        drop_tables(spark, stored)
        stored = made
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-dedup's alignment and components have no SQL form.
ORACLE_SQL = None
