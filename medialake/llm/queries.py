"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (bitmixer, centroids, decontaminate, divergence, licenses, mainhtml, mixing, orderminhash,
               quality, secrets, sharding, tokencounts, urlfilter)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_order_minhash": lambda s, d: orderminhash.class_table(table(s, d, "documents")),
        "op2_quality_rules": lambda s, d: quality.quality_table(table(s, d, "documents")),
        "op3_sharding": lambda s, d: sharding.shard_table(table(s, d, "documents")),
        "op4_main_text": lambda s, d: mainhtml.extract(table(s, d, "pages")),
        "op5_decontamination": lambda s, d: decontaminate.contamination_table(
            table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_mixing": lambda s, d: mixing.mixture_table(table(s, d, "documents")),
        "op7_token_counts": lambda s, d: tokencounts.token_count_table(table(s, d, "documents")),
        "op8_secret_scan": lambda s, d: secrets.scan_texts(table(s, d, "documents")),
        "op9_license_scan": lambda s, d: licenses.license_table(table(s, d, "documents")),
        "op10_url_filter": lambda s, d: urlfilter.verdict_table(table(s, d, "pages")),
        "op11_centroid_clusters": lambda s, d: centroids.cluster_table(table(s, d, "embeddings")),
        "op12_source_divergence": lambda s, d: divergence.divergence_table(table(s, d, "documents")),
        "op13_bit_mixing": lambda s, d: bitmixer.score_table(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_quality_rules": quality.ORACLE_SQL, "op5_decontamination": decontaminate.ORACLE_SQL,
           "op6_mixing": mixing.ORACLE_SQL, "op11_centroid_clusters": centroids.ORACLE_SQL,
           "op12_source_divergence": divergence.ORACLE_SQL,
           "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text is not None}
