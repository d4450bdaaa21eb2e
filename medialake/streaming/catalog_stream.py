"""Keep the catalog current from a stream of scan-record files.

Scan records land as Parquet files in a folder (one file set per scan batch);
``readStream`` picks up new files, and each micro-batch runs the freshness anti
join (J2) and the upsert (B1) against the buckets of the current catalog version that its
paths fall into, and writes those buckets anew (``sinks.bucketed_catalog``); what a batch
reads and writes follows its own size, not the catalog's.  The late-data rule is the reference's freshness test: a record
whose mtime is not newer than the catalog's is dropped.  A version is tagged with the
query's id (kept in its checkpoint) and the batch id, so a replayed batch (after a failure
between the write and the checkpoint commit) finds its version and does nothing, while
batches of another query, of a new checkpoint or of a batch build never pass for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import ingest as I
from ..sinks import bucketed_catalog as BC
from ..sinks import catalog_store as CS


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query wrote into its checkpoint when it first started."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def process_batch(batch: DataFrame, batch_id: int, catalog_base: str, root: str,
                  query: str, now: str | None = None) -> None:
    spark = batch.sparkSession
    tag = f"{query}-{batch_id}"
    if CS.has_tag(spark, catalog_base, tag):
        return  # replay of a committed batch: idempotent
    _, rows = I.fresh_rows(BC.read_touched(spark, catalog_base, batch), batch, root, now=now)
    BC.upsert(catalog_base, rows, tag=tag)


def start(spark: SparkSession, records_dir: str, catalog_base: str, checkpoint: str,
          root: str, now: str | None = None, available_now: bool = True,
          max_files_per_trigger: int = 64):
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    stream = (spark.readStream.schema(S.SCAN_RECORDS_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(records_dir))
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, catalog_base, root,
                                                          query_id(spark, checkpoint), now))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()
