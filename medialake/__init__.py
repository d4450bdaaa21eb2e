"""medialake: media-library catalog analytics on Spark.

Entry points:

* ``medialake.registry.queries()`` -- every operator as ``(spark, sf_dir) -> DataFrame``;
* ``medialake.oracle.sql()`` -- the DuckDB statement computing the same result;
* ``medialake.operators`` / ``medialake.plans`` -- the DataFrame functions themselves
  (catalog -> report or plan), usable on any catalog table with the
  ``schema.MEDIA_FILES_SCHEMA`` columns;
* ``medialake.streaming.catalog_stream.start`` -- keep a versioned catalog current
  from a stream of scan-record files.
"""
