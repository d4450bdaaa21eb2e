"""The bucketed catalog against a dictionary, its shared files, and the stream on it."""

import os
import random

from pyspark.sql import functions as F

from medialake import schema as S
from medialake.sinks import bucketed_catalog as BC
from medialake.streaming import catalog_stream as CST


def _rows(spark, found):
    """Catalog rows of (path, mtime, size)."""
    df = spark.createDataFrame(found, "file_path string, modified_at double, file_size long")
    out = df.withColumn("file_name", F.substring_index("file_path", "/", -1)).withColumn("media_type", F.lit("image"))
    for field in S.MEDIA_FILES_SCHEMA.fields:
        if field.name not in out.columns:
            out = out.withColumn(field.name, F.lit(None).cast(field.dataType))
    return out.select(*S.MEDIA_COLUMNS)


def _files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(f"{base}/data") for f in names if f.endswith(".parquet")}


def _content(df):
    return {r["file_path"]: (r["modified_at"], r["file_size"]) for r in df.collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    base, rng, want = str(tmp_path / "cat"), random.Random(7), {}
    assert BC.read(spark, base).count() == 0
    for n in range(4):
        batch = [(f"/lib/d{rng.randrange(9)}/f{rng.randrange(60)}.jpg", float(n * 1000 + i), rng.randrange(99))
                 for i in range(rng.choice([1, 40, 200]))]
        for path, mtime, size in batch:
            if path not in want or want[path][0] // 1000 < n or mtime > want[path][0]:
                want[path] = (mtime, size)
        assert BC.upsert(base, _rows(spark, batch), buckets=8) == n
        assert _content(BC.read(spark, base)) == want
        assert sum(rows for _, rows in BC.manifest(spark, base).values()) == len(want)
    assert BC._buckets(spark, base) == 8


def test_untouched_buckets_share_their_files(spark, tmp_path):
    base = str(tmp_path / "cat")
    BC.upsert(base, _rows(spark, [(f"/lib/f{i}.jpg", 1.0, i) for i in range(300)]), buckets=16)
    before, first = _files(base), BC.manifest(spark, base)
    one = _rows(spark, [("/lib/f7.jpg", 2.0, 700)])
    BC.upsert(base, one, buckets=99)  # the number of buckets stays as it was created
    after, second = _files(base), BC.manifest(spark, base)
    assert before.items() <= after.items()  # no file was changed or moved
    assert [b for b in first if first[b][0] != second[b][0]] == BC._touched(one, 16)
    assert len(after) - len(before) == 1 and len(first) == len(second) == 16
    touched = BC.read_touched(spark, base, one)
    assert len(touched.inputFiles()) == 1 and 0 < touched.count() < 60
    assert _content(BC.read(spark, base, 0))["/lib/f7.jpg"] == (1.0, 7)
    assert _content(BC.read(spark, base))["/lib/f7.jpg"] == (2.0, 700)


def test_replay_vacuum_and_empty_batch(spark, tmp_path):
    base = str(tmp_path / "cat")
    one = _rows(spark, [("/a.jpg", 1.0, 1), ("/b.jpg", 1.0, 2), (None, 3.0, 3)])
    assert BC.upsert(base, one, buckets=4, tag="q-0") == 0
    assert BC.upsert(base, _rows(spark, [("/a.jpg", 9.0, 9)]), tag="q-0") == 0  # the tag has a version: nothing written
    assert _content(BC.read(spark, base)) == {"/a.jpg": (1.0, 1), "/b.jpg": (1.0, 2), None: (3.0, 3)}
    assert BC.upsert(base, _rows(spark, []), tag="q-1") == 1
    assert BC.manifest(spark, base, 0) == BC.manifest(spark, base, 1)
    BC.upsert(base, _rows(spark, [("/a.jpg", 9.0, 9)]), tag="q-2")
    gone = BC.vacuum(spark, base)
    assert len(gone) == 1 and _content(BC.read(spark, base))["/a.jpg"] == (9.0, 9)
    assert BC.vacuum(spark, base) == [] and len(BC.manifest(spark, base)) == len(BC._touched(one, 4))


def _records(spark, found):
    df = spark.createDataFrame(found, "file_path string, modified_at double, file_size long")
    for field in S.SCAN_RECORDS_SCHEMA.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*S.SCAN_RECORDS_SCHEMA.names)


def test_stream_rewrites_only_touched_buckets(spark, tmp_path):
    """Later batches read and write the buckets of their records alone; a replayed batch does nothing."""
    records, base, checkpoint = (str(tmp_path / x) for x in ("records", "cat", "ck"))
    _records(spark, [(f"/lib/f{i}.dng", 1.0, i) for i in range(200)]).coalesce(1).write.parquet(records)
    CST.start(spark, records, base, checkpoint, "/lib").awaitTermination()
    first, before = BC.manifest(spark, base), _files(base)
    assert len(first) > 8
    batch = _records(spark, [("/lib/f3.dng", 5.0, 33), ("/lib/f4.dng", 0.5, 44)]).coalesce(1)
    batch.write.mode("append").parquet(records)
    CST.start(spark, records, base, checkpoint, "/lib").awaitTermination()
    second = BC.manifest(spark, base)
    assert _content(BC.read(spark, base))["/lib/f3.dng"] == (5.0, 33)
    assert _content(BC.read(spark, base))["/lib/f4.dng"] == (1.0, 4)  # older than the catalog: dropped
    changed = [b for b in first if first[b] != second[b]]
    assert changed == BC._touched(batch.where("file_path = '/lib/f3.dng'"), BC.BUCKETS)
    assert before.items() <= _files(base).items()
    versions = len(BC.CS.versions(spark, base))
    CST.process_batch(batch, 1, base, "/lib", CST.query_id(spark, checkpoint))
    assert len(BC.CS.versions(spark, base)) == versions
