"""Plans, ingest and the versioned catalog on the golden library."""

import tempfile

import pytest
from pyspark.sql import functions as F

from medialake import schema as S
from medialake.operators import ingest as I
from medialake.plans import common as PC
from medialake.plans import conversion as CV
from medialake.sinks import catalog_store as CS
from medialake.streaming import catalog_stream as ST


def _inventory(lib):
    return lib.select("file_path", "file_size", "modified_at")


def test_encode_plan_protected_output_raises(spark, lib):
    listed = lib.where("file_path LIKE '%family_dinner.mp4'").select("file_path")
    # family_dinner_720p.mp4 is catalogued: encoding with suffix _720p must abort.
    with pytest.raises(PC.ProtectedOutputError):
        CV.encode_plan(listed, _inventory(lib), lib, "_720p")
    plan = CV.encode_plan(listed, _inventory(lib), lib, "_encoded").collect()
    assert {r.status for r in plan} == {"encode"}
    assert all(r.output_path.endswith("family_dinner_encoded.mp4") for r in plan)
    assert all(r.estimated_size == pytest.approx(r.original_size * 0.6) for r in plan)


def test_raw_convert_skips_existing_outputs(spark, lib):
    listed = lib.where("media_type = 'image'").select("file_path")
    out = spark.createDataFrame([("/lib/photos/raw_files/IMG_001_jpg.jpg", 15, 0.0)],
                                "file_path string, file_size bigint, modified_at double")
    plan = CV.raw_convert_plan(listed, _inventory(lib).unionByName(out), lib)
    got = {r.input_path: r.status for r in plan.collect()}
    assert got["/lib/photos/raw_files/IMG_001.dng"] == "skipped"
    assert got["/lib/photos/raw_files/IMG_002.dng"] == "convert"
    assert got["/lib/photos/2023/summer/IMG_001.jpg"] == "filtered"
    t = PC.conversion_totals(plan, "convert").first()
    assert (t.successes, t.skipped) == (8, 1) and t.percent_saved == pytest.approx(70.0)


def _scan_from(lib, bump):
    """Scan records re-rendering the catalog rows (images only, no JSON needed)."""
    return lib.where("media_type = 'image' AND NOT is_corrupted").select(
        "file_path", "file_size", (F.col("modified_at") + bump).alias("modified_at"),
        F.col("file_hash").alias("content_md5"), F.lit(None).cast("string").alias("probe_json"),
        F.lit(None).cast("string").alias("exif_json"), "width", "height",
        F.lit("JPEG").alias("image_format"), F.lit(None).cast("string").alias("error_kind"),
        F.lit(None).cast("string").alias("error_text"))


def test_incremental_build_skips_fresh_files(spark, lib):
    cat, status = I.build_catalog(lib, _scan_from(lib, 0.0), "/lib", now="2024-02-01 00:00:00")
    counts = I.status_counters(status).first()
    assert (counts.processed, counts.skipped) == (0, 34)
    cat, status = I.build_catalog(lib, _scan_from(lib, 5.0), "/lib", now="2024-02-01 00:00:00")
    counts = I.status_counters(status).first()
    assert (counts.processed, counts.skipped, counts.corrupted) == (34, 0, 0)
    assert cat.count() == 52


def test_stream_batches_are_idempotent(spark, lib):
    run = tempfile.mkdtemp(prefix="ml-stream-", dir="/tmp")
    base = f"{run}/catalog"
    CS.write_version(lib.select(*S.MEDIA_COLUMNS), base)
    batch = _scan_from(lib, 5.0)
    ST.process_batch(batch, 0, base, "/lib", "q1", now="2024-02-01 00:00:00")
    assert CS.versions(spark, base) == [0, 1]
    first = sorted(r.file_path for r in CS.read_current(spark, base).collect())
    # A replay of batch 0 (failure between write and checkpoint commit) does nothing.
    ST.process_batch(batch, 0, base, "/lib", "q1", now="2024-02-01 00:00:00")
    assert CS.versions(spark, base) == [0, 1]
    assert sorted(r.file_path for r in CS.read_current(spark, base).collect()) == first
    # Older records than the catalog's are dropped by the freshness rule.
    ST.process_batch(_scan_from(lib, -100.0), 1, base, "/lib", "q1", now="2024-03-01 00:00:00")
    v2 = CS.read_current(spark, base)
    assert v2.where("analyzed_at = TIMESTAMP_NTZ '2024-03-01 00:00:00'").count() == 0
    # A batch build between stream batches, and batch 0 of a new checkpoint: nothing is lost.
    CS.write_version(v2, base)
    new = batch.limit(1).withColumn("file_path", F.lit("/lib/late.jpg"))
    ST.process_batch(new, 0, base, "/lib", "q2", now="2024-04-01 00:00:00")
    assert CS.versions(spark, base) == [0, 1, 2, 3, 4]
    got = sorted(r.file_path for r in CS.read_current(spark, base).collect())
    assert got == sorted(first + ["/lib/late.jpg"])


def test_null_mtime_and_repeated_paths(spark, lib):
    scan = _scan_from(lib, 5.0).limit(1).withColumn("file_path", F.lit("/lib/x.jpg"))
    none = scan.withColumn("modified_at", F.lit(None).cast("double")).withColumn("file_size", F.lit(7).cast("long"))
    cat, _ = I.build_catalog(lib, none, "/lib", now="2024-02-01 00:00:00")
    assert cat.where("file_path = '/lib/x.jpg'").first().file_size == 7
    cat, _ = I.build_catalog(lib, none.unionByName(scan), "/lib", now="2024-02-01 00:00:00")
    assert cat.where("file_path = '/lib/x.jpg'").first().modified_at == scan.first().modified_at
    rows = I.analyze(scan.unionByName(none).unionByName(scan), now="2024-02-01 00:00:00")
    assert I.upsert(lib, rows).where("file_path = '/lib/x.jpg'").count() == 1


def test_max_files_and_root_slash(spark, lib):
    from medialake.operators import directories as dr
    cat, status = I.build_catalog(lib, _scan_from(lib, 5.0), "/lib", now="2024-02-01 00:00:00",
                                  max_files=5)
    assert I.status_counters(status).first().processed == 5
    files = spark.createDataFrame(
        [(f"/{d}/f{i}.jpg", 10, "image", False) for d in ("a", "b/c") for i in range(3)],
        "file_path string, file_size bigint, media_type string, is_corrupted boolean")
    tree = {r.dir_path: (r.total_files, r.subdirs_count) for r in dr.directory_tree(files).collect()}
    assert tree == {"/": (6, 2), "/a": (3, 0), "/b": (3, 1), "/b/c": (3, 0)}


def test_conversion_log_append(spark, lib):
    from medialake.sinks import text as TX
    listed = lib.where("media_type = 'image'").select("file_path")
    log = TX.conversion_log(CV.raw_convert_plan(listed, _inventory(lib), lib))
    path = tempfile.mkdtemp(prefix="ml-log-", dir="/tmp") + "/log"
    TX.append_log(log, path)
    TX.append_log(log, path)
    assert spark.read.parquet(path).count() == 2 * log.count() == 18
    assert log.first().message.startswith("CONVERT_SUCCESS: /lib/")
