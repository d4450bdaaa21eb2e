"""The reference's golden numbers (its 15 end-to-end scenarios) on the hand-built
52-file library."""

from pyspark.sql import functions as F

from medialake.functions import formats as FM
from medialake.operators import directories as dr
from medialake.operators import duplicates as dup
from medialake.operators import reports as rp


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_library_stats(lib):
    s = one(rp.library_stats(lib))
    assert (s.total_files, s.video_files, s.image_files, s.valid_files, s.corrupted_files) == \
        (52, 16, 36, 48, 4)
    assert f"{s.total_size_gb:.2f}" == "0.00" and f"{s.total_duration_hours:.2f}" == "0.01"


def test_top_codecs_and_resolutions(lib):
    assert [(r.codec_name, r["count"]) for r in rp.top_codecs(lib).orderBy("rank").collect()] == \
        [("h264", 12), ("mjpeg", 2)]
    assert [(r.resolution, r["count"]) for r in rp.top_resolutions(lib).orderBy("rank").collect()] \
        == [("100x100", 25), ("320x240", 12), ("160x120", 2)]


def test_duplicates(lib):
    w = one(dup.wasted_space(lib))
    assert (w.duplicate_groups, w.copies) == (8, 38)
    assert one(lib.sparkSession.range(1).select(FM.file_size_label(F.lit(w.wasted_bytes)).alias("s"))).s \
        == "52.4 KB"
    # The 10-member group: original is the first path (no patterns).
    members = dup.duplicate_report(lib).where("file_hash = 'h1_summer'").orderBy("copy_no").collect()
    assert len(members) == 10
    assert members[0].file_path == "/lib/photos/2023/summer/IMG_001.jpg" and members[0].is_original
    assert [m.file_path.rsplit("/", 2)[-2:] for m in members[1:3]] == \
        [["summer", "IMG_001_720p.jpg"], ["summer", "IMG_001_edited.jpg"]]
    assert members[0].group_no in (1, 2)  # two 10-member groups; hash breaks the tie


def test_duplicate_patterns_pick_original(lib):
    res = dup.classify_duplicates(lib, ["summer"]).where("file_hash = 'h1_summer'")
    # every path contains the pattern: the first path stays the original
    assert res.where("is_original").first().file_path == "/lib/photos/2023/summer/IMG_001.jpg"
    res = dup.classify_duplicates(lib, ["summer/IMG"]).where("file_hash = 'h1_summer'")
    assert res.where("is_original").first().file_path == "/lib/photos/2023/summer/camera1/IMG_001.jpg"
    dl = dup.copies_to_delete(lib, ["camera"]).where("file_hash = 'h1_summer'").collect()
    assert sorted(r.file_path.split("/lib/photos/2023/summer/")[1] for r in dl) == \
        ["camera1/IMG_001.jpg", "camera1/IMG_001_cam1.jpg", "camera1/IMG_002_cam1.jpg",
         "camera2/IMG_001.jpg", "camera2/IMG_001_cam2.jpg"]


def test_no_creation_date(lib):
    rows = rp.no_creation_date(lib).collect()
    assert len(rows) == 26
    assert sum(r.media_type == "image" for r in rows) == 12
    assert sum(r.media_type == "video" for r in rows) == 14
    by_path = {r.file_path: r for r in rows}
    assert by_path["/lib/photos/2024/vacation/DSC_001.dng"].path_date == "2024-01-01 00:00:00"
    no_path = by_path["/lib/photos/raw_files/IMG_001.dng"]
    assert no_path.path_date is None and no_path.suggested_date == no_path.mtime_date


def test_old_videos(lib):
    rows = rp.outdated_videos(lib)
    s = one(rp.export_summary(rows).select(
        "files", FM.file_size_label(F.col("total_size")).alias("size"),
        FM.duration_label(F.col("total_duration")).alias("dur")))
    assert (s.files, s["size"], s.dur) == (2, "29.1 KB", "00:02")
    labels = rows.select(FM.bitrate_label(F.col("bit_rate")).alias("b")).collect()
    assert {r.b for r in labels} == {"119.3 kbit/s"}


def test_suffix_files(lib):
    rows = rp.suffix_with_original(lib, "_720p").collect()
    assert sorted(r.original_base for r in rows) == ["IMG_001", "family_dinner"]


def test_corrupted_depth_order(lib):
    rows = rp.depth_order(rp.corrupted_files(lib)).collect()
    assert [r.file_path for r in rows] == [
        "/lib/photos/no_metadata/corrupted.jpg", "/lib/videos/corrupted/broken1.mp4",
        "/lib/videos/corrupted/broken2.avi", "/lib/mixed_content/broken.jpg"]


def test_high_bitrate_empty(lib):
    assert rp.high_bitrate_export(lib, 15, 50).count() == 0


EXPECTED_TREE = """/lib/ [3 dirs, 34 images, 14 videos, 81.5 KB]
/lib/mixed_content/ [2 dirs, 7 images, 5 videos, 17.0 KB]
/lib/mixed_content/subfolder1/ [2 images, 2 videos, 6.1 KB]
/lib/mixed_content/subfolder2/ [2 images, 1 video, 4.1 KB]
/lib/photos/ [4 dirs, 27 images, 18.4 KB]
/lib/photos/2023/ [2 dirs, 12 images, 12.3 KB]
/lib/photos/2023/summer/ [2 dirs, 10 images, 10.2 KB]
/lib/photos/2023/summer/camera1/ [3 images, 3.1 KB]
/lib/photos/2023/summer/camera2/ [2 images, 2.0 KB]
/lib/photos/2023/winter/ [2 images, 2.0 KB]
/lib/photos/2024/ [1 dir, 5 images, 4.1 KB]
/lib/photos/2024/vacation/ [1 dir, 5 images, 4.1 KB]
/lib/photos/2024/vacation/day1/ [2 images, 2.0 KB]
/lib/photos/no_metadata/ [2 images, 1.6 KB]
/lib/photos/raw_files/ [2 dirs, 8 images, 400.0 B]
/lib/photos/raw_files/canon/ [3 images, 150.0 B]
/lib/photos/raw_files/nikon/ [3 images, 150.0 B]
/lib/videos/ [3 dirs, 9 videos, 46.1 KB]
/lib/videos/2023/ [1 dir, 5 videos, 11.1 KB]
/lib/videos/2023/family/ [1 dir, 5 videos, 11.1 KB]
/lib/videos/2023/family/kids/ [2 videos, 4.0 KB]
/lib/videos/2024/ [1 dir, 2 videos, 5.8 KB]
/lib/videos/2024/events/ [2 videos, 5.8 KB]
/lib/videos/legacy/ [2 videos, 29.1 KB]"""


def test_directory_tree(lib):
    tree = dr.directory_tree(lib)
    lines = [r.line for r in dr.tree_lines(dr.preorder(tree)).collect()]
    assert "\n".join(lines) == EXPECTED_TREE
    top = dr.largest_dirs(tree, 5).orderBy("rank").collect()
    assert [(r.dir_path, r.total_files) for r in top] == [
        ("/lib", 48), ("/lib/videos", 9), ("/lib/videos/legacy", 2), ("/lib/photos", 27),
        ("/lib/mixed_content", 12)]
    assert top[0].remaining_dirs == 19
    assert dr.common_root(dr.direct_stats(lib)) == "/lib"


GOLDEN_CORRUPTED = """# List of corrupted files
# Found 4 files
# Created: 2024-01-15 10:30:00
#
# Format: file_path | type | size | duration | bitrate | resolution | codec
#====================================================================================================

# IMAGE | 34.0 B | N/A | N/A | N/A | N/A
/lib/photos/no_metadata/corrupted.jpg

# VIDEO | 36.0 B | N/A | N/A | N/A | N/A
/lib/videos/corrupted/broken1.mp4

# VIDEO | 36.0 B | N/A | N/A | N/A | N/A
/lib/videos/corrupted/broken2.avi

# IMAGE | 34.0 B | N/A | N/A | N/A | N/A
/lib/mixed_content/broken.jpg

#====================================================================================================
# SUMMARY:
# Total files: 4 (Videos: 2, Images: 2)
# Total size: 140.0 B
"""


def _written_text(spark, blocks):
    import glob
    import tempfile
    from medialake.sinks import text as TX
    out = tempfile.mkdtemp(prefix="ml-export-", dir="/tmp") + "/export"
    TX.write_blocks(blocks, out)
    return "".join(open(f).read() for f in sorted(glob.glob(out + "/part-*")))


def test_export_list_matches_golden_bytes(spark, lib):
    from medialake.sinks import text as TX
    blocks = TX.export_blocks(rp.corrupted_files(lib), "corrupted files")
    assert _written_text(spark, blocks) == GOLDEN_CORRUPTED
    old = _written_text(spark, TX.export_blocks(rp.outdated_videos(lib),
                                                "video files with outdated codecs/formats"))
    assert old.endswith("# Total files: 2 (Videos: 2, Images: 0)\n# Total size: 29.1 KB\n"
                        "# Total duration: 00:02\n")
    assert "# VIDEO | 14.6 KB | 00:01 | 119.3 kbit/s | 160x120 | mjpeg\n" \
           "/lib/videos/legacy/ancient_clip.avi\n\n" in old
