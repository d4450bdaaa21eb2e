"""The reference's 52-file test library, written by hand as catalog rows (root /lib).

Sizes are chosen so that every label of the reference's golden outputs comes out
the same (group sizes, wasted space, directory totals); hashes stand for content
(equal hash = equal bytes = equal size).
"""

from __future__ import annotations

from datetime import datetime

from medialake import schema as S

# (relative path, size, hash, media_type, corrupted)
G1, G2, G3, G4 = "h1_summer", "h2_photo1", "h3_dng", "h4_video1"
G5, G6, G7, G8 = "h5_nometa", "h6_avi", "h7_dinner", "h8_winter"

FILES = [
    # photos/2023/summer (+ camera1, camera2): group 1
    ("photos/2023/summer/IMG_001.jpg", 1045, G1), ("photos/2023/summer/IMG_001_720p.jpg", 1045, G1),
    ("photos/2023/summer/IMG_001_edited.jpg", 1045, G1), ("photos/2023/summer/IMG_002.jpg", 1045, G1),
    ("photos/2023/summer/IMG_002_final.jpg", 1045, G1),
    ("photos/2023/summer/camera1/IMG_001.jpg", 1045, G1),
    ("photos/2023/summer/camera1/IMG_001_cam1.jpg", 1045, G1),
    ("photos/2023/summer/camera1/IMG_002_cam1.jpg", 1045, G1),
    ("photos/2023/summer/camera2/IMG_001.jpg", 1045, G1),
    ("photos/2023/summer/camera2/IMG_001_cam2.jpg", 1045, G1),
    # group 2: mixed content photos and vacation
    ("mixed_content/photo1.jpg", 1045, G2), ("mixed_content/photo1_thumb.jpg", 1045, G2),
    ("mixed_content/subfolder1/photo1.jpg", 1045, G2),
    ("mixed_content/subfolder1/photo_sub1.jpg", 1045, G2),
    ("mixed_content/subfolder2/photo1.jpg", 1045, G2),
    ("mixed_content/subfolder2/photo_sub2.jpg", 1045, G2),
    ("photos/2024/vacation/IMG_004.jpg", 1045, G2), ("photos/2024/vacation/IMG_004_HDR.jpg", 1045, G2),
    ("photos/2024/vacation/day1/IMG_004.jpg", 1045, G2),
    ("photos/2024/vacation/day1/IMG_005_day1.jpg", 1045, G2),
    # group 3: RAW files
    ("photos/2024/vacation/DSC_001.dng", 50, G3), ("photos/raw_files/IMG_001.dng", 50, G3),
    ("photos/raw_files/IMG_002.dng", 50, G3), ("photos/raw_files/canon/CR3_001.dng", 50, G3),
    ("photos/raw_files/canon/CR3_002.dng", 50, G3), ("photos/raw_files/canon/IMG_001.dng", 50, G3),
    ("photos/raw_files/nikon/IMG_002.dng", 50, G3), ("photos/raw_files/nikon/NEF_001.dng", 50, G3),
    ("photos/raw_files/nikon/NEF_002.dng", 50, G3),
    # group 4: mp4 copies
    ("mixed_content/subfolder1/video1.mp4", 2060, G4),
    ("mixed_content/subfolder1/video_sub1.mp4", 2060, G4),
    ("mixed_content/subfolder2/video1.mp4", 2060, G4), ("mixed_content/video1.mp4", 2060, G4),
    ("mixed_content/video1_compressed.mp4", 2060, G4),
    ("videos/2023/family/family_dinner_720p.mp4", 2060, G4),
    ("videos/2023/family/kids/family_dinner.mp4", 2060, G4),
    ("videos/2023/family/kids/kids_playing.mp4", 2060, G4),
    # group 5: JPEGs without date
    ("mixed_content/no_meta.jpg", 820, G5), ("photos/no_metadata/no_date_1.jpg", 820, G5),
    ("photos/no_metadata/no_date_2.jpg", 820, G5),
    # group 6: legacy AVI
    ("videos/legacy/ancient_clip.avi", 14920, G6), ("videos/legacy/old_video.avi", 14920, G6),
    # group 7
    ("videos/2023/family/family_dinner.mp4", 2410, G7), ("videos/2024/events/birthday.mp4", 2410, G7),
    # group 8
    ("photos/2023/winter/IMG_003.jpg", 1048, G8), ("photos/2023/winter/IMG_003_bw.jpg", 1048, G8),
    # unique videos
    ("videos/2023/family/picnic.mp4", 2820, "u1"), ("videos/2024/events/party.mp4", 3570, "u2"),
]
CORRUPTED = [
    ("photos/no_metadata/corrupted.jpg", 34), ("videos/corrupted/broken1.mp4", 36),
    ("videos/corrupted/broken2.avi", 36), ("mixed_content/broken.jpg", 34),
]
NO_DATE = {"mixed_content/no_meta.jpg", "photos/no_metadata/no_date_1.jpg",
           "photos/no_metadata/no_date_2.jpg"}
MTIMES = [datetime(2024, 6, 15, 14, 30), datetime(2023, 3, 20, 10, 15), datetime(2022, 12, 25, 16, 45)]
CLOCK = datetime(2024, 1, 15, 10, 30)
ROOT = "/lib"


def rows():
    out = []
    for n, (rel, size, h) in enumerate(FILES):
        ext = rel.rsplit(".", 1)[1]
        video = ext in ("mp4", "avi")
        raw = ext == "dng"
        mtime = MTIMES[n % 3].timestamp() - 0.0
        created = None if (video or raw or rel in NO_DATE) else datetime(2023, 3, 20, 10, 15)
        out.append(dict(
            id=n + 1, file_path=f"{ROOT}/{rel}", file_name=rel.rsplit("/", 1)[1], file_size=size,
            file_hash=h, media_type="video" if video else "image", creation_date=created,
            duration=(2.0 if ext == "mp4" else 1.0) if video else None,
            width=None if raw else (320 if ext == "mp4" else 160 if ext == "avi" else 100),
            height=None if raw else (240 if ext == "mp4" else 120 if ext == "avi" else 100),
            codec_name=("h264" if ext == "mp4" else "mjpeg") if video else None,
            codec_long_name=None, bit_rate=(16400 if ext == "mp4" else 119300) if video else None,
            frame_rate=30.0 if video else None,
            format_name=("mov,mp4,m4a,3gp,3g2,mj2" if ext == "mp4" else "avi") if video
            else ("dng" if raw else "jpeg"),
            format_long_name=None, is_corrupted=False, error_message=None, analyzed_at=CLOCK,
            modified_at=mtime))
    for m, (rel, size) in enumerate(CORRUPTED):
        video = rel.endswith((".mp4", ".avi"))
        out.append(dict(
            id=len(FILES) + m + 1, file_path=f"{ROOT}/{rel}", file_name=rel.rsplit("/", 1)[1],
            file_size=size, file_hash=None, media_type="video" if video else "image",
            creation_date=None, duration=None, width=None, height=None, codec_name=None,
            codec_long_name=None, bit_rate=None, frame_rate=None, format_name=None,
            format_long_name=None, is_corrupted=True, error_message="corrupted",
            analyzed_at=CLOCK, modified_at=MTIMES[m % 3].timestamp()))
    return out


def catalog(spark):
    return spark.createDataFrame([tuple(r[c] for c in S.MEDIA_COLUMNS) for r in rows()],
                                 S.MEDIA_FILES_SCHEMA)
