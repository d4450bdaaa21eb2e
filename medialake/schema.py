"""Fixed values and table schemas of the media catalog.

The values under "Fixed values" must equal the reference tool's own lists for the
results to agree; they are written out plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the reference tool's behaviour)
# ---------------------------------------------------------------------------

# Supported video formats.
VIDEO_EXTENSIONS = (
    ".mp4", ".avi", ".mkv", ".mov", ".mod", ".wmv", ".flv", ".webm",
    ".m4v", ".3gp", ".ogv", ".f4v", ".asf", ".rm", ".rmvb",
    ".vob", ".ts", ".mts", ".m2ts", ".mpg", ".mpeg", ".m2v",
)

# RAW image formats (every one is four characters long, dot included).
RAW_EXTENSIONS = (
    ".raw", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf",
    ".rw2", ".pef", ".srw", ".raf", ".3fr", ".ari", ".srf",
    ".sr2", ".bay", ".crw", ".erf", ".mef", ".mrw", ".nrw",
    ".rwl", ".rwz", ".x3f",
)

# Ordinary image formats; images are these plus RAW.
PLAIN_IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif",
    ".webp", ".heic", ".heif",
)

# Outdated video codecs (codec_name) and containers (format_name).
OUTDATED_CODECS = ("mpeg2video", "mjpeg", "mpeg4", "mpeg1video")
OUTDATED_FORMATS = ("mpeg", "mpegts")

# Containers that cannot hold a creation time.
NO_DATE_METADATA_EXTENSIONS = (".mpg", ".mpeg", ".m2v", ".vob", ".dat")

# Error phrases that mark an image as corrupted when the decoder reports them.
CRITICAL_IMAGE_ERRORS = (
    "truncated file read",
    "broken data stream",
    "cannot identify image file",
    "image file is truncated",
    "decoder error",
    "corrupt jpeg data",
    "invalid image file",
)

# Scan-record error kinds: the video probe failed (corrupted output, timeout, other
# probe failure) or the image decoder failed (alone, or together with the EXIF read).
VIDEO_ERROR_KINDS = ("corrupted", "timeout", "probe_failed")
IMAGE_ERROR_KINDS = ("image_error", "image_error_exif_failed")

# Dry-run size estimates: encoded video ~60 % of input, RAW -> JPEG ~30 %.
VIDEO_ESTIMATE_RATIO = 0.6
RAW_ESTIMATE_RATIO = 0.3

# Resolution tolerance (pixels per side) for the album-by-resolution tool.
RESOLUTION_TOLERANCE = 10

# Derived sets.
IMAGE_EXTENSIONS = PLAIN_IMAGE_EXTENSIONS + RAW_EXTENSIONS
SUPPORTED_EXTENSIONS = VIDEO_EXTENSIONS + IMAGE_EXTENSIONS

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

MEDIA_FILES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("creation_date", T.TimestampNTZType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("codec_name", T.StringType()),
    T.StructField("codec_long_name", T.StringType()),
    T.StructField("bit_rate", T.LongType()),
    T.StructField("frame_rate", T.DoubleType()),
    T.StructField("format_name", T.StringType()),
    T.StructField("format_long_name", T.StringType()),
    T.StructField("is_corrupted", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("analyzed_at", T.TimestampNTZType()),
    T.StructField("modified_at", T.DoubleType()),
])

MEDIA_COLUMNS = [f.name for f in MEDIA_FILES_SCHEMA.fields]

SCAN_RECORDS_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_size", T.LongType()),
    T.StructField("modified_at", T.DoubleType()),
    T.StructField("content_md5", T.StringType()),
    T.StructField("probe_json", T.StringType()),
    T.StructField("exif_json", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("image_format", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error_text", T.StringType()),
])

# Probe document of a video (the part of the probe tool's JSON the catalog uses).
PROBE_SCHEMA = T.StructType([
    T.StructField("format", T.StructType([
        T.StructField("duration", T.StringType()),
        T.StructField("bit_rate", T.StringType()),
        T.StructField("format_name", T.StringType()),
        T.StructField("format_long_name", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("streams", T.ArrayType(T.StructType([
        T.StructField("codec_type", T.StringType()),
        T.StructField("codec_name", T.StringType()),
        T.StructField("codec_long_name", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("r_frame_rate", T.StringType()),
    ]))),
])

# EXIF document of an image: array of one object with three date fields.
EXIF_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("DateTimeOriginal", T.StringType()),
    T.StructField("CreateDate", T.StringType()),
    T.StructField("CreationDate", T.StringType()),
]))

ASSET_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("isTrashed", T.BooleanType()),
    T.StructField("originalFileName", T.StringType()),
    T.StructField("exifInfo", T.StructType([
        T.StructField("exifImageWidth", T.IntegerType()),
        T.StructField("exifImageHeight", T.IntegerType()),
        T.StructField("dateTimeOriginal", T.StringType()),
    ])),
])

ALBUM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("albumName", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("assetIds", T.ArrayType(T.StringType())),
])

PLAN_SCHEMA = T.StructType([
    T.StructField("input_path", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("original_size", T.LongType()),
    T.StructField("estimated_size", T.DoubleType()),
    T.StructField("method", T.StringType()),
    T.StructField("suggested_at", T.TimestampNTZType()),
])
