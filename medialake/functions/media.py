"""Media-kind and small per-file helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import paths as P


def media_kind(path) -> Column:
    """``video``, ``raw``, ``image`` or ``unsupported`` from the lower-case extension."""
    ext = P.lower_extension(path)
    return (F.when(ext.isin(*S.VIDEO_EXTENSIONS), F.lit("video"))
            .when(ext.isin(*S.RAW_EXTENSIONS), F.lit("raw"))
            .when(ext.isin(*S.PLAIN_IMAGE_EXTENSIONS), F.lit("image"))
            .otherwise(F.lit("unsupported")))


def catalog_media_type(path) -> Column:
    """The catalog's ``media_type``: RAW counts as image."""
    k = media_kind(path)
    return F.when(k == "raw", F.lit("image")).when(k == "video", F.lit("video"))


def is_supported(path) -> Column:
    """C13."""
    return P.lower_extension(path).isin(*S.SUPPORTED_EXTENSIONS)


def estimated_size(size, kind: str) -> Column:
    """Dry-run output size, 0.6 x for encoded video, 0.3 x for RAW -> JPEG."""
    ratio = S.VIDEO_ESTIMATE_RATIO if kind == "video" else S.RAW_ESTIMATE_RATIO
    c = F.col(size) if isinstance(size, str) else size
    return c * F.lit(ratio)


def mbit_to_bits(mbit: float) -> int:
    """H17."""
    return int(mbit * 1_000_000)


def mb_to_bytes(mb: float) -> int:
    """H17."""
    return int(mb * 1024 * 1024)


def image_format_defaults(path) -> tuple[Column, Column]:
    """Format name and long name from the extension (``jpg``/``JPG Image``;
    RAW: ``dng``/``DNG RAW Image``)."""
    ext = F.substr(P.lower_extension(path), F.lit(2))
    raw = P.lower_extension(path).isin(*S.RAW_EXTENSIONS)
    return ext, F.when(raw, F.concat(F.upper(ext), F.lit(" RAW Image"))).otherwise(
        F.concat(F.upper(ext), F.lit(" Image")))
