"""Human-readable labels (H1-H7, H22, H23) as built-in expressions.

Rounding: the reference prints one decimal of a binary double (Python's correctly
rounded, ties-to-even ``%.1f``).  Sizes are integers divided by powers of 1024, so
the double is exact and ``bround`` (HALF_EVEN) of it is the same number.  Bitrates
are divided by powers of 1000; we round the exact quotient half-even, which differs
from the reference only when the quotient is a decimal tie that binary cannot hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _one_decimal(value: Column, unit: str) -> Column:
    return F.format_string("%.1f " + unit, F.bround(value, 1))


def _size_ladder(size: Column, units: list[str], last: str) -> Column:
    expr = None
    for k, unit in enumerate(units):
        cond = size < F.lit(float(1024 ** (k + 1)))
        val = _one_decimal(size / F.lit(float(1024 ** k)), unit)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(_one_decimal(size / F.lit(float(1024 ** len(units))), last))


def file_size_label(size) -> Column:
    """H1, catalog reports: ``N/A`` for NULL; B, KB, MB, GB, TB, then PB."""
    s = _c(size).cast("double")
    return F.when(s.isNull(), F.lit("N/A")).otherwise(
        _size_ladder(s, ["B", "KB", "MB", "GB", "TB"], "PB"))


def plan_size_label(size) -> Column:
    """H2, plan tools: B, KB, MB, GB, then TB (``N/A`` for NULL)."""
    s = _c(size).cast("double")
    return F.when(s.isNull(), F.lit("N/A")).otherwise(
        _size_ladder(s, ["B", "KB", "MB", "GB"], "TB"))


def move_size_label(size) -> Column:
    """H3, flatten tool: ``0 B`` for zero, else the power of 1024 below the value and
    ``round(x, 1)`` printed the Python way (``12.0 KB``)."""
    s = _c(size).cast("double")
    expr = F.when(s == 0, F.lit("0 B"))
    for k, unit in enumerate(["B", "KB", "MB", "GB"]):
        expr = expr.when(s < F.lit(float(1024 ** (k + 1))),
                         F.concat(F.bround(s / F.lit(float(1024 ** k)), 1).cast("string"),
                                  F.lit(" " + unit)))
    return expr.otherwise(F.concat(F.bround(s / F.lit(float(1024 ** 4)), 1).cast("string"),
                                   F.lit(" TB")))


def bitrate_label(bit_rate) -> Column:
    """H4: ``N/A`` for NULL or 0; kbit/s below 1 Mbit/s, Mbit/s below 1000, else Gbit/s."""
    b = _c(bit_rate).cast("double")
    tenths = lambda div: F.bround(b / F.lit(div / 10.0), 0) / F.lit(10.0)
    return (F.when(b.isNull() | (b == 0), F.lit("N/A"))
            .when(b < 1_000_000, F.format_string("%.1f kbit/s", tenths(1_000.0)))
            .when(b < 1_000_000_000, F.format_string("%.1f Mbit/s", tenths(1_000_000.0)))
            .otherwise(F.format_string("%.1f Gbit/s", tenths(1_000_000_000.0))))


def _hms(d: Column):
    hours = F.floor(d / 3600)
    minutes = F.floor(F.pmod(d, F.lit(3600.0)) / 60)
    seconds = F.floor(F.pmod(d, F.lit(60.0)))
    return hours, minutes, seconds


def duration_label(duration) -> Column:
    """H5, catalog reports: ``N/A`` for NULL or 0; ``HH:MM:SS`` with hours, else ``MM:SS``."""
    d = _c(duration).cast("double")
    h, m, s = _hms(d)
    return (F.when(d.isNull() | (d == 0), F.lit("N/A"))
            .when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s))
            .otherwise(F.format_string("%02d:%02d", m, s)))


def minutes_label(duration) -> Column:
    """H6, conversion log: ``MM:SS`` where minutes may exceed 59."""
    d = _c(duration).cast("double")
    return F.when(d.isNull(), F.lit("N/A")).otherwise(
        F.format_string("%02d:%02d", F.floor(d / 60), F.floor(F.pmod(d, F.lit(60.0)))))


def encoder_duration_label(duration) -> Column:
    """H7, encoder: like H5 but 0 gives ``00:00``."""
    d = _c(duration).cast("double")
    h, m, s = _hms(d)
    return (F.when(d.isNull(), F.lit("N/A"))
            .when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s))
            .otherwise(F.format_string("%02d:%02d", m, s)))


def resolution_label(width, height) -> Column:
    """``WxH``; NULL when either side is NULL (SQL ``||`` semantics)."""
    return F.concat(_c(width).cast("string"), F.lit("x"), _c(height).cast("string"))


def short_hash(h) -> Column:
    """First 16 characters of a hash."""
    return F.substring(_c(h), 1, 16)


def short_codec(codec, width: int = 7) -> Column:
    """Codec cut to 7 (reports) or 8 (duplicate report) characters, ``N/A`` if empty."""
    c = _c(codec)
    return F.when(c.isNull() | (c == ""), F.lit("N/A")).otherwise(F.substring(c, 1, width))


def status_label(is_corrupted) -> Column:
    return F.when(_c(is_corrupted), F.lit("BAD")).otherwise(F.lit("OK"))


def size_severity(size) -> Column:
    """> 1e9 bytes is ``high``, > 1e8 ``medium``, else ``low``."""
    s = _c(size)
    return F.when(s > 1_000_000_000, "high").when(s > 100_000_000, "medium").otherwise("low")


def compression_percent(original, output) -> Column:
    """(in - out) / in * 100, 0 when in is 0."""
    o, n = _c(original).cast("double"), _c(output).cast("double")
    return F.when(o > 0, (o - n) / o * 100.0).otherwise(F.lit(0.0))


def bitrate_severity(bit_rate) -> Column:
    """Bitrate above 50 Mbit/s is ``high``."""
    b = _c(bit_rate)
    return F.when(b > 50_000_000, F.lit("high")).otherwise(F.lit("normal"))


def duration_severity(duration) -> Column:
    """Longer than an hour is ``long``."""
    d = _c(duration)
    return F.when(d > 3600, F.lit("long")).otherwise(F.lit("normal"))
