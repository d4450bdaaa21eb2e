"""Dates read from paths, names, EXIF and probe text.

All are built-in expressions: ``regexp_extract`` takes the first match of a
pattern (as Python's ``re.search`` does) and ``try_make_timestamp_ntz`` turns the
groups into a naive timestamp or NULL.  Python's ``datetime`` also rejects year 0
and second 60, which Spark would accept or roll over, so both are guarded.  An
invalid date falls through to the next pattern, like the reference.

Java's ``\\d``, ``\\s`` and ``\\w`` are ASCII; Python's are Unicode.  Names with
non-ASCII digits or letters in the date part differ (documented, unit-tested).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P

# ---------------------------------------------------------------------------
# The date patterns of the reference tools, in their order.
# ---------------------------------------------------------------------------

# Full date-times in a file name (path tool).
PATH_NAME_PATTERNS = (
    r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2})-(\d{2})-(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})",
    r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})",
)
# In any path component: year.month.day, then year.month.<word>, then a bare year.
PATH_DAY_PATTERN = r"(\d{4})\.(\d{2})\.(\d{2})"
PATH_MONTH_PATTERN = r"(\d{4})\.(\d{2})\.\w+"
PATH_YEAR_PATTERN = r"^\d{4}$"
PATH_YEAR_RANGE = (1900, 2030)

# Asset tool: case-insensitive; first with an extension, then without.
NAME_EXTENSIONS = "jpg|jpeg|png|gif|bmp|tiff|webp|mp4|mov|avi|mkv|wmv|flv|m4v|3gp"
NAME_PATTERNS_BASE = (
    r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2})-(\d{2})-(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})",
    r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})",
    r"(IMG|VID)_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})",
)
NAME_PATTERNS = (tuple(p + r"\.(" + NAME_EXTENSIONS + ")" for p in NAME_PATTERNS_BASE)
                 + NAME_PATTERNS_BASE)

EXIF_FORMAT_PATTERN = r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
ISO_PATTERN = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})$"
ZERO_ISO = "0000-00-00T00:00:00.000000Z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def make_ts(y, mo, d, h=None, mi=None, s=None) -> Column:
    """Naive timestamp from integer columns, NULL where Python's datetime would fail."""
    h = F.lit(0) if h is None else h
    mi = F.lit(0) if mi is None else mi
    s = F.lit(0) if s is None else s
    ok = (y >= 1) & (h <= 23) & (mi <= 59) & (s <= 59)
    return F.when(ok, F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)")))


def _groups_ts(text: Column, pattern: str, first_group: int = 1) -> Column:
    g = [F.regexp_extract(text, pattern, first_group + j).try_cast("int") for j in range(6)]
    hit = F.regexp_extract(text, pattern, 0) != ""
    return F.when(hit, make_ts(*g))


def _match_digits(text: Column, pattern: str, prefix_check: bool = False) -> Column:
    """Digits of the first match of a pattern whose six fields are 4+2+2+2+2+2
    digits (an extension like ``.3gp`` only adds digits after the fourteenth), or
    NULL without a match.  One regex evaluation per pattern."""
    m = F.regexp_extract(text, pattern, 0)
    hit = m != ""
    if prefix_check:  # IMG/VID must be upper case, as in the reference
        hit = hit & F.substring(m, 1, 3).isin("IMG", "VID")
    return F.when(hit, F.regexp_replace(m, r"[^0-9]", ""))


def _digits_ts(d: Column) -> Column:
    cut = [F.substring(d, a, n).try_cast("int")
           for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return make_ts(*cut)


def _first_valid(digit_strings: list[Column]) -> Column:
    """First candidate (in pattern order) that is a valid date-time.  The timestamp
    is built once, inside a lambda over the candidate array, which keeps the
    generated code small however many patterns there are."""
    ts = F.transform(F.array(*digit_strings), _digits_ts)
    return F.get(F.filter(ts, lambda x: x.isNotNull()), 0)


def datetime_from_path(path) -> Column:
    """First date found by the reference's path rules, or NULL."""
    p = _c(path)
    name = P.basename(p)
    tries = [_first_valid([_match_digits(name, pat) for pat in PATH_NAME_PATTERNS])]
    parts = P.components(p)

    def first_in_parts(fn) -> Column:
        found = F.filter(F.transform(parts, fn), lambda x: x.isNotNull())
        return F.get(found, 0)

    def day(c):
        hit = F.regexp_extract(c, PATH_DAY_PATTERN, 0) != ""
        return F.when(hit, make_ts(*(F.regexp_extract(c, PATH_DAY_PATTERN, j).try_cast("int")
                                     for j in (1, 2, 3))))

    def month(c):
        hit = F.regexp_extract(c, PATH_MONTH_PATTERN, 0) != ""
        return F.when(hit, make_ts(F.regexp_extract(c, PATH_MONTH_PATTERN, 1).try_cast("int"),
                                   F.regexp_extract(c, PATH_MONTH_PATTERN, 2).try_cast("int"),
                                   F.lit(1)))

    def year(c):
        y = c.try_cast("int")
        lo, hi = PATH_YEAR_RANGE
        return F.when(c.rlike(PATH_YEAR_PATTERN) & (y >= lo) & (y <= hi),
                      make_ts(y, F.lit(1), F.lit(1)))

    tries += [first_in_parts(day), first_in_parts(month), first_in_parts(year)]
    return F.coalesce(*tries)


def datetime_from_filename(name) -> Column:
    """The asset tool's 12 case-insensitive patterns.  In the IMG/VID patterns
    the prefix must be upper case (lower case fails the reference's int() and
    falls through)."""
    n = _c(name)
    return _first_valid([_match_digits(n, "(?i)" + pat, pat.startswith("(IMG|VID)"))
                         for pat in NAME_PATTERNS])


def exif_datetime(text) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` from the first 19 characters, if the text has a
    ``:`` and at least 19 characters."""
    t = _c(text)
    head = F.substring(t, 1, 19)
    ok = t.isNotNull() & (F.btrim(t) != "") & t.contains(":") & (F.length(t) >= 19)
    return F.when(ok, _groups_ts(head, EXIF_FORMAT_PATTERN))


def exif_creation_date(doc) -> Column:
    """First parseable of DateTimeOriginal, CreateDate, CreationDate of the first
    object of an EXIF document (struct array column)."""
    first = F.get(_c(doc), 0)
    return F.coalesce(exif_datetime(first["DateTimeOriginal"]),
                      exif_datetime(first["CreateDate"]),
                      exif_datetime(first["CreationDate"]))


def iso_creation_time(text) -> Column:
    """Probe ``creation_time``: not the all-zero date; drop ``Z`` and the fraction;
    needs a ``T``."""
    t = _c(text)
    clean = F.split_part(F.replace(t, F.lit("Z"), F.lit("")), F.lit("."), F.lit(1))
    ok = t.isNotNull() & (t != "") & (t != ZERO_ISO) & clean.contains("T")
    return F.when(ok, _groups_ts(clean, ISO_PATTERN))


def frame_rate(r_frame_rate) -> Column:
    """``num/den`` as a double, 0.0 when the denominator is 0 or there is no slash."""
    r = F.coalesce(_c(r_frame_rate), F.lit("0/1"))
    num = F.split_part(r, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.split_part(r, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(r.contains("/") & (den != 0), F.try_divide(num, den)).otherwise(F.lit(0.0))


def iso_with_offset(ts) -> Column:
    """Naive UTC timestamp as ``yyyy-MM-ddTHH:mm:ss+00:00``."""
    return F.concat(F.replace(ts_text(ts), F.lit(" "), F.lit("T")), F.lit("+00:00"))


def epoch_to_naive_utc(seconds) -> Column:
    """Epoch seconds -> naive UTC timestamp, independent of the session zone."""
    secs = _c(seconds).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), secs)


def ts_text(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text as the reference prints dates.

    A naive timestamp is cast to text as it is; ``date_format`` would take it through the
    session zone and shift times that the zone's clock changes skip.
    """
    return F.split_part(_c(ts).cast("string"), F.lit("."), F.lit(1))
