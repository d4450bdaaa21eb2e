"""Path functions on ``/``-separated string columns (H8, H9, ancestors).

All are built-in expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a file name into stem and extension like ``os.path.splitext``: the
# extension starts at the last dot, but leading dots never start one.
_SPLITEXT = r"(?s)^(.*[^.].*)(\.[^.]*)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path) -> Column:
    """``os.path.dirname``: text before the last ``/``; ``/`` for top-level files."""
    p = _c(path)
    head = F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)
    return (F.when(~p.contains("/"), F.lit(""))
            .when((head == "") & p.startswith("/"), F.lit("/"))
            .otherwise(head))


def stem(path) -> Column:
    name = basename(path)
    found = F.regexp_extract(name, _SPLITEXT, 1)
    return F.when(found == "", name).otherwise(found)


def extension(path) -> Column:
    """Extension with its dot (``.JPG``), or ``''``; case kept."""
    return F.regexp_extract(basename(path), _SPLITEXT, 2)


def lower_extension(path) -> Column:
    return F.lower(extension(path))


def depth(directory) -> Column:
    """Number of ``/`` in a directory path (the reference's sort depth)."""
    d = _c(directory)
    return F.length(d) - F.length(F.regexp_replace(d, "/", ""))


def components(path) -> Column:
    """``pathlib.Path(p).parts`` for absolute paths: ``['/', 'a', 'b.jpg']``."""
    p = _c(path)
    rest = F.filter(F.split(p, "/"), lambda s: s != "")
    return F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), rest)).otherwise(rest)


def ancestors(directory, min_depth=None) -> Column:
    """All directories from the top down to ``directory`` itself (inclusive).

    ``/a/b/c`` -> ``['/a', '/a/b', '/a/b/c']``.  ``min_depth`` (a Column or int,
    counted in components) cuts off ancestors above a common root.
    """
    d = _c(directory)
    parts = F.split(d, "/")  # leading '' for absolute paths
    n = F.size(parts)
    start = F.lit(2) if min_depth is None else F.greatest(F.lit(2), _c(min_depth)
                                                              if not isinstance(min_depth, int)
                                                              else F.lit(min_depth))
    return F.when(d == "/", F.array(F.lit("/"))).otherwise(
        F.transform(F.sequence(start, n), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def proper_ancestors(directory) -> Column:
    """Ancestors strictly above ``directory`` (without ``/`` itself)."""
    d = _c(directory)
    parts = F.split(d, "/")
    n = F.size(parts)
    return F.when(n <= 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def output_path(path, suffix: str, new_extension: str | None = None) -> Column:
    """Same directory, ``stem + suffix + ext``; ``new_extension`` (``.jpg``) replaces ext."""
    ext = extension(path) if new_extension is None else F.lit(new_extension)
    d = dirname(path)
    sep = F.when(d.isin("", "/"), F.lit("")).otherwise(F.lit("/"))
    return F.concat(d, sep, stem(path), F.lit(suffix), ext)
