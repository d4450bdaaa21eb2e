"""License scans by MinHash bands over overlapping text windows (native).

A text's words give two-word shingles; every window of ``WIDTH`` words, one starting at every
``STRIDE`` words, has ``BANDS`` minima of its shingles' hashes, each under another XOR mask.
A window that has a minimum in common with a window of a template retrieves the template.

Verification is exact.  Around the window (as far to both sides as the template is long), each
stretch that starts at a shingle of the template and reaches a quarter further than the template
is long is compared with it; the stretch that overlaps the window and holds most of the
template's shingles, then the shortest, then the first, is the template's place.  It is a match if it
holds ``CONTAINMENT`` of the template's shingles and all of those that tell the template from its
siblings (templates that share ``SIBLING`` or more of its shingles: another version or variant),
so that a notice of one license never counts as that of the next.  Where places of
one template overlap, a place gives way to one with more shingles (then shorter, then earlier);
where those left of several templates overlap, to one with more shingles (then greater
containment, earlier start, name).

Bands of one row: two windows of shingle similarity s meet in one of b bands with probability
1 - (1 - s)^b.  A notice of five words inside a window of eight has s = 4/7, found at b = 8 with
0.999 per window, and lies whole in two windows; longer templates are cut into windows at every
word, so a copy has windows of s = 6/7 or 1.

Scale: one scan; windows exist only inside generated code, and what is shuffled are the matches.
The bands of the templates (a bounded list, checked) are broadcast.

Defined results: NULL and empty texts match nothing; a text's match is reported once per
template with its best containment, the word it first starts at and the number of places; equal documents
are scanned each; an empty table, or one without matches, gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import fits_broadcast
from .decontaminate import word_hashes

WIDTH, STRIDE, BANDS = 8, 2, 8
CONTAINMENT = 0.8
SIBLING = 0.5

# Notices as they are published with the licenses (fixed values).
_GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"))
_CREATIVE_COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                     ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                     ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} "
               "as published by the Free Software Foundation")
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
     "the Software"),
    ("ISC-permission",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("BSD-clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("GPL-header", _GNU_HEADER.format("GNU General Public License")),
    *((name, f"This work is licensed under the {title}, version {v}.") for name, title, v in _GNU),
    *((f"{name}-or-later", _GNU_HEADER.format(title) + f", either version {v} of the License, or (at your option) "
       "any later version") for name, title, v in _GNU),
    *((f"CC-{short}-{v}-notice", f"This work is licensed under a Creative Commons {title} {v} International License.")
      for v in ("3.0", "4.0") for short, title in _CREATIVE_COMMONS),
    *((f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for v in ("3.0", "4.0") for short, _ in _CREATIVE_COMMONS),
)

_MASKS = [(i * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 63) for i in range(1, BANDS + 1)]


def shingled(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_g``: hashes of the two-word shingles in order, and of the last word alone.

    The words are a column of their own, so that they are made once per text.  No filter may
    stand on ``_g``: it would be pushed below and make the words anew for every word.
    """
    return (texts.select(*keep, word_hashes(F.col(text)).alias("_w"))
            .select(*keep, F.expr("transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1)))").alias("_g")))


def _banded(windows: DataFrame, shingle_col: str, start: str) -> DataFrame:
    """One row per window and band: the hash that is least under the band's mask.

    The shingles and minima are columns of plain projections, which keeps the generated code
    small enough to be compiled.
    """
    cols = windows.columns
    at = [f"_a{i}" for i in range(WIDTH - 1)]
    least = [F.least(*[F.col(a).bitwiseXOR(F.lit(m)) for a in at]) for m in _MASKS]
    return (windows.select(*cols, *[F.get(F.col(shingle_col), F.col(start) + i).alias(a) for i, a in enumerate(at)])
            .select(*cols, *[x.alias(f"_b{i}") for i, x in enumerate(least)])
            .select(*cols, F.posexplode(F.array(*[f"_b{i}" for i in range(BANDS)])).alias("band", "value")))


def _identities(rows: DataFrame) -> DataFrame:
    """``rows``: template, shingles -> the same plus ``marks``, the shingles that a sibling lacks."""
    one = rows.select("template", "shingles", F.explode("shingles").alias("_x"))
    other = one.select(F.col("template").alias("_other"), F.col("shingles").alias("_theirs"), "_x")
    marks = (one.join(other, "_x").where("template <> _other")
             .groupBy("template", "_other", "shingles", "_theirs").agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") >= SIBLING * F.size("shingles"))
             .groupBy("template").agg(F.array_distinct(F.flatten(F.collect_list(
                 F.array_except("shingles", "_theirs")))).alias("marks")))
    return rows.join(marks, "template", "left").withColumn(
        "marks", F.coalesce("marks", F.array().cast("array<bigint>")))


def template_bands(spark, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Stored: band, value, template, shingles (distinct), marks, length."""
    rows = shingled(spark.createDataFrame(list(templates), "template string, text string"), "text", ["template"])
    # The last word alone is a shingle of one-word templates only.
    rows = cut_lineage(rows.withColumn("_g", F.slice("_g", F.lit(1), F.greatest(F.size("_g") - 1, F.lit(1))))
                       .withColumn("shingles", F.array_distinct("_g")),
                       "license-templates").where(F.size("_g") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_g") - (WIDTH - 1), F.lit(0)))
    kept = ["template", "shingles", "marks", "length"]
    cut = _identities(rows).select("template", "shingles", "marks", F.size("_g").alias("length"), "_g",
                                   F.explode(starts).alias("_i"))
    return cut_lineage(_banded(cut, "_g", "_i").select(*kept, "band", "value").distinct(), "license-bands")


def _places(met: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct places of verified templates: _row, ``keep``, template, containment, _n, _start, _end (words)."""
    cols = ["_row", *keep, "template", "shingles", "marks", "length"]
    first = F.greatest(F.col("_i") - F.col("length"), F.lit(0))
    near = (met.select(*cols, "_i", first.alias("_f"), F.slice(
                "_g", first + 1, F.col("_i") - first + F.col("length") + WIDTH).alias("_around"))
            .where(F.size(F.array_intersect("shingles", "_around")) >= CONTAINMENT * F.size("shingles"))
            .where(F.size(F.array_except("marks", "_around")) == 0))
    hits = near.select(
        *cols, "_i", "_f", "_around", F.expr("int(ceil(length * 1.25))").alias("_reach"),
        F.expr("filter(sequence(0, size(_around) - 1), i -> array_contains(shingles, _around[i]))").alias("_hits"))
    # A stretch ends where it has met the last of the template's shingles that it holds.
    stretches = hits.select(*cols, "_i", "_f", "_around", "_reach", F.expr(
        "transform(transform(_hits, s -> named_struct('s', s, 'in', slice(_around, s + 1, _reach))), p -> named_struct("
        "'s', p.s, 'e', p.s + int(array_max(transform(array_intersect(shingles, p.in), x -> array_position(p.in, x))))))")
        .alias("_all"))
    here = stretches.select(*cols, "_f", "_around", F.explode(F.expr(
        f"filter(_all, p -> p.s + _f < _i + {WIDTH} and p.e + _f > _i)")).alias("_p"), "_i")
    counted = here.select("_row", *keep, "template", "_i", F.size("shingles").alias("_size"), "marks", "_f", "_p",
                          "shingles", F.expr("slice(_around, _p.s + 1, _p.e - _p.s)").alias("_in"))
    n = F.size(F.array_intersect("shingles", "_in"))
    best = (counted.where(n >= CONTAINMENT * F.col("_size")).where(F.size(F.array_except("marks", "_in")) == 0)
            .groupBy("_row", *keep, "template", "_i", "_size")
            .agg(F.max(F.struct(n.alias("n"), (F.col("_p.s") - F.col("_p.e")).alias("short"),
                                (-(F.col("_p.s") + F.col("_f"))).alias("at"))).alias("_b")))
    return best.select("_row", *keep, "template", (F.col("_b.n") / F.col("_size")).alias("containment"),
                       F.col("_b.n").alias("_n"), (-F.col("_b.at")).alias("_start"),
                       (-F.col("_b.at") - F.col("_b.short")).alias("_end")).distinct()


def _undisputed(places: DataFrame, keep: list[str]) -> DataFrame:
    """The places that overlap no better one.  Only places that overlap in a chain are compared."""
    order = Window.partitionBy("_row").orderBy("_start", "_end", "template")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = (places.withColumn("_new", (before.isNull() | (before <= F.col("_start"))).cast("int"))
               .withColumn("_chain", F.sum("_new").over(order)))
    fields = ["_n", "containment", "_start", "_end", "template"]
    lists = chained.groupBy("_row", *keep, "_chain").agg(F.collect_list(F.struct(*fields)).alias("_l"))
    overlap = "q._start < p._end and q._end > p._start"
    own = ("q.template = p.template and (q._n > p._n or q._n = p._n and (q._end - q._start < p._end - p._start "
           "or q._end - q._start = p._end - p._start and q._start < p._start))")
    better = ("(q._n > p._n or q._n = p._n and (q.containment > p.containment or q.containment = p.containment "
              "and (q._start < p._start or q._start = p._start and q.template < p.template)))")
    lists = lists.withColumn("_l", F.expr(f"filter(_l, p -> not exists(_l, q -> {overlap} and {own}))"))
    won = F.expr(f"filter(_l, p -> not exists(_l, q -> {overlap} and {better}))")
    return lists.select("_row", *keep, F.explode(won).alias("_p")).select("_row", *keep, "_p.*")


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *,
                  text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` and matching template: ``keep``, template, containment,
    first_word, n_places."""
    bands = template_bands(docs.sparkSession, templates)
    bands = F.broadcast(bands) if fits_broadcast(bands, 8192) else bands
    read = shingled(docs, text, list(keep)).withColumn("_row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.greatest(F.size("_g") - 1, F.lit(0)), F.lit(STRIDE))
    windows = read.select("_row", *keep, "_g", F.explode(starts).alias("_i"))
    met = _banded(windows, "_g", "_i").join(bands, ["band", "value"])
    found = _undisputed(_places(met, list(keep)), list(keep))
    return (found.groupBy("_row", *keep, "template").agg(
        F.max("containment").alias("containment"), F.min("_start").cast("long").alias("first_word"),
        F.count(F.lit(1)).alias("n_places")).drop("_row"))


def license_table(docs: DataFrame) -> DataFrame:
    return find_licenses(docs)
