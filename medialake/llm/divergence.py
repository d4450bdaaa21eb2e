"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Method.  Each kept term of a language is a row of its nonzero counts, ordered by source.  The
sum over all terms of f between two sources is taken apart into
  V * f(0, 0), as if no source held any term,
  one correction per source, count and number of terms with that count, against "zero" there,
  one correction per term that both sources hold.
The last part, quadratic in the sources of a term, runs over a frequent-pattern tree of the term
rows: a node is a (source, count) item below its prefix, its multiplicity the number of terms
through it, and each combination of a node and an ancestor is corrected once, times the node's
multiplicity.  Rows sorted by a key that keeps prefixes are the tree in depth-first order, so a task builds the nodes of
a bounded piece of sorted rows at a time; a node cut by a piece or partition border is corrected
in two parts whose multiplicities add up.

Scale.  Tasks count terms per (lang, source) themselves and hand on sums; equal rows meet in plain
aggregations with partial sums, so a hot source or term does no harm.  Equal term rows are counted
before the tree.  Per pair of sources and task one partial sum is shuffled.  A term's row holds at
most one item per source of its language.  The histogram part joins a source's distinct counts, not
its terms, to the other sources of the language, whose pairs are the result itself.

Defined results.  NULL text, lang and source count as ''.  Only A-Z are lower-cased.  A lang whose
terms are all rare (V = 0) gives pair values 0 and no term rows; a lang of one source gives no pair
rows.  Repeated rows count again.  Ties rank by the item's UTF-8 bytes.  An empty table gives no
row.  Only ``text``, ``lang`` and ``source`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import ASCII_UPPER, split_words

UNIT, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Distinct (lang, source, term) rows that a task holds before it hands them on.
HELD = 200_000
#: Cells (rows times longest path) of the piece of the tree that is built at a time.
CELLS = 1 << 20

#: Bytes that part terms: all ASCII but letters; A-Z become a-z.  Bytes of other characters stay.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs); term NULL stands for the group as such."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            counts, in_docs = [0, *n.values()], [0, *map(docs.__getitem__, n)]
            for i in range(0, len(terms), HELD):
                m = len(terms[i: i + HELD])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * m), pa.array([source] * m), pa.array(terms[i: i + m], pa.binary()),
                     pa.array(counts[i: i + m], pa.int64()), pa.array(in_docs[i: i + m], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key = (lang, source)
            if key not in held:
                held[key] = (Counter(), Counter())
                size += 1
            n, docs = held[key]
            before = len(n)
            terms: Counter = Counter()
            for piece in split_words(text.translate(_FOLD)):
                terms.update(piece)
            n.update(terms)
            docs.update(terms.keys())
            size += len(n) - before
            if size >= HELD:
                yield from told()
                held.clear()
                size = 0
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """Stored rows (lang, source, term, n, docs), and one with term NULL per occurring group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(text("text").cast("binary").alias("text"), text("lang").alias("lang"), text("source").alias("source")).mapInArrow(
        _count_terms, "lang string, source string, term binary, n long, docs long")
    return cut_lineage(
        parts.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def entries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, source, term, n, p, p0, q) of the nonzero counts of kept terms, and one row
    (lang, source, v, p0) per occurring group.  p0 is the group's p of a term that it lacks."""
    counts = term_counts(docs)
    kept = cut_lineage(
        counts.where("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= MIN_DOCS)
        .select("lang", "term", "in_lang"), "divergence-kept")
    found = cut_lineage(counts.where("term IS NOT NULL").join(kept, ["lang", "term"])
                        .select("lang", "source", "term", "n", "in_lang"), "divergence-entries")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(
        counts.where("term IS NULL").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left").na.fill(0)
        .withColumn("p0", F.when(F.col("v") > 0, F.expr(_share("0", "total")))), "divergence-groups")
    rows = (found.join(groups, ["lang", "source"])
            .withColumn("p", F.expr(_share("n", "total"))).withColumn("q", F.expr(_share("in_lang", "lang_total")))
            .select("lang", "source", "term", "n", "p", "p0", "q"))
    return rows, groups.select("lang", "source", "v", "p0")


def _share(n: str, total: str) -> str:
    """1 + floor(UNIT * (n + 1) / (total + v)), in decimals: UNIT times a count may pass a long."""
    return (f"1 + CAST({n} + 1 AS DECIMAL(19, 0)) * CAST({UNIT} AS DECIMAL(10, 0))"
            f" div CAST({total} + v AS DECIMAL(20, 0))")


def _f(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q are at most UNIT + 1, so the square fits a long."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _piece(source: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray, start: np.ndarray,
           length: np.ndarray, mult: np.ndarray, add) -> None:
    """Corrections of the tree of some rows sorted by path.  Row i holds the items from start[i]
    on; add(sources, others, values, values the other way, multiplicities) takes them."""
    width = int(length.max(initial=0))
    depth = np.arange(width)
    there = depth[None, :] < length[:, None]
    at = np.where(there, start[:, None] + depth[None, :], 0)
    s, c = np.where(there, source[at], -1), n[at]
    same = (s[1:] == s[:-1]) & (c[1:] == c[:-1]) & there[1:] & there[:-1]
    new = there.copy()
    new[1:] &= ~np.logical_and.accumulate(same, axis=1)  # a node begins where the prefix changes
    for d in range(1, width):
        first = np.flatnonzero(new[:, d])
        node = np.cumsum(new[:, d]) - 1
        times = np.zeros(len(first), dtype=np.int64)
        np.add.at(times, node[there[:, d]], mult[there[:, d]])
        b = at[first, d]
        for e in range(d):
            a = at[first, e]
            add(source[a], source[b],
                _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b]),
                _gap(p[b], p[a]) - _gap(p[b], p0[a]) - _gap(p0[b], p[a]) + _gap(p0[b], p0[a]), times)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, item, value): sums of the corrections of this task's part of the tree."""
    sums: dict[tuple[str, str, str], int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch.column("lang").dictionary_encode()
        path, mult = batch.column("path"), batch.column("mult").to_numpy()
        items = path.flatten()
        names = items.field("source").dictionary_encode()
        source = names.indices.to_numpy().astype(np.int64)
        n, p, p0 = (items.field(x).to_numpy() for x in ("n", "p", "p0"))
        start = path.offsets.to_numpy().astype(np.int64)
        start, length = start[:-1] - start[0], np.diff(start)
        codes, words = lang.indices.to_numpy(), names.dictionary.to_pylist()
        step = max(1, CELLS // max(1, int(length.max())))
        cuts = sorted({0, len(codes), *(np.flatnonzero(np.diff(codes)) + 1).tolist(), *range(0, len(codes), step)})
        for lo, hi in zip(cuts, cuts[1:]):
            here = lang.dictionary[int(codes[lo])].as_py()

            def add(a, b, ab, ba, times, here=here):
                key = a * len(words) + b
                for flip, values in ((False, ab), (True, ba)):
                    if int(np.abs(values).max(initial=0)) * int(times.sum()) < 1 << 62:
                        found, back = np.unique(key, return_inverse=True)
                        total = np.zeros(len(found), dtype=np.int64)
                        np.add.at(total, back, values * times)
                        told = zip(found.tolist(), total.tolist())
                    else:
                        told = zip(key.tolist(), (v * t for v, t in zip(values.tolist(), times.tolist())))
                    for k, v in told:
                        x, y = words[k // len(words)], words[k % len(words)]
                        at = (here, y, x) if flip else (here, x, y)
                        sums[at] = sums.get(at, 0) + v

            _piece(source, n, p, p0, start[lo:hi], length[lo:hi], mult[lo:hi], add)
    keys = list(sums)
    for i in range(0, len(keys), HELD):
        some = keys[i: i + HELD]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[j] for k in some], pa.string()) for j in range(3)]
            + [pa.array([Decimal(sums[k]) for k in some], pa.decimal128(38, 0))], names=["lang", "source", "item", "value"])


def tree_corrections(rows: DataFrame) -> DataFrame:
    """Partial rows (lang, source, item, value) of the terms that both sources hold."""
    terms = rows.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("path"))
    paths = cut_lineage(terms.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("mult")),
                        "divergence-paths")
    # The key is as long as the path but small: equal prefixes of a path have equal prefixes of the key.
    key = F.unhex(F.array_join(F.transform("path", lambda x: F.lpad(
        F.hex(F.hash(x["source"], x["n"]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))
    return paths.withColumn("key", key).orderBy("lang", "key").select("lang", "path", "mult").mapInArrow(_tree, "lang string, source string, item string, value decimal(38,0)")


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for every two different sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("z"))
    wide = lambda e: F.expr(f"CAST({e} AS DECIMAL(38, 0))")
    base = (groups.join(other, "lang").where("source <> item")
            .select("lang", "source", "item", wide(f"CASE WHEN v > 0 THEN {_f('p0', 'z')} ELSE 0 END")
                    .alias("one"), "v").select("lang", "source", "item", (F.col("one") * F.col("v")).cast("decimal(38,0)").alias("value")))
    counts = rows.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    single = (counts.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(wide(f"({_f('p', 'z')} - {_f('p0', 'z')})") * F.col("times")).cast("decimal(38,0)").alias("ab"),
        F.sum(wide(f"({_f('z', 'p')} - {_f('z', 'p0')})") * F.col("times")).cast("decimal(38,0)").alias("ba")))
    return (base.unionByName(single.select("lang", "source", "item", F.col("ab").alias("value")))
            .unionByName(single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("ba").alias("value")))
            .unionByName(tree_corrections(rows))
            .groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")))


def divergence_table(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every pair, and the ``top`` over-used terms."""
    rows, groups = entries(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = pair_values(rows, groups).withColumn("rank", F.row_number().over(order))
    term = (rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
             for name, x in (("pair", pair), ("term", term))]
    return parts[0].unionByName(parts[1])


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n
                   FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
      LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY ALL) x USING (lang, source, term)),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, c.n,
         1 + CAST({UNIT} AS HUGEINT) * CAST(c.n + 1 AS HUGEINT) // CAST(gt.total + l.v AS HUGEINT) AS p,
         1 + CAST({UNIT} AS HUGEINT) * CAST(k.n + 1 AS HUGEINT) // CAST(l.total + l.v AS HUGEINT) AS q
  FROM c JOIN gt USING (lang, source) JOIN l USING (lang) JOIN k USING (lang, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP}
"""
