"""Quality rules on documents and their hosts (native).

Each document is measured by itself, in one scan without a shuffle: words, characters in words,
symbols, repeated lines, and words in repeated three-word windows.  Rule failures are then
counted per host (``source``), the hosts' failure rates are shrunk towards the corpus's rate by
a beta prior fitted to all hosts (method of moments), and a host whose shrunk rate stands out
loses all its documents: its verdict is joined back to them.

A host must give evidence against itself: its shrunk rate must be above ``HOST_LIMIT`` and above
the corpus's rate by ``STANDS_OUT`` standard errors of a host of its size.  So hosts that differ by
no more than chance, and a single host, lose only what breaks a base rule, however high the
corpus's own rate is.  The query, its SQL and the pipeline's filter (``keep_good``) share this rule.

Repeated windows without a shuffle: the 64-bit hashes of a text's windows are sorted to find
the values that occur twice; a word is outside every repeated window if the up to three windows
that hold it are all single, that is, if they also follow each other in the list of single
windows; both sides are compared as sets of hashed triples.

Scale: texts stay where they are read; what is written and shuffled is one slim row per
document.  Counting per host combines on the map side, and the table of verdicts has one row
per host, so a host with a third of all rows is neither one task's work nor one group.

Defined results: NULL and empty texts have no words (and fail the base rules); NULL hosts are
one host of their own; repeated rows are measured and counted each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import WS_RUN, fits_broadcast, null_tag

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.5
HOST_LIMIT = 0.5
STANDS_OUT = 2.0
_WS = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def _count_of(text: Column, chars: str) -> Column:
    """How many of ``chars`` (one byte each in UTF-8) the text has."""
    return (F.octet_length(text) - F.octet_length(_without(text, chars))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    cols = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    core = F.btrim(t, F.lit(_WS))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS_RUN))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_WS)) != "")
    numbers = [(F.char_length(t) - _count_of(t, _WS)).cast("long").alias("word_chars"),
               _count_of(t, SYMBOLS).alias("n_symbols")]
    one = docs.select(*cols, *numbers, lines.alias("_lines"),
                      F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    slim = [c for c in cols if c != text]
    keep = [*slim, "word_chars", "n_symbols"]
    two = one.select(
        *keep, F.size("_h").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Element i: the window of words i, i+1, i+2.  The last two elements hash fewer words
        # and so equal no window.
        F.expr("transform(_h, (x, i) -> xxhash64(x, get(_h, i + 1), get(_h, i + 2)))").alias("_g"))
    keep += ["n_words", "n_lines", "n_dup_lines"]
    three = two.select(*keep, "_g", F.when(F.size(F.array_distinct("_g")) < F.size("_g"),
                                           F.sort_array("_g")).alias("_s"))
    four = three.select(*keep, "_g", F.array_except("_g", F.expr(
        "filter(_s, (x, i) -> x = get(_s, i + 1))")).alias("_u"))  # NULL if nothing repeats
    triple = "transform({0}, (x, i) -> xxhash64(x, get({0}, i - 1), get({0}, i - 2)))"
    single = F.size(F.array_intersect(F.expr(triple.format("_g")), F.expr(triple.format("_u"))))
    return four.select(*keep, F.when(F.col("_u").isNull(), F.lit(0)).otherwise(
        F.col("n_words") - single).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rule_failed() -> Column:
    """Any rule at all: what is counted against a host."""
    return (base_failed() | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
            | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
            | (F.col("word_chars") > 20 * F.col("n_words")))


def host_verdicts(measured: DataFrame, source: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Stored table _sk, host_docs, host_failures, host_kept from measured documents."""
    hosts = cut_lineage(measured.groupBy(null_tag(F.col(source)).alias("_sk")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if(rule_failed()).alias("host_failures")),
        "quality-hosts")
    n, f = F.col("host_docs"), F.col("host_failures")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"),
                  F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()  # one row
    docs, fails = s["n"] or 0, s["f"] or 0
    mean = fails / docs if docs else 0.0
    within = mean * (1 - mean)
    spread = docs - s["nn"] / docs if docs else 0.0
    # Between-host variance of the failure rate beyond what binomial chance gives.
    between = ((s["ffn"] - fails * mean - (s["k"] - 1) * within) / spread) if spread > 0 else 0.0
    if within > 0 and between > 0:
        strength = max(within / between - 1, 0.0)
        rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    else:  # one host, or hosts that differ by no more than chance
        rate = F.lit(mean)
    bar = F.greatest(F.lit(limit), F.lit(mean) + F.lit(STANDS_OUT * within ** 0.5) / F.sqrt(n))
    return cut_lineage(hosts.withColumn("host_kept", rate <= bar), "quality-verdicts")


def judge(measured: DataFrame, source: str = "source") -> DataFrame:
    """``measured`` (stored) plus base_failed, host_docs, host_failures, host_kept and kept."""
    verdicts = host_verdicts(measured, source)
    verdicts = F.broadcast(verdicts) if fits_broadcast(verdicts, 120) else verdicts
    return (measured.withColumn("_sk", null_tag(F.col(source))).join(verdicts, "_sk").drop("_sk")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.col("host_kept")))


def quality_table(docs: DataFrame) -> DataFrame:
    measured = cut_lineage(measure(docs.select("doc_id", "source", "text")), "quality")
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "source", "host_docs", "host_failures", "host_kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and their host's verdict keep.

    Rows are measured once and stored with their measures, so that failures can be counted
    per host from slim columns before the rows are filtered.
    """
    flat = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"),
                       F.col("text").alias("_text"))
    stored = cut_lineage(measure(flat, "_text"), "quality-rows")
    return judge(stored, "_source").where("kept").select("_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w
      WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS dup FROM g),
rep AS (SELECT r, count(*) AS n FROM (
          SELECT r, dup OR coalesce(lag(dup, 1) OVER o, false) OR coalesce(lag(dup, 2) OVER o, false) AS hit
          FROM c WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE hit GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM (
        SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines
  FROM d LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n,
             count(*) FILTER (WHERE base_failed OR n_symbols > 0.5 * n_words
                              OR n_dup_lines > 0.5 * n_lines OR word_chars > 20 * n_words) AS f
      FROM b GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean,
             (sum(f * f / n) - sum(f) * (sum(f) / sum(n))
              - (count(*) - 1) * (sum(f) / sum(n)) * (1 - sum(f) / sum(n)))
             / nullif(sum(n) - sum(n * n) / sum(n), 0) AS between_var FROM h),
v AS (SELECT h.source, h.n, h.f, greatest(0.5::DOUBLE, mean + 2 * sqrt(mean * (1 - mean)) / sqrt(h.n)) >= CASE
        WHEN mean * (1 - mean) > 0 AND between_var > 0 THEN
          (f + mean * greatest(mean * (1 - mean) / between_var - 1, 0))
          / (h.n + greatest(mean * (1 - mean) / between_var - 1, 0))
        ELSE mean END AS host_kept FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept, b.source, v.n AS host_docs, v.f AS host_failures, host_kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
