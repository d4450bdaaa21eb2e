"""Benchmark decontamination by a positional inverted index (native).

1.  Every document becomes an array of 64-bit word hashes (words are compared by these), stored
    once in the shared folder.
2.  Corpus frequencies of the benchmark's words are counted; of each benchmark window (ten
    consecutive words of an item) the two rarest words are its key terms.
3.  Postings (document, term, position) of the key terms are stored; those of a window's
    rarest term carry the words around them.  Each document also has one posting past its end,
    which keeps its length.
4.  A posting of a window's rarest term proposes the place where the window would begin.  It is
    a proximity match if all the window's words stand among the words around it.  The proposal
    is intersected with the list of the second rarest term, adjusted by its offset, and is an
    exact match if the words around read as the window.

Scale: the corpus is tokenised once and read twice as hashes; only postings of key terms move,
keyed by (term, document, position), which no hot word can skew.  Nothing of the corpus's size
is broadcast: terms and windows of the benchmark are, if below a checked bound, and are joined
by shuffle beyond it.

Defined results: NULL or empty texts and items have no words; a window occurs in a document
wherever its words stand in a row; equal documents are judged each; repeated items with one id
count once; NULL ids read ``null``; empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import fits_broadcast, lower_ascii

WINDOW = 10
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SEPARATOR_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_END = "xxhash64('')"  # no word is empty, so this term marks the end of a document


def word_hashes(text: Column) -> Column:
    core = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_SEPARATORS))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, _SEPARATOR_RUN))
    return F.transform(words, lambda w: F.xxhash64(w))


def _small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, bytes_per_row) else df


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Stored: item (string), window (array of hashes), one row per distinct pair."""
    hashed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                          word_hashes(F.col("text")).alias("_h")).where(F.size("_h") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_h") - (width - 1), F.lit(1)))
    return cut_lineage(hashed.select("item", "_h", F.explode(starts).alias("_i"))
                       .select("item", F.slice("_h", F.col("_i"), F.lit(width)).alias("window"))
                       .distinct(), "decon-windows")


def _terms_of(windows: DataFrame) -> DataFrame:
    return windows.select("window", F.posexplode("window").alias("offset", "term"))


def key_terms(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Stored: window, its rarest term with offset, its second rarest with offset (NULL for
    windows of one word).  Windows with a word that the corpus lacks cannot occur."""
    rated = _terms_of(windows.select("window").distinct()).join(frequencies, "term", "left")
    in_order = F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("n"), F.lit(0)).alias("n"), "offset", "term")))
    best = rated.groupBy("window").agg(in_order.alias("t")).where(F.col("t")[0]["n"] > 0)
    return cut_lineage(best.select(
        "window", F.col("t")[0]["term"].alias("rare"), F.col("t")[0]["offset"].alias("rare_at"),
        F.get("t", F.lit(1))["term"].alias("next"), F.get("t", F.lit(1))["offset"].alias("next_at")),
        "decon-keys")


def index_postings(store: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """Stored postings: _row, term, pos, around (words before and after, for rarest terms),
    and per document one end posting (term NULL, pos its length, doc_id)."""
    role = keys.select(F.col("rare").alias("term"), F.lit(1).alias("rare")).unionByName(
        keys.where("next IS NOT NULL").select(F.col("next").alias("term"), F.lit(0).alias("rare")))
    roles = cut_lineage(role.groupBy("term").agg(F.max("rare").alias("rare")).unionByName(
        store.sparkSession.range(1).select(F.expr(_END).alias("term"), F.lit(-1).alias("rare"))),
        "decon-terms")
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    words = store.select("_row", "doc_id", "_h", F.posexplode(
        F.concat("_h", F.array(F.expr(_END)))).alias("pos", "term"))
    return cut_lineage(words.join(_small(roles, 48), "term").select(
        "_row", F.when(F.col("rare") >= 0, F.col("term")).alias("term"), "pos",
        F.when(F.col("rare") == -1, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("rare") == 1, F.slice("_h", first + 1, F.col("pos") - first + width)).alias("around"),
        F.when(F.col("rare") == 1, first).alias("around_at"), (F.col("rare") == -1).alias("is_end")),
        "decon-postings")


def find_matches(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored: _row, window, start, exact (false: proximity only)."""
    words = postings.where("NOT is_end")
    proposed = (words.where("around IS NOT NULL").withColumnRenamed("term", "rare")
                .join(_small(keys, 200), "rare")
                .withColumn("start", F.col("pos") - F.col("rare_at"))
                .where(F.size(F.array_except("window", "around")) == 0)
                .select("_row", "window", "start", "next", (F.col("start") + F.col("next_at")).alias("next_pos"),
                        ((F.col("start") >= F.col("around_at"))
                         & (F.slice("around", F.greatest(F.col("start") - F.col("around_at") + 1, F.lit(1)),
                                    F.size("window")) == F.col("window"))).alias("_reads")))
    lists = words.select("_row", F.col("term").alias("next"), F.col("pos").alias("next_pos"),
                         F.lit(True).alias("_met"))
    met = proposed.join(lists, ["_row", "next", "next_pos"], "left")
    return cut_lineage(met.select("_row", "window", "start", (F.col("_reads") & (
        F.col("next").isNull() | F.coalesce(F.col("_met"), F.lit(False)))).alias("exact")), "decon-matches")


def judge(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, _row, n_words, n_hit, n_items, items_sha256, contaminated,
    n_near (items with proximity matches only)."""
    store = cut_lineage(docs.select("doc_id", word_hashes(F.col("text")).alias("_h"))
                        .withColumn("_row", F.monotonically_increasing_id()), "decon-tokens")
    windows = item_windows(items, width)
    vocabulary = cut_lineage(_terms_of(windows).select("term").distinct(), "decon-vocabulary")
    words, counted = store.select(F.explode("_h").alias("term")), F.count(F.lit(1)).alias("n")
    if fits_broadcast(vocabulary, 40):
        counts = words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(counted)
    else:  # counted before they move, so that a hot word is one row of a task
        counts = words.groupBy("term").agg(counted).join(vocabulary, "term")
    frequencies = cut_lineage(counts, "decon-frequencies")
    keys = key_terms(windows, frequencies)
    postings = index_postings(store, keys, width)
    matches = find_matches(postings, keys)

    exact = matches.where("exact")
    hit = (exact.select("_row", F.explode(F.sequence("start", F.col("start") + F.size("window") - 1)).alias("pos"))
           .distinct().groupBy("_row").agg(F.count(F.lit(1)).alias("n_hit")))
    by_item = matches.join(_small(windows, 200), "window").groupBy("_row", "item").agg(
        F.max("exact").alias("exact"))
    listed = by_item.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("_items"),
        F.count_if(~F.col("exact")).alias("n_near"))
    n = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    empty = F.array().cast("array<string>")
    return (postings.where("is_end").select("_row", "doc_id", F.col("pos").cast("long").alias("n_words"))
            .join(hit, "_row", "left").join(listed, "_row", "left")
            .select("_row", "doc_id", "n_words", n.alias("n_hit"),
                    F.size(F.coalesce("_items", empty)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("_items", empty), ","), 256).alias("items_sha256"),
                    (n > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item.

    A row's verdict depends on its text alone, so contaminated texts (by digest) are left out:
    equal rows go together, and the texts of clean rows need no shuffle while the digests of
    the contaminated ones are below the checked bound.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    tagged = docs.select(digest.alias("doc_id"), "text")
    bad = cut_lineage(judge(tagged, items, width).where("contaminated")
                      .select(F.col("doc_id").alias("_digest")).distinct(), "decon-bad")
    return docs.withColumn("_digest", digest).join(_small(bad, 64), "_digest", "left_anti").select(*docs.columns)


def contamination_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), items).drop("_row")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, list_slice(ws, i, i + 9) AS win,
              array_to_string(list_slice(ws, i, i + 9), ' ') AS p
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS p
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT r, i, iw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (
          SELECT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
-- Proximity: all of a window's words stand within nine words of an occurrence of its rarest one.
wt AS (SELECT p, any_value(win) AS win, unnest(any_value(win)) AS w,
              generate_subscripts(any_value(win), 1) AS o FROM iw GROUP BY p),
dp AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
fr AS (SELECT w, count(*) AS n FROM dp WHERE w IN (SELECT w FROM wt) GROUP BY w),
rare AS (SELECT p, win, w FROM (
           SELECT p, win, wt.w, fr.n, row_number() OVER (PARTITION BY p ORDER BY coalesce(fr.n, 0), o) AS k
           FROM wt LEFT JOIN fr ON wt.w = fr.w) WHERE k = 1 AND n > 0),
nr AS (SELECT DISTINCT dp.r, rare.p FROM dp JOIN rare ON dp.w = rare.w JOIN d ON d.r = dp.r
       WHERE list_has_all(list_slice(d.ws, greatest(pos - 9, 1), pos + 9), rare.win)),
ne AS (SELECT r, count(*) AS n_near FROM (
         SELECT DISTINCT nr.r, iw.item FROM nr JOIN iw ON nr.p = iw.p
         EXCEPT SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN ne USING (r)
"""
