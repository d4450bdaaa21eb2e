"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its k-mers (k words in a row), each labelled with how often it
occurred before.  A sketch takes the ``taken`` least labelled k-mers under a random order and
keeps them in text order, so two texts agree on a sketch if they share these k-mers *and* their
order, which follows edit similarity.  Texts that agree on any sketch are candidates.

Similarity of two texts: with A k-mers aligned in order out of n and m, A / (n + m - A); texts
are linked from ``THRESHOLD`` on.  A similarity of t allows n + m - 2A <= (1 - t)/(1 + t) *
(n + m) unaligned k-mers, so the alignment never leaves a band of that half-width around the
diagonal, and only the band is computed.

Which candidates are verified, without making all pairs of a group:

1.  Equal texts are one node.
2.  In each group of one sketch value every member is compared with the group's first node.
    That links dense groups in one row per member.
3.  Members of one group that are still in different components are compared, all of them, but
    only those: members outside the group's largest component against all others, in blocks
    of ``BLOCK`` nodes, so that one task holds two blocks and no group is in one task.
    Links inside one component would change nothing.

Sketches: a pair of similarity 0.8 is missed with a probability below 1e-4 (texts of 26 k-mers
or more: 32 sketches of 5; texts of 32 k-mers or fewer: 16 sketches of 2; a similar pair always
has one of the two in common).

Defined results: a NULL text is a class of its own; empty texts equal each other; a text of
fewer than k words is one k-mer; texts that differ only in white space are similar (1.0); rows
with equal or NULL ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import batch_rows, fits_broadcast
from .components import components

K = 5
THRESHOLD = 0.8
LONG, SHORT = (32, 5), (16, 2)  # sketches, k-mers in each
LONG_FROM, SHORT_TO = 26, 32  # k-mers; both hold in between: 26 <= 0.8 * 33
BLOCK = 256
#: What a worker holds besides its batch: hashes of words (looked up again, never needed), cells of
#: k-mers times orders that are ranked at once, rows of a batch.  No result depends on them.
WORDS_HELD, CELLS_HELD, BATCH_ROWS = 200_000, 500_000, 1_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, size=LONG[0] + SHORT[0], dtype=np.uint64)
_words: dict[bytes, int] = {}  # per worker process


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def kmers(text: bytes, k: int = K) -> np.ndarray:
    """64-bit hashes of the k-mers of ``text``, in order."""
    words = text.split()  # exactly the white space that separates words
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORDS_HELD:
        _words.clear()
    ids = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = max(len(h) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * _A + h[i:i + n]
    return _mixed(out + np.uint64(min(k, len(h))))


def labelled(g: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence number hashed in: no two are equal."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return g
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, _mixed(g + occurrence * _B), g)


def _sketch(g: np.ndarray, seeds: np.ndarray, taken: int, mark: int) -> list[int]:
    taken = min(taken, len(g))
    keys = []
    step = max(1, CELLS_HELD // len(g))
    for i in range(0, len(seeds), step):
        part = seeds[i:i + step, None]
        x = (g[None, :] ^ part) * _A
        x = (x ^ (x >> np.uint64(32))) * _B
        least = np.argpartition(x, taken - 1, axis=1)[:, :taken] if taken < len(g) else \
            np.broadcast_to(np.arange(len(g)), x.shape)
        least = np.sort(least, axis=1)  # back to text order
        key = part[:, 0] + np.uint64(mark)
        for j in range(taken):
            key = _mixed(key * _A + g[least[:, j]])
        keys.append(key)
    return np.concatenate(keys).view(np.int64).tolist()


def sketches(text: bytes) -> list[int]:
    g = kmers(text)
    if not len(g):
        return []
    g = labelled(g)
    keys = []
    if len(g) >= LONG_FROM:
        keys += _sketch(g, _SEEDS[:LONG[0]], LONG[1], 1)
    if len(g) <= SHORT_TO:
        keys += _sketch(g, _SEEDS[LONG[0]:], SHORT[1], 2)
    return keys


def _similarity(aligned: int, n: int, m: int) -> float:
    return aligned / (n + m - aligned) if n + m > aligned else 1.0


def banded_alignment(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``b`` among alignments that pair
    positions at most ``band`` apart: row by row, only the band's cells."""
    width = 2 * band + 1
    padded = np.zeros(max(len(a), len(b)) + 2 * band, np.uint64)
    padded[band:band + len(b)] = b
    inside = np.zeros(len(padded), bool)
    inside[band:band + len(b)] = True
    best = np.zeros(width + 1, np.int64)  # best[c]: row i-1, column i-1-band+c
    for i in range(len(a)):
        match = (padded[i:i + width] == a[i]) & inside[i:i + width]
        diagonal, above = best[:-1], best[1:]
        row = np.where(match, diagonal + 1, above)
        best = np.append(np.maximum.accumulate(np.maximum(row, above)), 0)
        best[-1] = best[-2]
    return int(best[-1])


def similar(a: np.ndarray, b: np.ndarray, t: float = THRESHOLD) -> bool:
    """True if the similarity of the two k-mer sequences is at least ``t``.

    Two bounds decide most pairs: the shared labelled k-mers (an upper bound), and those of
    them that stand in order within the band (a lower bound, and exact if no k-mer repeats).
    What they leave open is aligned.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    la, lb = labelled(a), labelled(b)
    shared, at_a, at_b = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    if _similarity(len(shared), n, m) < t:
        return False
    band = int((1 - t) / (1 + t) * (n + m)) + 1
    near = np.abs(at_a - at_b) <= band
    in_order = at_b[near][np.argsort(at_a[near])].tolist()
    tails: list[int] = []  # patience sorting: longest increasing subsequence
    for p in in_order:
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    if _similarity(len(tails), n, m) >= t:
        return True
    if la is a and lb is b:
        return False
    return _similarity(banded_alignment(a, b, band), n, m) >= t


# --- Spark -----------------------------------------------------------------------------------

def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_bytes"))
        keys = [sketches(t.as_py()) if t.is_valid else [] for t in texts]
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_bytes"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(keys, pa.list_(pa.int64()))],
            [*[n for n in batch.schema.names if n != "_bytes"], "keys"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, first = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        linked = []
        for i, (x, _) in enumerate(zip(a, b)):
            if x != held:
                held, first = x, kmers(batch.column(2)[i].as_py())
            linked.append(similar(first, kmers(batch.column(3)[i].as_py())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
            pa.array(linked, pa.bool_()))


def _verify_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links (outsider, other) that join the components of one block pair.

    The k-mers that an outsider shares with all others are counted at once; pairs that can be
    similar by that count are compared unless links found before in this block pair already
    put them in one component, so a group of near copies costs a comparison for each joined
    component, not one for each pair.
    """
    outs, others = group[group["out"]], group[~group["out"]]
    grams = [kmers(bytes(t)) for t in others["text"]]
    marks = [labelled(g) for g in grams]
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    pool = np.concatenate(marks) if marks else np.empty(0, np.uint64)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    nodes, comps, aside = others["node"].to_numpy(), others["comp"].to_numpy().copy(), others["aside"].to_numpy()
    out_comps = outs["comp"].to_numpy().copy()
    links = []
    for k, o in enumerate(outs.itertuples(index=False)):
        g = kmers(bytes(o.text))
        lo, hi = np.searchsorted(pool, mark := labelled(g), "left"), np.searchsorted(pool, mark, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        shared = np.bincount(owner[at], minlength=len(grams))
        # A pair of two outsiders is met twice; it is taken once.
        want = (comps != out_comps[k]) & (~aside | (nodes > o.node)) \
            & (shared >= THRESHOLD * (sizes + len(g) - shared))
        for i in np.flatnonzero(want):
            if comps[i] != out_comps[k] and similar(g, grams[i]):
                links.append((o.node, nodes[i]))
                joined = comps[i]
                out_comps[out_comps == joined] = out_comps[k]
                comps[comps == joined] = out_comps[k]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored: node, text (binary), for the nodes in ``wanted``."""
    need = nodes.join(wanted, "node").select("node", "digest", "_id")
    rows = docs.select(F.md5("_bytes").alias("digest"), "_id", F.col("_bytes").alias("text"))
    need = F.broadcast(need) if fits_broadcast(need := cut_lineage(need, "omh-wanted"), 120) else need
    found = rows.join(need, (rows["digest"] == need["digest"]) & rows["_id"].eqNullSafe(need["_id"]))
    return cut_lineage(found.select("node", "text").dropDuplicates(["node"]), "omh-texts")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Stored, one row per row of ``docs``: _id, digest, root (class), size of the class, kept
    (the class's row of least id), class_id (that id)."""
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, text, id_col)


def _near_duplicates(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_bytes"))
    id_type = rows.schema["_id"].dataType.simpleString()
    signed = cut_lineage(
        rows.withColumn("digest", F.md5("_bytes")).withColumn("_row", F.monotonically_increasing_id())
        .select("_id", "digest", "_row", "_bytes")
        .mapInArrow(_sketch_batches, f"_id {id_type}, digest string, _row long, keys array<long>")
        .withColumn("_text_key", F.coalesce("digest", F.concat(F.lit("row "), F.col("_row").cast("string")))),
        "omh-signed")
    node_of = cut_lineage(signed.groupBy("_text_key").agg(F.min("_row").alias("node")), "omh-nodes")
    nodes = signed.join(node_of.select(F.col("node").alias("_row")), "_row").select(
        F.col("_row").alias("node"), "digest", "_id", "keys")

    members = nodes.select("node", F.explode("keys").alias("key"))
    groups = members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = cut_lineage(groups, "omh-groups")
    members = cut_lineage(members.join(groups, "key"), "omh-members")
    star = cut_lineage(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
                       .distinct(), "omh-star")
    wanted = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts_of(rows, nodes, wanted)

    pairs = (star.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
             .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))
    links = cut_lineage(pairs.select("a", "b", "ta", "tb")
                        .mapInArrow(_verify_batches, "a long, b long"), "omh-links")

    near = components(links)
    far = components(_contracted(_cross_links(members, near, texts), near))
    placed = cut_lineage(
        signed.select("_id", "digest", "_row", "_text_key")
        .join(_rooted(_rooted(node_of.withColumn("root", F.col("node")), near), far), "_text_key")
        .select("_id", "digest", "_row", "root"), "omh-placed")
    classes = cut_lineage(placed.groupBy("root").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"),
        F.count(F.lit(1)).alias("class_size")), "omh-classes")
    return cut_lineage(placed.join(classes, "root").select(
        "_id", "digest", "root", F.col("_first._id").alias("class_id"), "class_size",
        (F.col("_row") == F.col("_first._row")).alias("kept")), "omh-result")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with each ``root`` replaced by the root that ``roots`` has for it, if any."""
    told = roots.select(F.col("node").alias("root"), F.col("root").alias("_told"))
    return rows.join(told, "root", "left").withColumn("root", F.coalesce("_told", "root")).drop("_told")


def _contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` between the components that ``roots`` names, each once: their components are
    found without another pass over the links inside."""
    one = _rooted(links.select(F.col("a").alias("root"), "b"), roots)
    both = _rooted(one.select(F.col("root").alias("a"), F.col("b").alias("root")), roots)
    return cut_lineage(both.select("a", F.col("root").alias("b")).distinct(), "omh-far-links")


def _cross_links(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of one group that lie in different components (its first node
    has been compared with all)."""
    inner = members.where("node <> first").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("comp"))
    inner = cut_lineage(inner, "omh-inner")
    parts = inner.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    whole = cut_lineage(
        parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"),
                                 F.count(F.lit(1)).alias("n_comps")).where("n_comps > 1")
        .select("key", F.col("top.comp").alias("main"), "n", (F.col("n") - F.col("top.n")).alias("n_out")),
        "omh-open")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    open_ = (inner.join(whole, "key").withColumn("aside", F.col("comp") != F.col("main"))
             .withColumn("_no", blocks("n_out")).withColumn("_nm", blocks("n")))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outs = open_.where("aside").select("key", deal(F.col("_no")).alias("bo"), upto("_nm").alias("bm"),
                                       "node", "comp", "aside", F.lit(True).alias("out"))
    others = open_.select("key", deal(F.col("_nm")).alias("bm"), upto("_no").alias("bo"),
                          "node", "comp", "aside", F.lit(False).alias("out"))
    return (outs.unionByName(others).join(texts, "node").groupBy("key", "bo", "bm")
            .applyInPandas(_verify_block, "a long, b long").distinct())


def class_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select(
        F.col("_id").alias("doc_id"), "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each class.

    Rows are told apart by id and text.  Rows that agree in both (and so are in one class) are
    reduced to one where theirs is the row to keep.
    """
    found = near_duplicates(docs)
    keys = cut_lineage(found.groupBy("digest", "_id").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1")
        .where("digest IS NOT NULL"), "omh-drop")
    keys = F.broadcast(keys) if fits_broadcast(keys, 120) else keys
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("_doc"), F.md5(F.col("text").cast("binary")).alias("_dg"),
                       F.col("doc_id").alias("_key_id"))
    same = (F.col("_dg") == F.col("digest")) & F.col("_key_id").eqNullSafe(F.col("_id"))
    once = rows.join(keys, same, "left_anti").select("_doc.*")
    again = (rows.join(keys.where("kept"), same, "left_semi").dropDuplicates(["_dg", "_key_id"]).select("_doc.*"))
    return once.unionByName(again)
