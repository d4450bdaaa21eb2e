"""Token counts: an exact histogram of encoded lengths.

Every whole text is encoded in the tasks; what leaves them is the text's length, and the
lengths are summed to one row per distinct length before and after the shuffle.  Suffix sums
over that histogram answer, for every context limit that occurs as a length: how many
documents are longer, how many tokens remain if each text is cut at the limit, and which
quantile the limit is.

Scale: the histogram has at most as many rows as the longest text has tokens.  Its sums run
in blocks of ``BLOCK`` lengths; only one row per block meets in one task.

Very long runs of white space are cut out before the tokenizer's splitter sees them, which
would recurse once per character: by the pattern such a run is one piece without its last
character (which goes with what follows), or one piece whole at the end of a text.  Texts of
any other kind go to the splitter as they are.

Defined results: NULL and empty texts have length 0 and are counted; special tokens' strings
are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: GPT-2's published splitting pattern, the one that the byte-level vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 64
#: A long run of what the splitter takes for white space (Unicode's White_Space).
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

_encodings: dict[str, object] = {}  # per worker process


def _encoding(name: str, ranks_file: bytes, pattern: str):
    if name not in _encodings:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks,
                                             special_tokens={})
    return _encodings[name]


def count_tokens(encoding, text: str) -> int:
    """The number of tokens of a whole text, for splitting patterns that treat white space as ``PATTERN`` does."""
    n = at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at:run.start()]))
        n += len(encoding._encode_single_piece(text[run.start():end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def token_lengths(texts: DataFrame, vocabulary: str = DEFAULT_VOCABULARY,
                  pattern: str = PATTERN) -> DataFrame:
    """``texts``: one column of texts -> one column ``n_tokens`` (long), row by row.

    The vocabulary file is read once on the driver (its size is the vocabulary's, not the
    corpus's) and reaches the tasks as a broadcast variable.
    """
    with open(vocabulary, "rb") as fh:
        ranks = texts.sparkSession.sparkContext.broadcast(fh.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary, ranks.value, pattern)
        for batch in batches:
            lengths = [count_tokens(enc, t.as_py()) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return texts.mapInArrow(encode, "n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", **encoder) -> DataFrame:
    return (token_lengths(docs.select(F.col(text)), **encoder)
            .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L: docs and tokens at, above and below it, and totals for texts cut at L."""
    hist = cut_lineage(histogram.withColumn("_b", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
                       .withColumn("_t", F.col("n_tokens") * F.col("n_docs")), "length-histogram")
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_b", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (
        ("_bd", later, "_ld"), ("_bt", later, "_lt"), ("_bd", whole, "total_docs"), ("_bt", whole, "total_tokens"))])
    longer = Window.partitionBy("_b").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    rows = (hist.join(blocks, "_b")
            .withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("_ld"))
            .withColumn("tokens_longer", F.coalesce(F.sum("_t").over(longer), F.lit(0)) + F.col("_lt")))
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"))
        .alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_up_to"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"))


def token_count_table(docs: DataFrame) -> DataFrame:
    return suffix_sums(length_histogram(docs))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every text is cut at ``limit`` (any limit, not only occurring lengths):
    texts longer than it count ``limit`` each, the others whole.  One row; 0 without documents."""
    return table.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")),
                                F.lit(0)).alias("tokens"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length with at least the share ``q`` of documents up to it.  One row."""
    return table.agg(F.min(F.when(F.col("docs_up_to") >= F.lit(q) * F.col("total_docs"),
                                  F.col("n_tokens"))).alias("n_tokens"))
