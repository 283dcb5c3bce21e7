"""Token counts: an exact histogram of encoded lengths, and suffix sums over it."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split before merging; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern calls white space; a fixed value, as the pattern is.
SPACES = "\t\n\v\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{SPACES}]{{4096,}}")
BLOCK = 4096  # lengths in one window of the suffix sums


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Token ids of a text. Long runs of white space, on which the pattern's backtracking overflows, are cut out as the pattern would."""
    own = encoder(vocabulary)
    out, last = [], 0
    for run in LONG_RUN.finditer(text):
        # All of a run is one piece but its last character, which goes with what follows, if anything does.
        end = run.end() - (run.end() < len(text))
        out += own.encode_ordinary(text[last : run.start()])
        out += own._core_bpe.encode_single_piece(text[run.start() : end].encode())
        last = end
    return out + own.encode_ordinary(text[last:]) if last else own.encode_ordinary(text)


def length_of(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, vocabulary)) for t in texts], dtype="int64")

    return count(text)


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs its number of tokens. Whole texts are encoded; a null text is empty and has none.

    Texts of any length, and white space or letters without end, are encoded
    in time near their length. ``vocabulary`` is a path that every worker can
    read; it names a file of ranks, which is not copied.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(t.as_py(), vocabulary)) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) for each length that occurs; combined before the shuffle, so its size is that of the lengths' range."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each length L: what a context limit of L keeps and cuts.

    Columns: n_tokens (L), n_docs (of that length), docs_ge and tokens_ge
    (documents of L tokens or more and their tokens), truncated_total (tokens
    left when each document is cut to L), cut_tokens (those lost),
    quantile (share of documents of L tokens or fewer), limit_from (one more
    than the length before L, 0 for the first) and tokens_total. A row answers
    every limit c from limit_from to L: docs_ge documents have c tokens or
    more, and tokens_total - tokens_ge + c * docs_ge tokens are left; a limit
    past the largest length keeps all. Sums are taken within blocks of
    lengths, and over the blocks (one row for each 4096 tokens of the longest
    text) in one window. An empty histogram gives no rows.
    """
    scratch = scratch or Scratch(hist.sparkSession, "tokens")
    h = scratch.table(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "histogram")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"), F.max("n_tokens").alias("longest"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), zero).alias(f"later_{c}") for c in "dt"), *(F.sum(c).over(every).alias(f"all_{c}") for c in "dt"), F.lead("longest").over(W.orderBy(F.desc("block"))).alias("below"))
    own = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    x = h.join(blocks, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(own) + F.col("later_d")).alias("docs_ge"), (F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("later_t")).alias("tokens_ge"), "all_d", "all_t", (F.coalesce(F.lag("n_tokens").over(W.partitionBy("block").orderBy("n_tokens")), F.col("below"), F.lit(-1)) + 1).alias("limit_from"))
    kept = F.col("all_t") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return x.select("n_tokens", "n_docs", "docs_ge", "tokens_ge", kept.alias("truncated_total"), (F.col("all_t") - kept).alias("cut_tokens"), ((F.col("all_d") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_d")).alias("quantile"), "limit_from", F.col("all_t").alias("tokens_total"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: docs_over, tokens_total and truncated_total, read off the suffix sums in one pass.

    The documents longer than a limit are those counted at the next length
    that occurs. Without documents the sums are 0.
    """
    next_up = [F.min_by(F.struct("docs_ge", "tokens_ge"), F.when(F.col("n_tokens") > limit, F.col("n_tokens"))).alias(f"s{i}") for i, limit in enumerate(limits)]
    one = sums.agg(F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("tokens_total"), *next_up)
    rows = F.array(*(F.struct(F.lit(limit).cast("long").alias("limit"), F.coalesce(f"s{i}.docs_ge", F.lit(0)).alias("docs_over"), F.coalesce(f"s{i}.tokens_ge", F.lit(0)).alias("held")) for i, limit in enumerate(limits)))
    return one.select("tokens_total", F.explode(rows).alias("r")).select("r.limit", "r.docs_over", "tokens_total", (F.col("tokens_total") - F.col("r.held") + F.col("r.docs_over") * F.col("r.limit")).alias("truncated_total"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The suffix sums of the encoded lengths of docs. Repeated rows count each time; other columns are ignored."""
    return suffix_sums(histogram(encoded_lengths(docs, vocabulary)))
