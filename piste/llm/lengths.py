"""Exact length histogram of encoded documents.

Every document is encoded whole; documents are aggregated by length, and suffix sums over the
lengths answer totals, shares and truncated totals for every context limit.  Between two
lengths of the result the truncated total is linear, so the result answers any limit.

Null and empty texts have length 0.  Repeated rows count each; other columns, of any name, are
ignored.  An empty table gives an empty result.  A run of blanks of any length is encoded: long ones
are taken out of the text before the pattern, which would need a step of its stack for each, and
encoded as the pieces that the pattern makes of them.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import staged

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the characters that the pattern's blank class matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{BLANKS}]{{1024,}}+")

_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    """One encoder per Python worker, read from the vocabulary file."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def encoded_length(text: str | None, encoder) -> int:
    """Tokens of a whole text.

    The pattern makes one piece of a run of blanks but for its last one, which goes to what follows
    (at the end of the text there is none to spare), so a long run can be cut there without changing
    any piece.
    """
    total, at = 0, 0
    for run in LONG_RUN.finditer(text or ""):
        end = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return total + len(encoder.encode_ordinary(text[at:])) if text else 0


def token_count(text: str | Column, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """Encoded length; another ``pattern`` must treat runs of blanks as this vocabulary's does."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return pd.Series([encoded_length(t, own) for t in texts], dtype="int64")

    return count(text)


def histogram(docs: DataFrame, text: str = "text", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): documents of every encoded length."""
    return docs.select(token_count(text, path, pattern).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def by_limit(hist: DataFrame, width: int = 4096) -> DataFrame:
    """One row per length taken as context limit: documents of that length, at most and beyond
    it, the share at most it, all tokens, tokens left when longer documents are truncated to
    the limit, and tokens of documents that fit whole.

    Running sums go in two steps, over blocks of ``width`` lengths and inside a block; the
    histogram has a row per distinct length, never one per document.
    """
    h = staged(hist, "lengths").withColumn("block", F.floor(F.col("n_tokens") / width)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    past, whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(past), F.lit(0)).alias("docs_past"),
        F.coalesce(F.sum("block_tokens").over(past), F.lit(0)).alias("tokens_past"),
        F.sum("block_docs").over(whole).alias("all_docs"), F.sum("block_tokens").over(whole).alias("all_tokens"))
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    r = h.withColumns({"docs_here": F.sum("n_docs").over(upto), "tokens_here": F.sum("tokens").over(upto)}).join(blocks, "block")
    fit, whole_tokens = F.col("docs_past") + F.col("docs_here"), F.col("tokens_past") + F.col("tokens_here")
    return r.select(
        "n_tokens", "n_docs", fit.alias("docs_fit"), (F.col("all_docs") - fit).alias("docs_longer"),
        (fit / F.col("all_docs")).alias("share_fit"), F.col("all_tokens").alias("total_tokens"),
        whole_tokens.alias("tokens_fit"), (whole_tokens + F.col("n_tokens") * (F.col("all_docs") - fit)).alias("truncated_tokens"))


def quantiles(limits: DataFrame, shares) -> DataFrame:
    """Least length that holds each share of the documents: (share, n_tokens)."""
    asked = [F.min(F.when(F.col("share_fit") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    row = limits.agg(*asked)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens"))
                                          for i, s in enumerate(shares)])).alias("r")).select("r.*")
