"""Exact histogram of encoded lengths, and what every context limit would keep."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import cut
from spanwise.operators.ordered import Scan, Seq, scan

#: Characters given to the encoder at one time where a text can be cut without changing its tokens.
PIECE = 1 << 16


@cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_length(text: str, path: str) -> int:
    """Tokens of a whole text. Long texts go in pieces that end between a visible character and a space: there the splitting pattern always ends a part."""
    enc = _encoder(path)
    n, lo = 0, 0
    while len(text) - lo > PIECE:
        at = lo + PIECE
        while at < len(text) and not (text[at] == " " and not text[at - 1].isspace()):
            at = text.find(" ", at + 1)
            if at < 0:
                at = len(text)
        n += len(enc.encode_ordinary(text[lo:at]))
        lo = at
    return n + len(enc.encode_ordinary(text[lo:]))


def with_length(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of each whole text; a null text has none (0)."""

    @F.pandas_udf("long")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([token_length(x, path) if isinstance(x, str) else 0 for x in s], dtype="int64")

    return docs.withColumn(into, size(F.col(text)))


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with what suffix sums tell of it as a context limit.

    n_docs; docs_below and docs_at_least; tokens_below and tokens_at_least; tokens_kept, the
    total when every document is cut to this length; quantile, the share of documents
    up to and with this length. Rows are combined per length before they move; the sums over
    the sorted lengths run in blocks of lengths with one carried row each, so no task sees the
    whole histogram. An empty table has no row.
    """
    hist = cut(lengths.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n_docs")))
    tokens = F.col("length") * F.col("n_docs")
    docs, total = hist.agg(F.sum("n_docs"), F.sum(tokens)).first()
    hist = hist.withColumn("_tokens", tokens).withColumn("_all", F.lit(0))
    run = scan(hist, Seq(("_all",), ("length",), 512.0), _d=Scan("sum", F.col("n_docs")), _t=Scan("sum", F.col("_tokens")))
    out = run.withColumn("_db", F.col("_d") - F.col("n_docs")).withColumn("_tb", F.col("_t") - F.col("_tokens"))
    out = out.withColumn("_nd", F.lit(docs).cast("long")).withColumn("_nt", F.lit(total).cast("long"))
    return out.select(
        "length",
        "n_docs",
        F.col("_db").alias("docs_below"),
        (F.col("_nd") - F.col("_db")).alias("docs_at_least"),
        F.col("_tb").alias("tokens_below"),
        (F.col("_nt") - F.col("_tb")).alias("tokens_at_least"),
        (F.col("_tb") + F.col("length") * (F.col("_nd") - F.col("_db"))).alias("tokens_kept"),
        (F.col("_d") / F.col("_nd")).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Totals when documents are cut to any ``limit``, also one that no document has: docs, docs_cut, tokens, tokens_kept."""
    n, long = F.col("n_docs"), F.col("length") > limit
    return hist.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.when(long, n)), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(n * F.col("length")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(n * F.least(F.col("length"), F.lit(limit))), F.lit(0)).alias("tokens_kept"),
    )


def at_quantile(hist: DataFrame, q: float) -> DataFrame:
    """Smallest length whose share of documents reaches ``q``; null for an empty table."""
    return hist.agg(F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias("length"))
