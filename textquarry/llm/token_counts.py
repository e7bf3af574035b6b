"""Operator 7: exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram
answer, for every context limit, how many documents and tokens there are, how
many documents are longer, and what is left when each is cut at the limit.

Encoding is byte-pair merging within pre-tokens, so a text's length is the sum of
its pre-tokens' lengths, and very long texts are encoded piece by piece. Defined results: a
null or empty text has length 0; repeated rows count each, whatever their ids (null
ones too); an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import small_batches, written

#: Place of the rank file; a parameter of :func:`token_lengths`.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths to a block of the two-level suffix sums.
SPAN = 128
#: Characters of a text that are encoded at once.
STEP = 1_000_000
#: A place between pre-tokens: a single space between other characters opens the next one.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, object] = {}


def encoder(ranks_file: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if ranks_file not in _encoders:
        import tiktoken

        with open(ranks_file) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[ranks_file] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_file]


def length(encode, text: str | None, step: int = STEP) -> int:
    """Tokens of a whole text, encoded in pieces that end between pre-tokens."""
    n, at = 0, 0
    while text and at < len(text):
        cut = _CUT.search(text, at + step) if at + step < len(text) else None
        end = cut.start() if cut else len(text)
        n += len(encode(text[at:end]))
        at = end
    return n


def token_lengths(docs: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every row's whole text."""

    @F.pandas_udf("long")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks_file).encode_ordinary
        for texts in parts:
            yield pd.Series([length(encode, t) for t in texts], dtype="int64")

    small_batches(docs.sparkSession)
    return docs.select("doc_id", lengths("text").alias("n_tokens"))


def histogram(lengths: DataFrame) -> DataFrame:
    """A row per distinct length L, with suffix sums.

    n_docs: documents of length L; docs_longer, tokens_longer: of lengths above L;
    docs_to, tokens_to: of lengths up to L; total_docs, total_tokens; truncated_tokens:
    tokens left when every document is cut at L; lost_tokens: those cut away;
    quantile: share of documents of length L or less.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.expr(f"n_tokens div {SPAN}"))
    counts = written(counts, "lengths")  # a row a length; else texts would be encoded twice
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # One row for each SPAN lengths, so this window sees few rows at any input size.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumns(
        {
            "d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
            "t_in": F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)),
        }
    ).join(blocks, "block")
    longer_d, longer_t = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    kept = F.col("total_tokens") - longer_t + longer_d * F.col("n_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        longer_d.alias("docs_longer"),
        longer_t.alias("tokens_longer"),
        (F.col("total_docs") - longer_d).alias("docs_to"),
        (F.col("total_tokens") - longer_t).alias("tokens_to"),
        "total_docs",
        "total_tokens",
        kept.alias("truncated_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
        ((F.col("total_docs") - longer_d) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits from the histogram: the suffix sums of the
    greatest length not above a limit, which hold up to the next length."""
    out = None
    for x in limits:
        row = hist.where(F.col("n_tokens") <= x).agg(F.max(F.struct("n_tokens", "docs_longer", "tokens_to")).alias("m"))
        whole = hist.agg(F.max("total_docs").alias("d"))
        # Below the least length every document is longer.
        longer = F.coalesce(F.col("m.docs_longer"), F.col("d"), F.lit(0))
        one = row.join(whole).select(F.lit(x).cast("long").alias("context_limit"), (F.coalesce("m.tokens_to", F.lit(0)) + longer * x).alias("truncated_tokens"), longer.alias("docs_longer"))
        out = one if out is None else out.unionAll(one)
    return out


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
