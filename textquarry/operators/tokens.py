"""Token counts: by a byte-pair vocabulary where one is given, else by length."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions import text as T

#: Fixed value: a published pre-token pattern of byte-pair vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(ranks_file: str | None = None, pattern: str = PATTERN) -> tuple[Callable[[Column], Column], str]:
    """(count, name): what counts the tokens of a text column, and the name that a run's configuration records.

    ranks_file: lines of a base64 token and its rank, readable on every worker. A null text
    has one token, as an empty one has by length.
    """
    if ranks_file is None:
        return lambda c: F.coalesce(T.token_estimate(c), F.lit(1)), "chars/4"

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_file) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in parts:
            yield pd.Series([max(1, len(encode(t))) if t else 1 for t in texts], dtype="int32")

    return lambda c: count(c), f"bpe:{ranks_file.rpartition('/')[2]}"
