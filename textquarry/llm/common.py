"""Shared helpers: words as the contracts define them, memory; where intermediate tables go is told by :mod:`textquarry.sources.scratch`."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.scratch import remove, scratch_path, swept, written  # noqa: F401

#: Java regex of one word: a run without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of so many rows and bytes at most, where the session has Spark's defaults:
    texts may be long, and a batch is in memory on both sides of the pipe."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, own)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system; workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: a column named inside another lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unbound(df: DataFrame, key: str) -> DataFrame:
    """df with a key that is computed anew.

    A grouped table is already placed by its key, and a join would bring the other
    side to it as it is. Without that placement both sides are shuffled for the join,
    and Spark can split a partition that one hot key fills.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.withColumn(key, F.concat(F.col(key), F.lit("")) if kind == "string" else F.col(key).bitwiseXOR(F.lit(0).cast(kind)))


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from; a null id has no label and isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
