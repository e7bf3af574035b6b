"""Operator 2 (native): repeated runs of lines, by a suffix array over line ids.

Every line is an id; a suffix is a position (document, line) and what follows it in
its document. Lines that occur once end every repeated run, so only positions of
repeated lines take part. Prefix doubling gives, level by level, the rank of the
first 2^k lines of each suffix among all repeated runs of that length, from the pair
of ranks of its halves; ranks keep the order of suffixes. Longest-common-prefix
intervals are then descended from the longest level down: suffixes that share their
first l lines stay together, and each finds the greatest l at which an earlier
suffix shares its interval.

A line goes if it lies in a run of at least min_words words that also begins at an
earlier position (by doc_id, then line), overlapping runs included. So one copy of
every run stays.

Defined results: lines are what newlines separate; a null text has no lines, an
empty one has one empty line; a null doc_id is an id like others, first in order;
empty lines are lines of no words; texts of any number of lines are taken whole; rows of
one doc_id with several texts follow one another by the texts' hash; rows that repeat
wholly are one document here, whose marks all of them get; an empty table gives an empty
result; other columns, whatever their names, are kept by :func:`dedup_lines`, only
one called lines_removed gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import WORD, let, unbound, written

MIN_WORDS = 50


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def positions(docs: DataFrame) -> DataFrame:
    """Positions of repeated lines: p (in document order), doc_id, th, line, n_words, rank, seg.

    p counts up by one within a run of neighbouring lines; seg is such a run's last p.
    rank orders line ids. A line's id is 128 bits of two hashes.
    """
    lines = docs.where("text is not null").select("doc_id", _text_hash().alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    ids = lines.select("doc_id", "th", "line", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), F.regexp_count("t", F.lit(WORD)).alias("n_words"))
    ids = written(ids, "lines")
    many = ids.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    many = written(many, "lines-repeated")
    rank = many.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").withColumn("rank", F.monotonically_increasing_id())
    own = ids.join(rank, ["h1", "h2"]).select("doc_id", "th", "line", "n_words", "rank").distinct()
    placed = own.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "line").withColumn("p", F.monotonically_increasing_id())
    placed = written(placed, "lines-placed")
    # Neighbours: line and p rise together.
    seg = F.max("p").over(Window.partitionBy("doc_id", "th", F.col("line") - F.col("p")))
    return written(placed.withColumn("seg", seg), "lines-positions")


def doubled(level: DataFrame, k: int) -> DataFrame:
    """Ranks of runs of 2^(k+1) lines (p, seg, rank) from those of 2^k lines; unique ones go."""
    step = 1 << k
    ahead = F.first("rank").over(Window.partitionBy("seg").orderBy("p").rangeBetween(step, step))
    pairs = level.withColumn("rank2", ahead).where("rank2 is not null")
    many = pairs.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank", "rank2")
    number = many.repartitionByRange("rank", "rank2").sortWithinPartitions("rank", "rank2").withColumn("next", F.monotonically_increasing_id())
    return pairs.join(number, ["rank", "rank2"]).select("p", "seg", F.col("next").alias("rank"))


def suffix_levels(places: DataFrame) -> list[DataFrame]:
    """Levels k = 0, 1, ... of prefix doubling, as long as a run of 2^k lines repeats."""
    levels = [places.select("p", "seg", "rank")]
    while True:
        step = written(doubled(levels[-1], len(levels) - 1), "lines-level")
        if step.isEmpty():
            return levels
        levels.append(step)


def earlier_runs(levels: list[DataFrame]) -> DataFrame:
    """(p, seg, n_lines): the longest run at p that also begins at an earlier position.

    A node is an LCP interval: the suffixes that share their first n_lines lines, named
    by the earliest of them. From each level down, a suffix moves into the deeper
    interval unless it is the earliest there; the earliest stays where it is and is put
    beside the others as their witness (own false), one to an interval.
    """
    state = levels[0].select("p", "seg", F.lit(True).alias("own"), F.lit(-1).cast("long").alias("node"), F.lit(0).cast("long").alias("n_lines"))
    for k in range(len(levels) - 1, -1, -1):
        block = levels[k].select(F.col("p").alias("at"), F.col("rank").alias("block"))
        tried = state.withColumn("at", F.col("p") + F.col("n_lines")).join(block, "at", "left")
        # Suffixes without such a block get a key of their own, so that they don't meet in one place.
        tried = tried.withColumn("block", F.coalesce(F.when(F.col("at") <= F.col("seg"), F.col("block")), -1 - F.col("p"))).drop("at")
        name = ["node", "n_lines", "block"]
        deeper = tried.where("block >= 0").groupBy(*name).agg(F.min("p").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        tried = tried.join(unbound(deeper, "node"), name, "left")
        stay = F.struct("own", "node", "n_lines")
        down = F.struct(F.col("own"), F.col("first").alias("node"), (F.col("n_lines") + (1 << k)).alias("n_lines"))
        witness = F.struct(F.lit(False).alias("own"), F.col("first").alias("node"), (F.col("n_lines") + (1 << k)).alias("n_lines"))
        then = F.when(F.col("first").isNull(), F.array(stay)).when(F.col("p") > F.col("first"), F.array(down)).otherwise(F.array(stay, witness))
        state = written(tried.select("p", "seg", F.explode(then).alias("s")).select("p", "seg", "s.own", "s.node", "s.n_lines"), "lines-intervals")
    return state.where("own and n_lines > 0").select("p", "seg", "n_lines")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, line, n_words) of the lines that go."""
    places = positions(docs)
    runs = earlier_runs(suffix_levels(places))
    upto = F.sum("n_words").over(Window.partitionBy("seg").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = places.withColumn("upto", upto)
    last = places.select(F.col("p").alias("end"), F.col("upto").alias("end_words"))
    long = places.join(runs.select("p", (F.col("p") + F.col("n_lines") - 1).alias("end")), "p").join(last, "end")
    long = long.where(F.col("end_words") - F.col("upto") + F.col("n_words") >= min_words).select("p", "end")
    reach = F.max("end").over(Window.partitionBy("seg").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = places.join(long, "p", "left").withColumn("reach", reach).where(F.col("reach") >= F.col("p"))
    return covered.select("doc_id", "th", "line", "n_words")


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers, in steps in proportion to its lines."""

    def rest(s: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])
        return F.transform(numbers, lambda i: F.get(s["lines"], i))

    return F.array_join(let(F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone")), rest), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that go, with lines_removed (int array, sorted)."""
    gone = removed_lines(docs.select("doc_id", "text"), min_words)
    gone = gone.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).agg(F.sort_array(F.collect_list("line")).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), _text_hash().alias("th"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")), "left")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("gone")))
    rest = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "lines_removed"]
    return rows.select(*rest, F.coalesce("gone", F.array().cast("array<int>")).alias("lines_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and CRC-32 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))).otherwise(0)
    out = dedup_lines(docs.withColumn("n_lines", n.cast("long")))
    left = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "n_lines", F.size("lines_removed").cast("long").alias("n_removed"), left.alias("kept_crc32"), "lines_removed")
