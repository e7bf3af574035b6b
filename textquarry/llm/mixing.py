"""Operator 5: mixing sources to target weights.

The words of each source form one stream (documents in the order of a hash bucket
and their id), packed into blocks of BLOCK words. Output shards have
SHARD_SLOTS slots on average. How many slots each source has in each shard is a
multinomial draw: the source's slots, whose number follows from its target, are parted
among the shards, by a tree of shard ranges that any task can draw its own shards of from
the seed alone. The slots of a source are numbered through all shards; slot t stands for
block perm(t mod n), where perm is a pseudorandom permutation of the source's n block
indices (a Feistel network with cycle walking, another one for each pass through the
source). Blocks are joined to the documents that they cut by source and index.

Targets come from aggregates and sources are drawn row by row, large ones in several rows,
so one law holds for any number of sources and nothing that grows with it is on the driver.

Defined results: a null or wordless text has size 0 and takes nothing; null is a
source of its own, last in order; repeated rows are parts of the stream of their
own, and so are rows with a null doc_id; texts of any length are taken whole; an empty
table gives an empty mix; other columns are ignored, and kept by :func:`stage`. Reruns
agree: every draw is seeded, and the stream depends on the rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import GAP, WORD, text_crc32, word_count, written

BLOCK = 64
BUCKETS = 1024
#: Slots of an output shard on average; the number of shards follows from it.
SHARD_SLOTS = 65536
#: Slots that a row of work draws, about; and slots of a range that draw their shards one by one.
RUN, SINGLE = 1 << 19, 1024
#: Sources whose targets are broadcast; with more, a join shuffles them.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20260
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def drawn_counts(source: int, k: int, n_shards: int, lo: int, hi: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shards, slots of each, slots in shards before) of those from lo to hi that get any of a source's k slots.

    A range's slots are split between its halves by a binomial draw; those of a range with few
    (SINGLE at most) draw their shards one by one. Together that is one multinomial draw over
    all shards. Every draw is seeded by its range, so any part of it can be had by itself.
    """
    todo, out = [(0, n_shards, k, 0)], []
    while todo:
        a, b, owed, before = todo.pop()
        if not owed or b <= lo or a >= hi:
            continue
        if b - a == 1:
            out.append((np.array([a]), np.array([owed]), np.array([before])))
        elif owed <= SINGLE:
            with np.errstate(over="ignore"):
                key = _mix(np.array([source, a, b], dtype=np.uint64), np.uint64(seed)).sum(dtype=np.uint64)
                h = _mix(np.arange(owed, dtype=np.uint64), key) >> np.uint64(32)
            own, n = np.unique(a + (h * np.uint64(b - a) >> np.uint64(32)).astype(np.int64), return_counts=True)
            at, inside = before + np.cumsum(n) - n, (own >= lo) & (own < hi)
            out.append((own[inside], n[inside], at[inside]))
        else:
            m = (a + b) // 2
            left = int(np.random.Generator(np.random.PCG64([seed, source, a, b])).binomial(owed, (m - a) / (b - a)))
            todo.append((m, b, owed - left, before + left))
            todo.append((a, m, left, before))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, keyed."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key, applied to index; all arrays alike in length."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1))
    half = np.maximum(1, np.ceil(bits / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            a, b = b, a ^ (_mix(b + np.uint64(r << 40), k) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]  # cycle walking
    return x.astype(np.int64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Sources (source, source_key, size) with rank, and target: the words wanted of each.

    They go by weight, in the order of sources, none above most times its size; the excess
    over such a stop is shared by weight among the rest until none is above.
    """
    order = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = written(order.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    # Numbers begin anew in each partition, 2^33 apart; the rows before it are added.
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).count().collect()  # one row a partition
    before, run = {}, 0
    for r in sorted(counts, key=lambda r: r.part):
        before[r.part], run = run, run + r["count"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = placed.withColumn("rank", base + F.col("at").bitwiseAND((1 << 33) - 1)).withColumn("w", weight).drop("at")
    left = share * (rows.agg(F.sum("size")).first()[0] or 0)
    rate = 0.0  # words a unit of weight; only grows, so what is over once stays over
    while True:
        over = F.lit(rate) * F.col("w") > most * F.col("size")
        told = rows.agg(F.sum(F.when(over, most * F.col("size"))).alias("fixed"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count_if(over).alias("n")).first()
        now = (left - (told.fixed or 0.0)) / told.w if told.w else rate
        if now <= rate or not told.w:
            break
        rate = now
    return rows.withColumn("target", F.least(F.lit(rate) * F.col("w"), most * F.col("size"))).drop("w")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(stream, picks).

    stream: one row per document: doc_id, source, source_no, text_crc32, text_hash, size,
    source_size, target, start (first word's place in its source's stream).
    picks: one row per block drawn and document that it cuts: source_no, block, pass_no, shard,
    shard_slot, start (the document's), word (in the document), n_words.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    base = docs.select("doc_id", "source", key.alias("source_key"), text_crc32(F.col("text")).alias("text_crc32"), _text_hash().alias("text_hash"), word_count(F.col("text")).alias("size"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    base = written(base, "mix-sizes")  # counting words reads every text; do it once
    sizes = base.groupBy("source", "source_key").agg(F.sum("size").alias("size"))
    info = written(targets(sizes, weights, share, most), "mix-targets")
    blocks, slots = F.expr(f"(size + {block - 1}) div {block}"), F.expr("case when size > 0 then least(cast(most * n as long), cast(round(target * n / size) as long)) else 0L end")
    info = info.withColumns({"n": blocks, "most": F.lit(float(most))}).withColumn("k", slots).drop("most")
    told = info.select(F.col("rank").alias("source_no"), "source_key", F.col("size").alias("source_size"), "target")
    told = F.broadcast(told) if info.count() <= BROADCAST_SOURCES else told
    # Places in the stream: buckets' totals first, then the sums within a bucket.
    small = base.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = base.withColumn("upto", F.sum("size").over(inside)).join(small, ["source_key", "bucket"]).join(told, "source_key")
    stream = written(stream.select("doc_id", "source", "source_no", "text_crc32", "text_hash", "size", "source_size", "target", (F.col("base") + F.col("upto") - F.col("size")).alias("start")), "mix-stream")
    drawn = _drawn(info, seed)
    pieces = stream.where("size > 0").select(
        "source_no", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")
    )
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    pieces = pieces.select("source_no", "block", "start", (lo - F.col("start")).alias("word"), (hi - lo).alias("n_words"))
    # Spark takes the slots for as few as the rows they are made of; without the hint it would broadcast them.
    picks = pieces.join(drawn.hint("merge"), ["source_no", "block"])
    return stream, picks


def _drawn(info: DataFrame, seed: int) -> DataFrame:
    """All slots of sources (rank, n, k) with the block that each stands for; a row of work draws about RUN slots."""
    total = int(info.agg(F.sum("k")).first()[0] or 0)
    n_shards = max(1, -(-total // SHARD_SLOTS))
    parts = F.least(F.lit(n_shards), F.expr(f"cast((k + {RUN - 1}) div {RUN} as int)"))
    work = info.where("k > 0").select(F.col("rank").alias("source_no"), "n", "k", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard, counts, before = drawn_counts(r["source_no"], r["k"], n_shards, n_shards * r["part"] // r["parts"], n_shards * (r["part"] + 1) // r["parts"], seed)
                t = np.repeat(before, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                n = np.full(len(t), r["n"])
                block = permute(t % n, n, (seed * 1_000_003 + r["source_no"]) * 64 + t // n)
                cols = (np.full(len(t), r["source_no"]), block, (t // n).astype(np.int32), np.repeat(shard, counts), t)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["source_no", "block", "pass_no", "shard", "t"])

    slots = work.repartition("source_no", "part").mapInArrow(run, "source_no long, block long, pass_no int, shard long, t long")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("source_no", "t"))  # about SHARD_SLOTS rows
    return slots.withColumn("shard_slot", (place - 1).cast("long")).drop("t")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    stream, picks = mix(docs)
    taken = picks.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
    # Wordless documents share their start with the next one and take nothing.
    joined = stream.join(taken, ["source_no", "start"], "left")
    words = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", words.alias("taken"), "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each pass in which words of a document are drawn.

    Its text is the whole text as it is where the pass draws all its blocks, else the drawn
    words in order, each with the white space that follows it there (but for the last);
    n_chars follows. Rows are told apart by doc_id (null is an id like others) and text.
    """
    stream, picks = mix(docs)
    piece = F.struct("word", "n_words")
    got = picks.groupBy("source_no", "start", "pass_no").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("n_words").alias("taken"))
    # Rows of the same id and text have equal pieces of work: number both sides alike.
    rank = Window.partitionBy("doc_id", "text_hash").orderBy("source_no", "start")
    numbers = stream.where("size > 0").withColumn("nth", F.row_number().over(rank))
    chosen = numbers.join(got, ["source_no", "start"]).select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), F.col("nth").alias("own_nth"), "size", "pieces", "taken")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), F.col("doc_id").alias("id"), _text_hash().alias("hash"), key.alias("at"))
    twins = Window.partitionBy("id", "hash").orderBy(F.when(F.col("at") == "", 1).otherwise(0), "at")  # null last, as sources are numbered
    rows = rows.withColumn("nth", F.row_number().over(twins))
    alike = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")) & (F.col("nth") == F.col("own_nth"))
    out = rows.join(chosen, alike).withColumn("words", F.when(F.col("taken") < F.col("size"), F.regexp_extract_all("kept.text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"))))
    cut = F.array_join(F.flatten(F.transform(F.col("pieces"), lambda p: F.slice(F.col("words"), p["word"].cast("int") + 1, p["n_words"].cast("int")))), "")
    text = F.when(F.col("taken") < F.col("size"), F.regexp_replace(cut, rf"{GAP}\z", "")).otherwise(F.col("kept.text"))
    out = out.withColumn("text", text)
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*(made[c].cast(kinds[c]).alias(c) if c in made else F.col("kept")[c].alias(c) for c in docs.columns))
