"""Operator 1: minimum-cost-flow resharding.

Documents lie in old shards of any sizes; new shards have capacities in bytes.
A transportation problem (supplies: old sizes, demands: new capacities, cost 0 for
bytes that stay and 1 for bytes that move, or a cost matrix of the caller) is
solved by successive shortest paths; its flows are laid out as byte intervals of
each old shard, and every document goes where its middle byte falls. Only block
totals (bounded by old shards x size classes x buckets) reach the driver, never
documents.

Defined results: a null text has size 1 (no bytes plus 1) and CRC-32 0; a null
old-shard key counts as a key of its own; repeated rows are rows of their own and
get slots of their own, and so do rows with a null doc_id; a text of any length is one
row; documents of equal size are in the order of their ids (null first); an empty table
gives an empty result; other columns are ignored by the plan, or carried through it
(keep), so that no row has to be found again by its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import scratch_path, text_crc32
from textquarry.sources.parts import Store

#: Buckets of a (old shard, size class), at least and at most, and documents to a bucket in all
#: shards: more buckets make smaller sort groups, and more block totals on the driver.
BUCKETS, MOST_BUCKETS, BUCKET_DOCS = 128, 1024, 1_000_000
#: Bytes that a task gets, at least and at most (a block is never cut), and what a row counts beside its size.
#: In between, Spark's number of shuffle partitions decides.
LEAST_PACK, MOST_PACK, ROW_BYTES = 1 << 20, 32 << 20, 100
#: Size classes are powers of two; sizes are longs, so there are 63 at most.


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]] | None = None) -> list[list[int]]:
    """Flow of least cost from supplies to demands (equal sums), all integers.

    Successive shortest augmenting paths (Bellman-Ford over the residual graph).
    Without a cost matrix, moved bytes cost 1 and bytes that stay cost 0.
    """
    n, m = len(supply), len(demand)
    if cost is None:
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
    left, need = list(map(int, supply)), list(map(int, demand))
    if sum(left) != sum(need):
        raise ValueError("supplies and demands differ in total")
    flow = [[0] * m for _ in range(n)]
    far = float("inf")
    while any(left):
        dist_s, dist_t = [0 if x else far for x in left], [far] * m
        from_s: list[int] = [-1] * n
        from_t: list[int] = [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist_s[i] < far:
                    for j in range(m):
                        if dist_s[i] + cost[i][j] < dist_t[j]:
                            dist_t[j], from_t[j], changed = dist_s[i] + cost[i][j], i, True
            for j in range(m):
                if dist_t[j] < far:
                    for i in range(n):
                        if flow[i][j] and dist_t[j] - cost[i][j] < dist_s[i]:
                            dist_s[i], from_s[i], changed = dist_t[j] - cost[i][j], j, True
        j = min((j for j in range(m) if need[j]), key=lambda j: dist_t[j])
        path, end, amount = [], j, need[j]
        while True:
            i = from_t[j]
            path.append((i, j, 1))
            if from_s[i] < 0:
                amount = min(amount, left[i])
                start = i
                break
            j = from_s[i]
            path.append((i, j, -1))
            amount = min(amount, flow[i][j])
        for i, j, sign in path:
            flow[i][j] += sign * amount
        left[start] -= amount
        need[end] -= amount
    return flow


def _equal_capacities(total: int, n: int) -> list[int]:
    return [total * (j + 1) // n - total * j // n for j in range(n)]


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def plan(
    docs: DataFrame,
    old_shard: Column,
    n_old: int,
    n_new: int = 8,
    capacities: Sequence[int] | None = None,
    cost: Sequence[Sequence[int]] | None = None,
    buckets: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot.

    old_shard: an int from 0 to n_old - 1. capacities: bytes of each new shard
    (scaled to the total), equal by default. keep: the whole row goes along as the
    struct kept. It is shuffled once: a task gets a run of whole blocks of about as many
    bytes as any other task's, in the order of the layout, so its rows go to few shards.
    """
    spark = docs.sparkSession
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, docs.count() // BUCKET_DOCS))
    keys = docs.select(
        "doc_id",
        _size().alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept")] if keep else []),
    ).withColumns(
        {
            "cls": (F.length(F.bin("size")) - 1).cast("int"),
            "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"),
        }
    )
    blocks = keys.groupBy("old_shard", "cls", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")).collect()
    room = sum(r.bytes + ROW_BYTES * r.n_rows for r in blocks)
    pack = min(MOST_PACK, max(LEAST_PACK, room // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at: dict[int, int] = dict.fromkeys(range(n_old), 0)
    starts, run = [], 0
    for r in sorted(blocks, key=lambda r: (r.old_shard, -r.cls, r.bucket)):
        starts.append((r.old_shard, r.cls, r.bucket, at[r.old_shard], run // pack))
        at[r.old_shard] += r.bytes
        run += r.bytes + ROW_BYTES * r.n_rows
    supply = [at[i] for i in range(n_old)]
    total = sum(supply)
    if capacities is None:
        wanted = _equal_capacities(total, n_new)
    else:
        whole, run, wanted = sum(capacities), 0, []
        for c in capacities:
            wanted.append(total * (run + c) // whole - total * run // whole)
            run += c
    flow = min_cost_flow(supply, wanted, cost)
    # Byte intervals of each old shard: what stays comes first, so the smallest documents move.
    cuts = []
    for i in range(n_old):
        order = sorted((j for j in range(len(wanted)) if flow[i][j]), key=lambda j: (j != i, j))
        run = 0
        for j in order:
            cuts.append((i, run, run + flow[i][j], j))
            run += flow[i][j]
    start = spark.createDataFrame(starts, "old_shard int, cls int, bucket int, start long, pack int")  # one row a block
    block = ["pack", "old_shard", "cls", "bucket"]  # with its pack, so that Spark sees that packs hold whole blocks
    inside = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "text_crc32")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keys.join(F.broadcast(start), ["old_shard", "cls", "bucket"])
        .repartitionById(room // pack + 1, "pack")
        .withColumn("within", F.sum("size").over(upto))
        .withColumn("middle", F.col("start") + F.col("within") - F.col("size") + F.expr("size div 2"))
    )
    target = F.lit(None).cast("int")
    for i in range(n_old):
        own = F.lit(None).cast("int")
        for _, lo, _hi, j in reversed([c for c in cuts if c[0] == i]):
            own = F.coalesce(own, F.when(F.col("middle") >= lo, F.lit(j)))
        target = F.when(F.col("old_shard") == i, own).otherwise(target)
    placed = placed.withColumn("shard", target)
    # Slots: a running count of blocks within a shard (a small table), plus the place within the block.
    part = ["shard", *block]
    place = F.row_number().over(Window.partitionBy(*part).orderBy("within"))
    placed = placed.withColumn("place", place)
    before = Window.partitionBy("shard").orderBy("old_shard", F.desc("cls"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*part).count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    out = placed.join(F.broadcast(bases), part)  # blocks, split at most once per cut
    slot = (F.col("base") + F.col("place") - 1).cast("long").alias("slot")
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", slot, *(["kept"] if keep else []))


def old_shard_of(column: str, n_old: int) -> Column:
    """The old layout that the queries assume: files by hashed source."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit("\x00"))), F.lit(n_old)).cast("int")


def transfers(planned: DataFrame) -> DataFrame:
    """Bytes and rows moved from each old to each new shard."""
    return planned.groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def layout(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the shards under root, as its manifest names their folders."""
    return Store.open(spark, root).read("shards")


def lay_out(docs: DataFrame, root: str, shard: Column) -> Store:
    """docs as shards under root, in a folder each."""
    store = Store.open(docs.sparkSession, root)
    return store.commit({"shards": store.stage("shards", docs.withColumn("shard", shard.cast("int")), "shard", order=[])})


def rewrite_affected(docs: DataFrame | None, planned: DataFrame, root: str) -> DataFrame:
    """Writes anew those shards under root (of :func:`lay_out`) that gain or lose a document.

    A shard whose documents are the same as before keeps its old files. The new ones are
    written beside the old, and one manifest switches them all: a stop before it leaves the
    old layout whole, and after it nothing is left to do but to delete the old files.
    Kept rows are written by the tasks that number them: their texts are shuffled once, for the plan.
    docs need doc_ids without repetition and nulls here; None takes the rows that planned
    keeps, whatever their ids. A file is in the order of slots; the kept rows' files of
    one shard hold blocks of slots in any order. Returns (shard, rewritten, n_rows, bytes).
    """
    spark = planned.sparkSession
    # At most old times new shards; taken now, since files that planned reads go in the end.
    moves = transfers(planned).collect()
    ids = sorted({i for r in moves if r.old_shard != r.shard for i in (r.old_shard, r.shard)})
    if ids:
        inside = planned.where(F.col("shard").isin(ids))
        if docs is None:
            names = [c for c in planned.schema["kept"].dataType.names if c not in ("shard", "slot")]
            rows = inside.select(*(F.col("kept")[c].alias(c) for c in names), "shard", "slot")
        else:
            rows = docs.drop("shard", "slot").join(inside.select("doc_id", "shard", "slot"), "doc_id").repartitionByRange("shard", "slot")
        store = Store.open(spark, root)
        store.commit({"shards": store.stage("shards", rows, "shard", order=["slot"], stay=True)}, {"shards": ids}).vacuum()
    told = [(j, j in ids, sum(r.n_rows for r in moves if r.shard == j), sum(r.bytes for r in moves if r.shard == j)) for j in sorted({r.shard for r in moves})]
    return spark.createDataFrame(told, "shard int, rewritten boolean, n_rows long, bytes long")


def reshard(docs: DataFrame, root: str, old_shard: Column, n_old: int, n_new: int) -> DataFrame:
    """docs laid out as old shards under root, resharded there, and read back: their columns, shard and slot."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    files = lay_out(docs, root, old_shard).read("shards")
    told = rewrite_affected(None, plan(files, F.col("shard"), n_old, n_new, keep=True), root).collect()
    files = layout(spark, root)
    files = files if "slot" in files.columns else files.withColumn("slot", F.lit(None).cast("long"))
    files = files.select(*docs.columns, "slot", "shard")
    same = {r.shard: r.bytes for r in told if not r.rewritten}
    if not same:
        return files
    # Old files hold no slots; those of a shard that nothing enters or leaves follow from its files alone.
    old = files.where(F.col("shard").isin(list(same)))
    slots = plan(old, F.col("shard"), n_old, n_old, [same.get(i, 0) for i in range(n_old)], keep=True)
    slots = slots.select(*(F.col("kept")[c].alias(c) for c in docs.columns), "slot", "shard")
    return files.where(~F.col("shard").isin(list(same))).unionByName(slots)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table resharded: files of hashed sources to eight equal shards; told from the new files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = reshard(docs, scratch_path(spark, "shards"), old_shard_of("source", 8), 8, 8)
    return out.select(
        "doc_id", _size().alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old_shard_of("source", 8).alias("old_shard"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the rows of docs with their size, shard and slot.

    The plan carries whole rows, so every row comes back once, whatever its doc_id.
    """
    docs = docs.drop("size", "shard", "slot")  # columns of these names give way to the stage's own
    out = plan(docs, old_shard_of("source", 8), 8, 8, keep=True)
    return out.select(*(F.col("kept")[c].alias(c) for c in docs.columns), "size", "shard", "slot")
