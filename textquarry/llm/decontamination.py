"""Operator 4 (native): benchmark decontamination by size-partitioned MinHash containment.

An item's set is its distinct 5-word shingles (fewer words: the whole sequence as
one), words being lower-cased runs without white space. Items are partitioned by
set size (powers of two). A partition with sets up to u shingles keeps of each item
its k smallest shingle hashes, k = u - ceil(t * u) + 1: a containment sketch of the
small side, looked up in the whole set of a document instead of in a sketch of it,
so that long documents cost no recall. A document that holds a share t of an item
lacks fewer than k of its shingles and so holds one of the k: no such pair is
missed. Candidates are then verified on the shingles themselves.

Defined results: a null or wordless text matches nothing; rows that repeat a doc_id
or an item_id count once, with their largest containment; a null doc_id is an id like
others, an item without an id takes no part in the pairs; texts of any length are
taken whole; an empty table on either side gives an empty result; other columns are
ignored, and kept by :func:`stage`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import GAP, unbound, written

N = 5
THRESHOLD = 0.75
#: Rows of the sketch that are broadcast at once (24 bytes each), and blocks of them, each a pass
#: through the documents; a larger sketch meets the documents' hashes in a shuffled join.
BROADCAST_ROWS, MOST_BLOCKS = 1_000_000, 2
#: Items that a document's set is copied to; with more candidates, its shingles are joined with theirs.
COPIES = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def shingles(w: Column, n: int = N) -> Column:
    """Distinct n-word shingles of a word array, as strings."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(w) >= n, runs).otherwise(whole))


def shingle_hashes(w: Column, n: int = N) -> Column:
    """Hashes of the n-word shingles, repeated ones included."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(w) >= n, runs).otherwise(whole)


def sketch(items: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(item_id, part, hash): the smallest shingle hashes of each item, by size partition."""
    sets = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(shingle_hashes(F.col("w"), n)).alias("h")).where(F.size("h") > 0)
    sets = sets.withColumn("part", (F.length(F.bin(F.size("h").cast("long"))) - 1).cast("int"))
    most = F.expr("shiftleft(2L, part) - 1")  # the largest set of the partition
    k = most - F.ceil(most * threshold) + 1
    part = F.col("part")
    return sets.select("item_id", part.alias("part"), F.explode(F.slice(F.sort_array("h"), F.lit(1), k.cast("int"))).alias("hash"))


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N, broadcast_rows: int = BROADCAST_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Distinct (doc_id, item_id) whose sketch meets the document: by blocks of the sketch, or by a join on the hashes where these are many."""
    small = written(sketch(items, threshold, n), "decontam-sketch")
    blocks = max(1, -(-small.count() // broadcast_rows))
    own = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes(F.col("w"), n)).alias("hash"))
    if blocks > most_blocks:
        # A hash that many documents hold fills a partition, which Spark splits; both sides are shuffled for this join alone.
        return own.hint("merge").join(unbound(small.select("item_id", "hash"), "hash"), "hash").select("doc_id", "item_id").distinct()
    out = None
    for b in range(blocks):
        # A block holds about broadcast_rows rows of 20 bytes, whatever the benchmark's size.
        part = small.where(F.pmod(F.xxhash64("item_id", "hash"), F.lit(blocks)) == b).select("item_id", "hash")
        hit = own.join(F.broadcast(part), "hash").select("doc_id", "item_id")
        out = hit if out is None else out.unionAll(hit)
    return out.distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N, copies: int = COPIES, **how) -> DataFrame:
    """Pairs of documents and items whose containment reaches the threshold.

    doc_id, item_id, n_item (shingles of the item), n_shared, containment. A document with many
    candidates isn't copied to each: its shingles meet theirs one by one. how: of :func:`candidates`.
    """
    found = written(candidates(docs, items, threshold, n, **how), "decontam-candidates")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("c"))
    rich = written(counts.where(F.col("c") > copies).select("doc_id"), "decontam-rich")
    poor = counts.where(F.col("c") <= copies).select("doc_id")
    per_doc = found.join(poor, found["doc_id"].eqNullSafe(poor["doc_id"]), "left_semi").groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))  # COPIES at most
    small = found.count() <= BROADCAST_ROWS
    per_doc = F.broadcast(per_doc) if small else per_doc
    sets = items.select("item_id", shingles(words(F.col("text")), n).alias("item_set")).where(F.size("item_set") > 0)
    # Shingles repeat each word five times; what is broadcast stays under 100 MB.
    few = (items.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0) <= 16 << 20
    own = docs.select(F.col("doc_id").alias("own_id"), "text").join(per_doc, F.col("own_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "items", words(F.col("text")).alias("w"))
    own = own.select("doc_id", "items", shingles(F.col("w"), n).alias("doc_set"))
    pairs = own.select("doc_id", F.explode("items").alias("item_id"), "doc_set").join(F.broadcast(sets) if few else sets, "item_id")
    shared = F.size(F.array_intersect("item_set", "doc_set"))
    out = pairs.select("doc_id", "item_id", F.size("item_set").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    if not rich.isEmpty():
        out = out.unionByName(_one_by_one(docs, found, rich, sets, n))
    best = out.groupBy("doc_id", "item_id").agg(F.max_by("n_item", F.col("n_shared") / F.col("n_item")).alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold)).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def _one_by_one(docs: DataFrame, found: DataFrame, rich: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The same counts of the rich documents, by a join of shingles: rows are those of the documents and of the candidate items, never their product."""
    # A row is told from others of its id by its text.
    row = docs.join(rich.select(F.col("doc_id").alias("rich_id")), F.col("doc_id").eqNullSafe(F.col("rich_id")), "left_semi")
    row = row.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text").dropDuplicates(["doc_id", "row"])
    asked = found.join(rich.select(F.col("doc_id").alias("rich_id")), F.col("doc_id").eqNullSafe(F.col("rich_id")), "left_semi")
    own = row.select("doc_id", "row", F.explode(shingles(words(F.col("text")), n)).alias("s")).withColumn("key", F.xxhash64("doc_id", "s"))
    theirs = asked.join(sets, "item_id").select(F.col("doc_id").alias("their_id"), "item_id", F.size("item_set").cast("long").alias("n_item"), F.explode("item_set").alias("their_s"))
    theirs = theirs.withColumn("key", F.xxhash64("their_id", "their_s"))
    same = F.col("doc_id").eqNullSafe(F.col("their_id")) & (F.col("s") == F.col("their_s"))
    met = own.join(theirs, "key").where(same).groupBy("doc_id", "row", "item_id").agg(F.max("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    return met.select("doc_id", "item_id", "n_item", "n_shared")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained(docs, items)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Whether a row does follows from its text alone, so the key is a hash of the text: ids
    may be null or repeated, and a clean row stays beside a contaminated one of its id.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), "text")
    bad = written(contained(docs.select(F.md5(F.col("text").cast("binary")).alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__key")).distinct(), "decontam-bad")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.md5(docs["text"].cast("binary")) == bad["__key"], "left_anti").select(*docs.columns)


_SETS = """
SELECT {id} AS id, unnest(CASE WHEN len(w) >= 5
  THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {id}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})
"""
OP4_SQL = f"""
WITH d AS ({_SETS.format(id="doc_id", table="documents")}),
b AS ({_SETS.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, round(n_shared / n_item, 6) AS containment
FROM m JOIN n ON n.id = m.item_id WHERE n_shared >= ceil(n_item * 0.75)
"""
