"""Retrieval: sparse and dense top-k for whole batches of queries, fusion, and the citation graph.

Queries are a table. The sparse side is in :mod:`sparse`; the dense side multiplies blocks
of query vectors with Arrow batches of rows and keeps a task's best k before anything is
shuffled, or reads near cells alone (:mod:`cells`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.operators.sparse import _ARROW, B, K1, bm25_topk, counted, idf, postings, query_terms, term_counts, top_k, words  # noqa: F401
from textquarry.sources.scratch import small, written

# The fusion constant, what is fetched before fusion, and the most that is added by citations.
RRF_K0, PREFETCH, MOST_EXPANDED = 2, 50, 3
#: Distinct query vectors that are multiplied at once; scores that a task holds at once.
QUERY_BLOCK, SCORES = 8192, 1 << 21
#: Scores compare at nine decimals: what lies this near may still win a tie.
_NEAR = 1e-8


class _Best:
    """The k best rows of each of n queries so far, and the score that others must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.need, self.held, self.size = k, np.full(n, -np.inf), [], 0
        self.most = max(4 * n * k, 1 << 19)

    def take(self, score: np.ndarray, ids: pa.Array, at: np.ndarray, copies: np.ndarray) -> None:
        """score: of queries and vectors; a vector's ids, at most k, are `copies` from `at` on."""
        hit = score >= (self.need - _NEAR)[:, None]
        m = score.shape[1]
        if m > self.k and np.count_nonzero(hit) > 4 * self.k * len(score):
            self.need = np.maximum(self.need, np.partition(score, m - self.k, axis=1)[:, m - self.k] - _NEAR)
            hit = score >= (self.need - _NEAR)[:, None]
        query, col = np.nonzero(hit)
        if not len(query):
            return
        s = np.round(score[query, col], 12)
        shown = np.round(s, 9)
        order = np.lexsort((-shown, query))
        query, col, s, shown = query[order], col[order], s[order], shown[order]
        n = copies[col]
        better = np.cumsum(n) - n
        fresh = np.append(True, query[1:] != query[:-1])
        level = fresh | np.append(True, shown[1:] != shown[:-1])
        start = np.maximum.accumulate(np.where(level, np.arange(len(query)), 0))
        better = better[start] - np.maximum.accumulate(np.where(fresh, better, 0))
        keep = better < self.k  # fewer than k rows of the query are better than these
        query, col, s, n = query[keep], col[keep], s[keep], n[keep]
        where = np.repeat(at[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.held.append(pa.table([pa.array(np.repeat(query, n)), pa.array(np.repeat(s, n)), ids.take(pa.array(where))], names=["q", "score", "id"]))
        self.size += len(where)
        if self.size > self.most:
            self.settle()

    def settle(self) -> pa.Table | None:
        """Leaves k rows of each query, ties by id."""
        if not self.held:
            return None
        t = pa.concat_tables(self.held)
        t = t.append_column("by", pa.array(-np.round(t["score"].to_numpy(), 9))).sort_by([("q", "ascending"), ("by", "ascending"), ("id", "ascending")])
        q = t["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = np.flatnonzero(place == self.k - 1)
        self.need[q[last]] = np.maximum(self.need[q[last]], -t["by"].to_numpy()[last])
        t = t.filter(pa.array(place < self.k)).select(["q", "score", "id"]).combine_chunks()
        self.held, self.size = [t], len(t)
        self.most = max(self.most, 2 * len(t))
        return t


def dense_topk(rows: DataFrame, queries: DataFrame, k: int = 5, alike: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine; rows (doc_id, vector), queries (query_id, vector).

    Null vectors take no part; a zero vector has cosine 0 with all. Queries of one vector are
    asked once. alike: many rows are expected to share their vectors; these are brought together,
    and of a vector its k first ids alone are scored, as all others come after them.
    """
    spark = rows.sparkSession
    kind, qkind = rows.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    own = queries.where("vector is not null").select("query_id", "vector")
    asked = written(own.groupBy("vector").agg(F.min("query_id").alias("one")), "asked-vectors")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = rows.where("vector is not null").select("doc_id", "vector")
    if alike:
        rows = rows.withColumn("h", F.xxhash64("vector")).repartition("h").sortWithinPartitions("h", "doc_id").select("doc_id", "vector")
    out = None
    for b in range(blocks):
        # One block of queries at a time is on the driver and in the workers, about QUERY_BLOCK vectors.
        got = asked.where(F.pmod(F.xxhash64("one"), F.lit(blocks)) == b).collect()
        if not got:
            continue
        q = np.array([r.vector for r in got], dtype=np.float64).reshape(len(got), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((q, [r.one for r in got]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, names = sent.value
            best, width = _Best(len(q), k), max(1, SCORES // len(q))
            for batch in batches:
                vectors, ids = batch.column("vector"), batch.column("doc_id")
                if not len(vectors):
                    continue
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
                at = np.arange(len(x))
                if alike:  # of neighbours that are the same the first, in order of ids
                    at = at[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
                copies = np.minimum(np.diff(np.append(at, len(x))), k)
                for lo in range(0, len(at), width):
                    part = at[lo : lo + width]
                    y = x[part]
                    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                    score, odd = q @ y.T, np.isnan(y).any(axis=1)
                    if odd.any():
                        score[:, odd] = np.inf  # as in SQL, what is no number comes first
                    best.take(score, ids, part, copies[lo : lo + width])
            t = best.settle()
            if t is not None:
                named = pa.array(names, _ARROW.get(qkind)).take(t["q"].combine_chunks())
                score = pc.if_else(pc.is_inf(t["score"]), float("nan"), t["score"])
                yield from pa.table([named, t["id"], score], names=["one", "doc_id", "score"]).to_batches(max_chunksize=65_536)

        hit = rows.mapInArrow(run, f"one {qkind}, doc_id {kind}, score double")
        hit = written(top_k(hit, k, by="one"), "dense")
        sent.destroy()
        out = hit if out is None else out.unionAll(hit)
    if out is None:
        return rows.limit(0).crossJoin(queries.limit(0)).select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    # A vector's hits are those of all queries that have it.
    who = own.join(asked, "vector").select("query_id", "one")
    return who.join(out, "one").select("query_id", "doc_id", "score", "rank")


def rrf(rankings: list[DataFrame], k: int = 5, k0: int = RRF_K0) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank from 1)."""
    rows = None
    for r in rankings:
        part = r.select("query_id", "doc_id", (1.0 / (k0 + F.col("rank") - 1)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), k)


def hash_embedding(docs: DataFrame, dims: int = 64) -> DataFrame:
    """Offline stand-in for a model: (doc_id, vector) of docs (doc_id, texto) by signed hashing of terms, of length 1; within the row.

    A text without terms has no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in counted(batches):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            terms, n = batch.column("terms"), len(batch)
            d = terms.flatten().dictionary_encode()
            hashes = [hashlib.md5(t.encode()).hexdigest() for t in d.dictionary.to_pylist()]
            cell = np.array([int(h[:8], 16) % dims for h in hashes], dtype=np.int64)
            sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in hashes])
            code = d.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            x = np.bincount(row * dims + cell[code], weights=sign[code] * tf, minlength=n * dims).reshape(n, dims) if n else np.zeros((0, dims))
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
            ends = pa.array(np.arange(0, (n + 1) * dims, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "vector"])

    return words(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector array<double>")


class Embedder(Protocol):
    """Anything that turns texts into vectors; made anew in each worker."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def embedded(docs: DataFrame, make: Callable[[], Embedder] | None = None, batch: int = 64) -> DataFrame:
    """(doc_id, vector) of docs (doc_id, texto), of length 1, by a model in Python workers; without one by hashing."""
    if make is None:
        return hash_embedding(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                x = np.array(model([t or "" for t in part.column("texto").to_pylist()]), dtype=np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "vector"])

    return docs.select("doc_id", "texto").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector array<double>")


def number_index(docs: DataFrame) -> DataFrame:
    """(numero, target): the first document, by doc_id, of each number."""
    return docs.where("numero <> ''").groupBy("numero").agg(F.min("doc_id").alias("target"))


def citation_edges(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, numero) of docs (doc_id, citacoes)."""
    return docs.select("doc_id", F.posexplode("citacoes").alias("pos", "numero"))


def expand(hits: DataFrame, edges: DataFrame, index: DataFrame, most: int = MOST_EXPANDED) -> DataFrame:
    """Documents cited by a query's hits, in order of rank and citation, not among the hits, up to most.

    hits (query_id, rank, doc_id); returns (query_id, i, target).
    """
    cited = written(edges.join(small(hits.select("query_id", "rank", "doc_id")), "doc_id"), "cited")
    found = index.join(small(cited), "numero").select("query_id", "rank", "pos", "target")
    new = found.join(hits.select("query_id", F.col("doc_id").alias("target")), ["query_id", "target"], "left_anti")
    first = new.groupBy("query_id", "target").agg(F.min(F.struct("rank", "pos")).alias("at"))
    i = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return first.withColumn("i", i).where(F.col("i") <= most).select("query_id", "i", "target")


def with_expansion(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits with their expansion appended: score 0 and method grafo_expansao after the last rank."""
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    tail = extra.join(last, "query_id").select("query_id", F.col("target").alias("doc_id"), F.lit(0.0).alias("score"), (F.col("last") + F.col("i")).alias("rank"), F.lit("grafo_expansao").alias("method"))
    return hits.select("query_id", "doc_id", "score", "rank", F.lit("vetor").alias("method")).unionByName(tail)


def first_segment(segs: DataFrame) -> DataFrame:
    """One segment a document: that of the least point id."""
    return segs.groupBy("doc_id").agg(F.min_by("chunk_id", "point_id").alias("chunk_id"))


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops): nodes one or two undirected hops from the seeds (node)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    one = both.join(seeds.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
    two = both.join(one.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
    rows = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).unionByName(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    return rows.groupBy("node").agg(F.min("hops").alias("hops"))


def visible(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """nodes (node, ...) with hidden: false for the chosen ones (node), and for all where none is chosen."""
    marked = nodes.join(small(chosen.select("node", F.lit(True).alias("shown")).distinct()), "node", "left")
    none = chosen.isEmpty()
    return marked.withColumn("hidden", F.lit(False) if none else F.col("shown").isNull()).drop("shown")


def nodes_by_property(nodes: DataFrame, column: str, values: list) -> DataFrame:
    return nodes.where(F.col(column).isin(values)).select("node")


def endpoints_by_property(edges: DataFrame, column: str, values: list) -> DataFrame:
    """Both ends of the edges that have one of the values."""
    kept = edges.where(F.col(column).isin(values))
    return kept.select(F.col("a").alias("node")).unionByName(kept.select(F.col("b").alias("node"))).distinct()
