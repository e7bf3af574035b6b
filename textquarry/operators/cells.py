"""Dense retrieval by cells: rows lie with their nearest centre, and a query reads near cells alone.

Centres come from k-means over a bounded sample (SAMPLE rows, by hash); every row is
assigned. A cell is a part of a :class:`Store`, so cells that no query is near to are not
read. Asked for a number of cells, the search is approximate, and :meth:`Cells.tuned`
measures how many a wanted recall takes; asked to be exact, it reads beyond the near cells
those that a row as far from its centre as the cell's farthest one could be good enough in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.sparse import _ARROW, top_k
from textquarry.sources.parts import Staged, Store
from textquarry.sources.scratch import written

#: Rows that centres are fitted to, about; rounds; queries that are searched, and that recall is measured with, at once.
SAMPLE, ROUNDS, BLOCK, PROBE = 20_000, 8, 4096, 256
#: Cosines compare at nine decimals.
_NEAR = 1e-8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Unit vectors of about `most` of n rows (doc_id, vector), by the hash of their ids; at most twice as many."""
    part = rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(max(1, (most << 30) // n))).limit(2 * most)
    got = part.select("vector").collect()
    return _unit(np.array([r.vector for r in got], dtype=np.float64)) if got else np.zeros((0, 0))


def fitted(x: np.ndarray, n_cells: int, seed: int = 16) -> np.ndarray:
    """Unit centres of unit vectors, by k-means on the sphere."""
    rng = np.random.Generator(np.random.PCG64(seed))
    if not len(x):
        return x
    c = x[rng.permutation(len(x))[:n_cells]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (doc_id, vector, ...) that have a vector, with cell and near, the cosine with its centre."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # bounded by the sample
    own = rows.where("vector is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            cell, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
            for lo in range(0, len(x), 4096):
                dots = x[lo : lo + 4096] @ sent.value.T
                cell[lo : lo + 4096] = dots.argmax(axis=1)
                near[lo : lo + 4096] = dots.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{schema}, cell int, near double")


@dataclass
class Cells:
    """Stored cells: a store's table `name` by cell, and centres, farthest rows and measured cells a recall takes."""

    store: Store
    centres: np.ndarray
    farthest: np.ndarray
    takes: dict[str, int]
    name: str = "vectors"

    @classmethod
    def build(cls, rows: DataFrame, root: str, n_cells: int | None = None, sample: int = SAMPLE, recalls: tuple[float, ...] = (0.9, 0.95, 0.99), k: int = 5) -> Cells:
        """Cells of rows (doc_id, vector) under root; by default as many as the root of their number."""
        spark = rows.sparkSession
        store, staged, info, _ = laid(Store.open(spark, root), rows, n_cells, sample)
        out = cls.of(store.commit({"vectors": staged}, info=info))
        out.takes = out.tuned(recalls, k)
        out.store = out.store.commit({}, info={"takes": out.takes})
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Cells:
        return cls.of(Store.open(spark, root))

    @classmethod
    def of(cls, store: Store) -> Cells:
        i = store.info
        return cls(store, np.array(i["centres"], dtype=np.float64).reshape(-1, i["dims"]), np.array(i["farthest"]), i.get("takes", {}))

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, recall: float | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) by cosine over queries (query_id, vector).

        probes: nearest cells that are read; recall: as many as a measured recall took; neither: exact.
        A zero vector has cosine 0 with all; null vectors take no part.
        """
        exact = probes is None and recall is None
        if recall is not None:
            probes = next((self.takes[r] for r in sorted(self.takes, key=float) if float(r) >= recall), len(self.centres))
        probes = min(len(self.centres), probes or max(1, len(self.centres) // 8))
        spark, asked = queries.sparkSession, queries.where("vector is not null").select("query_id", "vector")
        blocks = max(1, -(-asked.count() // BLOCK))
        out = None
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            got = part.collect()  # about BLOCK vectors
            if not got or not len(self.centres):
                continue
            q, names = _unit(np.array([r.vector for r in got], dtype=np.float64).reshape(len(got), -1)), [r.query_id for r in got]
            near = q @ self.centres.T
            wanted = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(wanted, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            hit = self._read(q, names, wanted, k)
            if exact:
                hit = written(top_k(hit, k).drop("rank"), "cells")
                kth = {r.query_id: r.s for r in hit.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}
                least = np.array([kth.get(n, -2.0) for n in names])
                # The angle to a row is at least that to the centre less that of the farthest row.
                angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(self.farthest, -1, 1)) - 1e-7
                more = ~wanted & (np.cos(np.maximum(angle, 0)) >= least[:, None] - _NEAR)
                if more.any():
                    hit = hit.unionAll(self._read(q, names, more, k))
            if blocks > 1:
                hit = written(top_k(hit, k).drop("rank"), "cells")
            out = hit if out is None else out.unionAll(hit)
        if out is None:
            out = self.store.read(self.name).limit(0).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", F.lit(0.0).alias("score"))
        return top_k(out, k)

    def _read(self, q: np.ndarray, names: list, wanted: np.ndarray, k: int) -> DataFrame:
        """The k best of each batch's cells for the queries that want them; only wanted cells are read."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        rows = self.store.read(self.name, cells).select("doc_id", "vector", "cell")
        kind = rows.schema["doc_id"].dataType.simpleString()
        qkind = "string" if isinstance(names[0], str) else "bigint"
        sent = rows.sparkSession.sparkContext.broadcast((q, np.array(names), wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, names, wanted = sent.value
            for batch in batches:
                x, cell = _matrix(batch.column("vector")), batch.column("cell").to_numpy(zero_copy_only=False)
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    at, who = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                    at = at[np.argsort(doc[at], kind="stable")]  # ties by id as in the end
                    score = np.round(q[who] @ x[at].T, 12)
                    m = min(k, len(at))
                    best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :m]
                    cols = [pa.array(np.repeat(names[who], m), _ARROW[qkind]), pa.array(doc[at[best.ravel()]], _ARROW[kind]), pa.array(np.take_along_axis(score, best, axis=1).ravel())]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "doc_id", "score"])

        return rows.mapInArrow(run, f"query_id {qkind}, doc_id {kind}, score double")

    def tuned(self, recalls: tuple[float, ...], k: int = 5, n: int = PROBE) -> dict[str, int]:
        """How many cells a recall takes: n rows, by hash, are asked for their exact k nearest, whose cells are ranked by nearness."""
        rows = self.store.read(self.name)
        total = rows.count()
        part = rows if total <= n else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.lit(max(1, (n << 30) // total))).limit(2 * n)
        asked = written(part.select(F.col("doc_id").alias("query_id"), "vector"), "probes")
        got = self.search(asked, k + 1).where("query_id <> doc_id").join(rows.select("doc_id", "cell"), "doc_id").select("query_id", "cell").collect()
        place = {r.query_id: np.argsort(np.argsort(-(_unit(np.array([r.vector], dtype=np.float64)) @ self.centres.T)[0], kind="stable")) for r in asked.collect()}
        ranks = np.sort([int(place[r.query_id][r.cell]) + 1 for r in got])
        return {str(r): int(ranks[min(len(ranks) - 1, int(np.ceil(r * len(ranks))))]) if len(ranks) else 1 for r in recalls}


def laid(store: Store, rows: DataFrame, n_cells: int | None = None, sample: int = SAMPLE) -> tuple[Store, Staged, dict, DataFrame]:
    """(store, staged cells, what the manifest says of them, the rows with their cells) of rows (doc_id, vector, ...)."""
    rows = written(rows.where("vector is not null"), "cell-rows")
    n = rows.count()
    x = sampled(rows, n, sample)
    centres = fitted(x, n_cells or max(1, min(len(x) // 8, round(n**0.5))))
    placed = written(assigned(rows, centres), "cell-placed")
    info = {"centres": centres.ravel().tolist(), "dims": max(1, centres.shape[1]), "farthest": farthest(placed, len(centres)).tolist()}
    return store, store.stage("vectors", placed, "cell"), info, placed


def farthest(placed: DataFrame, n_cells: int) -> np.ndarray:
    """The least cosine with the centre, by cell; 2 (nothing is there) for empty ones."""
    out = np.full(n_cells, 2.0)
    for r in placed.groupBy("cell").agg(F.min("near").alias("near")).collect():  # a row a cell
        out[r.cell] = r.near
    return out
