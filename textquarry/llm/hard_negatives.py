"""Operator 13: hard negatives by product quantisation with stored residual norms.

Vectors become integers, floor(256 x). A quantiser of two levels (LEVELS: components of
a subspace, CENTROIDS each; the second one quantises what the first leaves) is fitted to
a bounded sample; every row is stored with its codes and the norm of what both leave. A
query's lookup tables give the inner product with a row's reconstruction, and by
Cauchy and Schwarz the exact one lies within the query's norm times the residual norm.
So a row whose upper bound is under the k-th best lower bound, or whose bounds miss the
window, can't be in the result; the others are scored exactly in integers. The codebook
decides how many rows are left to score, never what is found.

Queries (anchors) go through the index in blocks of ANCHORS; each task keeps its own best
k of every window, and only these are shuffled.

Defined results: rows with a null label, a null vector, or a null or non-finite component
(256 x counted) take no part; shorter vectors count as ended by zeros; an anchor without
another row of its label, or positives without rows in their window, give no rows; rows
that repeat an id are rows of their own, each an anchor where the id is divisible by 100;
a null id is no anchor and comes last in ties; scores beyond a long stop at its ends; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import scratch_path, written

#: Rows that the codebook is fitted to, about; components of a subspace, by level.
SAMPLE, LEVELS, CENTROIDS, ROUNDS = 8192, (4, 2), 256, 6
#: Anchors that go through the index at once, and that a lookup table holds; rows of a step.
ANCHORS, TABLE, STEP = 4096, 256, 2048
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
_LONG = (1 << 63) - 1


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v as doubles, not yet scaled."""
    v = F.col("embedding").cast("array<double>")
    most = F.lit(float("inf"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < most)), F.lit(False))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return table.where(F.col("label").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), v.alias("v"))


def _ints(column: pa.Array, d: int) -> np.ndarray:
    """floor(256 x) of a column of lists, as doubles (rows, d), ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), d))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
    return out


@dataclass
class Codebook:
    """centroids: for each level and subspace its first component and (CENTROIDS, width) points."""

    d: int
    centroids: list[tuple[int, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 13) -> Codebook:
        rng, left, made = np.random.Generator(np.random.PCG64(seed)), x.copy(), []
        for width in LEVELS:
            level = []
            for at in range(0, x.shape[1], width):
                part = left[:, at : at + width]
                c = part[rng.integers(0, len(part), CENTROIDS)] if len(part) else np.zeros((CENTROIDS, part.shape[1]))
                for _ in range(ROUNDS if len(part) else 0):
                    near = _nearest(part, c)
                    n = np.bincount(near, minlength=CENTROIDS)
                    sums = np.stack([np.bincount(near, weights=part[:, j], minlength=CENTROIDS) for j in range(part.shape[1])], axis=1)
                    c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
                level.append((at, c))
            for at, c in level:
                left[:, at : at + width] -= c[_nearest(left[:, at : at + width], c)]
            made += level
        return cls(x.shape[1], made)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of what they leave, rounded up)."""
        left, codes = x.copy(), np.empty((len(x), len(self.centroids)), dtype=np.uint8)
        for m, (at, c) in enumerate(self.centroids):
            part = left[:, at : at + c.shape[1]]
            codes[:, m] = near = _nearest(part, c)
            part -= c[near]
        return codes, np.linalg.norm(left, axis=1) * (1 + 1e-9) + 1e-12 * (np.linalg.norm(x, axis=1) + self.reach())

    def reach(self) -> float:
        """A bound of the norms of all reconstructions' parts together."""
        return float(sum(np.linalg.norm(c, axis=1).max() for _, c in self.centroids)) if self.centroids else 0.0

    def tables(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(a table (CENTROIDS, queries) for each code, what rounding can add to a sum of theirs)."""
        scale = np.linalg.norm(q, axis=1) * self.reach()
        kind, eps = (np.float32, 1e-5) if scale.max(initial=0) < 1e15 else (np.float64, 1e-12)
        return [(c @ q[:, at : at + c.shape[1]].T).astype(kind) for at, c in self.centroids], eps * scale + 1e-6


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmin(half - x[lo : lo + STEP] @ c.T, axis=1) for lo in range(0, len(x), STEP)]) if len(x) else np.zeros(0, dtype=np.int64)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, as long."""
    if not len(q):
        return np.zeros(0, dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True))
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], dtype=np.int64)


def sample_of(rows: DataFrame, n: int, most: int = SAMPLE) -> DataFrame:
    """About `most` of n rows, by hash; at most twice as many."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("rid", "vec_id"), F.lit(1 << 30)) < F.lit(max(1, (most << 30) // n))).limit(2 * most)


def index(table: DataFrame) -> tuple[DataFrame, Codebook]:
    """(rid, vec_id, label, v, codes, res) of all usable rows, written, and the codebook; rid: gapped numbers in the order of ids."""
    rows = usable(table).withColumn("at", F.monotonically_increasing_id())  # copies of a row can be parted, too
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("at")]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    book = Codebook.fit(_ints(pa.array([r.v for r in sample_of(rows, n).select("v").collect()], pa.list_(pa.float64())), d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ints(batch.column("v"), d)
            codes, res = book.encode(x)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * d, d) if d else np.zeros(len(x) + 1), pa.int32()), pa.array(x.ravel()))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), batch.column("label"), v, packed, pa.array(res)], names=["rid", "vec_id", "label", "v", "codes", "res"])

    return written(rows.mapInArrow(run, "rid long, vec_id long, label long, v array<double>, codes binary, res double"), "negatives-index"), book


class Rows:
    """A batch of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, book: Codebook):
        self.rid, self.label, self.res = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "label", "res"))
        vec = batch.column("vec_id")
        self.absent = vec.is_null().to_numpy(zero_copy_only=False)
        self.vec = vec.fill_null(0).to_numpy(zero_copy_only=False)
        self.x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), book.d)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(len(batch), len(book.centroids))


class Best:
    """The k best (score, least rid) of each key so far."""

    def __init__(self, keys: int, k: int):
        self.k, self.last = k, np.full(keys, -np.inf)  # the k-th best score of a key, where it has k
        self.kept = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.bool_))

    def add(self, *new: np.ndarray) -> None:
        """key, score, rid, vec_id, absent of new rows."""
        if not len(new[0]):
            return
        both = [np.concatenate(x) for x in zip(self.kept, new, strict=True)]
        order = np.lexsort((both[2], np.invert(both[1]), both[0]))  # inverted: larger scores first, whatever their size
        key = both[0][order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        self.kept = tuple(x[order][place < self.k] for x in both)
        full = place == self.k - 1
        self.last[key[full]] = both[1][order][full]

    def batch(self, names: np.ndarray, per: int) -> pa.RecordBatch:
        """Rows (anchor, w, rid, vec_id, score); a key is an anchor's place times per, and w."""
        key, score, rid, vec, absent = self.kept
        cols = [pa.array(names[key // per]), pa.array((key % per).astype(np.int32)), pa.array(rid), pa.array(vec, mask=absent), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "w", "rid", "vec_id", "score"])


_FOUND = "anchor long, w int, rid long, vec_id long, score long"


def _bounds(rows: Rows, at: np.ndarray, tables: list, norm: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (rows, queries) of the inner products."""
    near = np.zeros((len(at), len(norm)), dtype=tables[0].dtype if tables else np.float64)
    for m, t in enumerate(tables):
        near += t[rows.codes[at, m]]
    off = rows.res[at][:, None] * norm + slack
    return near - off, near + off


def _kth(bounds: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; minus infinity where there are fewer."""
    return np.partition(bounds, len(bounds) - k, axis=0)[len(bounds) - k] if len(bounds) >= k else np.full(bounds.shape[1], -np.inf)


def _steps(rows: Rows, chosen: np.ndarray) -> Iterator[np.ndarray]:
    for lo in range(0, len(chosen), STEP):
        yield chosen[lo : lo + STEP]


def nearest_alike(index: DataFrame, book: Codebook, anchors: dict, k: int) -> DataFrame:
    """Each task's k best other rows of each anchor's label, w 0."""
    sent = index.sparkSession.sparkContext.broadcast((book, anchors))  # ANCHORS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, a = sent.value
        best = Best(len(a["rid"]), k)
        for batch in batches:
            rows = Rows(batch, book)
            for label in np.intersect1d(rows.label, a["label"]):
                own = np.flatnonzero(a["label"] == label)
                for lo in range(0, len(own), TABLE):
                    q = own[lo : lo + TABLE]
                    tables, slack = book.tables(a["v"][q])
                    norm = np.linalg.norm(a["v"][q], axis=1)
                    for at in _steps(rows, np.flatnonzero(rows.label == label)):
                        low, up = _bounds(rows, at, tables, norm, slack)
                        itself = rows.rid[at][:, None] == a["rid"][q]
                        low[itself] = up[itself] = -np.inf
                        i, j = np.nonzero((up >= np.maximum(best.last[q], _kth(low, k))) & ~itself)
                        best.add(q[j], exact(a["v"][q[j]], rows.x[at[i]]), rows.rid[at[i]], rows.vec[at[i]], rows.absent[at[i]])
        yield best.batch(a["rid"], 1)

    return index.mapInArrow(run, _FOUND)


def windows_filled(index: DataFrame, book: Codebook, anchors: dict, lo: np.ndarray, hi: np.ndarray, k: int) -> DataFrame:
    """Each task's k best rows of other labels with a score from lo to hi; lo, hi (anchors, windows), lo > hi for none."""
    sent = index.sparkSession.sparkContext.broadcast((book, anchors, lo, hi))
    per = lo.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, a, lo, hi = sent.value
        best = Best(lo.size, k)
        used = np.flatnonzero((lo <= hi).any(axis=1))
        for batch in batches:
            rows = Rows(batch, book)
            for start in range(0, len(used), TABLE):
                q = used[start : start + TABLE]
                tables, slack = book.tables(a["v"][q])
                norm = np.linalg.norm(a["v"][q], axis=1)
                keys = q[:, None] * per + np.arange(per)
                for at in _steps(rows, np.arange(len(rows.rid))):
                    low, up = _bounds(rows, at, tables, norm, slack)
                    other = rows.label[at][:, None] != a["label"][q]
                    need, most = np.full(len(q), np.inf), np.full(len(q), -np.inf)
                    for w in range(per):
                        least, open_ = best.last[keys[:, w]], lo[q, w] <= hi[q, w]
                        if np.isneginf(least[open_]).any():  # nothing known yet: what surely lies in the window tells
                            sure = other & (low >= lo[q, w]) & (up <= hi[q, w])
                            least = np.maximum(least, _kth(np.where(sure, low, -np.inf), k))
                        need = np.where(open_, np.minimum(need, np.maximum(lo[q, w], least)), need)
                        most = np.where(open_, np.maximum(most, hi[q, w]), most)
                    i, j = np.nonzero(other & (up >= need) & (low <= most))
                    score = exact(a["v"][q[j]], rows.x[at[i]])
                    for w in range(per):
                        fits = (score >= lo[q[j], w]) & (score <= hi[q[j], w]) & (score >= best.last[keys[j, w]])
                        best.add(keys[j[fits], w], score[fits], *(x[at[i[fits]]] for x in (rows.rid, rows.vec, rows.absent)))
        yield best.batch(a["rid"], per)

    return index.mapInArrow(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks, with rank from 1."""
    w = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of every anchor of a table (vec_id, embedding, label): the best rows of other
    labels that score from low to high percent of each of the anchor's positives."""
    spark = table.sparkSession
    rows, book = index(table)
    asked = rows.where("vec_id % 100 = 0")
    blocks = max(1, -(-asked.count() // ANCHORS))
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], _MINED).write.parquet(path)
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "vec_id", "label", "v").collect()
        if not got:
            continue
        a = {"rid": np.array([r.rid for r in got]), "label": np.array([r.label for r in got]), "v": np.array([r.v for r in got], dtype=np.float64).reshape(len(got), book.d)}
        place = {r.rid: i for i, r in enumerate(got)}
        alike = _top(nearest_alike(rows, book, a, positives), positives).collect()  # positives an anchor, at most
        lo, hi = np.ones((len(got), positives), dtype=np.int64), np.zeros((len(got), positives), dtype=np.int64)
        pairs = []
        for r in alike:
            lo[place[r.anchor], r.rank - 1], hi[place[r.anchor], r.rank - 1] = -(-low * r.score // 100), high * r.score // 100
            pairs.append((r.anchor, r.rank - 1, got[place[r.anchor]].vec_id, r.vec_id, r.score))
        told = spark.createDataFrame(pairs, "anchor long, w int, anchor_id long, positive_id long, positive_score long")
        out = _top(windows_filled(rows, book, a, lo, hi, negatives), negatives).join(F.broadcast(told), ["anchor", "w"])
        names = [c.split()[0] for c in _MINED.split(", ")]
        out.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).select(*names).write.mode("append").parquet(path)
    return spark.read.schema(_MINED).parquet(path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
