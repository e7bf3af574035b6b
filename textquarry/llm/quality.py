"""Operator 6: regularised quadratic discriminant over document statistics.

Statistics of every whole text are transformed towards normal shapes. Each class has
a mean and a covariance, shrunk towards the pooled one and that towards its mean
variance; the classes' sums and products are taken over all labelled rows that may
be learnt from, distributed, and only their totals reach the driver. A score is the
posterior from the difference of log densities: half squared Mahalanobis distances,
by Cholesky factors that are computed once and sent to the workers.

Defined results: null and empty texts have the statistics of no words; without
labelled rows of both classes every score is 0; rows that repeat are scored alike,
and count once for learning; an empty table gives an empty result; a null doc_id is
not held out and has no label; texts of any length are taken whole, step by step; other
columns of the documents are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, held_out, small_batches, written

#: Weight of the pooled covariance in each class's, and of its mean variance in that.
POOLED, RIDGE = 0.3, 0.02
THRESHOLD = 0.3
#: Characters of a text that are taken at once.
STEP = 1_000_000
_CLASSES = {"upper": 1, "lower": 2, "digit": 3, "space": 4, "stop": 5, "bang": 6, "bar": 7, "mark": 8}
NAMES = [
    "words", "word_length", "word_spread", "upper", "digit", "stop", "bang", "bar", "mark", "distinct",
    "top_word", "repeat_next", "repeat_pair", "repeat_line", "line_words", "short_words", "marked_words", "line_ends",
]
_table: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Character class of each code below 0x3000 (others count as lower case letters)."""
    if not _table:
        t = np.full(0x3000, 2, dtype=np.uint8)
        for c in range(0x3000):
            x = chr(c)
            if x.isspace() or c < 32:
                t[c] = 4
            elif x.isupper():
                t[c] = 1
            elif x.isdigit():
                t[c] = 3
            elif x in ".,;:?'\"()-":
                t[c] = 5
            elif x == "!":
                t[c] = 6
            elif x == "|":
                t[c] = 7
            elif not x.isalpha():
                t[c] = 8
        _table.append(t)
    return _table[0]


_SPACE = re.compile(r"\s")


def _pieces(text: str, step: int) -> Iterator[str]:
    """A text in pieces of about step characters that end before white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + step) if at + step < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def statistics(text: str | None, step: int = STEP) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES.

    Words are taken step by step; of a text's words only numbers and the distinct ones stay.
    """
    text = text or ""
    kinds, number, runs = np.zeros(9), {}, [np.zeros(0, dtype=np.int64)]
    n = total = square = short = marked = 0
    for piece in _pieces(text, step):
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds += np.bincount(_kinds()[np.minimum(codes, 0x2FFF)], minlength=9)
        words = piece.split()
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n, total, square = n + len(words), total + int(lengths.sum()), square + int((lengths * lengths).sum())
        short += int((lengths <= 3).sum())
        marked += sum(1 for w in words if w[-1] in "!%$&*#|" or w[0] in "!%$&*#|<{[")
        runs.append(np.fromiter((number.setdefault(w.lower(), len(number)) for w in words), dtype=np.int64, count=len(words)))
    ids = np.concatenate(runs)
    chars = max(1, len(text) - int(kinds[4]))
    share = [kinds[_CLASSES[k]] / chars for k in ("upper", "digit", "stop", "bang", "bar", "mark")]
    lines = [x for x in text.split("\n") if x.strip()]
    d, n_pairs = max(1, n), max(1, n - 1)
    mean = total / d
    pairs = len(np.unique(ids[:-1] * len(number) + ids[1:])) if n > 1 else 1
    logit = lambda x: float(np.log((x + 0.002) / (1.002 - x)))
    return [
        float(np.log1p(n)),
        float(np.log1p(mean)),
        float(np.log1p(max(0.0, square / d - mean * mean) ** 0.5)),
        *map(logit, share),
        float(np.log1p(len(number)) / np.log1p(n)) if n else 1.0,
        logit(int(np.bincount(ids).max()) / d if n else 0.0),
        logit(int((ids[1:] == ids[:-1]).sum()) / d),
        logit(1 - pairs / n_pairs),
        logit(1 - len(set(lines)) / len(lines) if lines else 0.0),
        float(np.log1p(n / max(1, len(lines)))),
        logit(short / d),
        logit(marked / d),
        logit(sum(1 for x in lines if x.rstrip()[-1] in ".?!:\"'") / max(1, len(lines))),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every row."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(count, sum, sum of products) of x by y, over all rows (y, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array(batch.column("y").to_pylist())
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(len(y), -1)
            x = np.concatenate((np.ones((len(y), 1)), x), axis=1)
            for k in (0, 1):
                own = x[y == k]
                if len(own):
                    total[k] = total.get(k, 0) + own.T @ own
        for k, m in total.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())], names=["y", "cell", "v"])

    cells = rows.mapInArrow(run, "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v")).collect()  # 2 * 19 * 19 rows
    d = len(NAMES) + 1
    out = {}
    for y in {r.y for r in cells}:
        m = np.zeros(d * d)
        for r in cells:
            if r.y == y:
                m[r.cell] = r.v
        m = m.reshape(d, d)
        out[y] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(sums: dict, pooled: float = POOLED, ridge: float = RIDGE) -> dict | None:
    """Means, inverse Cholesky factors, log determinants and log priors of both classes."""
    if set(sums) != {0, 1}:
        return None
    n = {y: s[0] for y, s in sums.items()}
    mean = {y: s[1] / n[y] for y, s in sums.items()}
    scatter = {y: s[2] - n[y] * np.outer(mean[y], mean[y]) for y, s in sums.items()}
    whole = (scatter[0] + scatter[1]) / max(1.0, n[0] + n[1] - 2)
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-6))
    whole = whole / np.outer(scale, scale)
    model = {"scale": scale}
    for y in (0, 1):
        own = scatter[y] / max(1.0, n[y] - 1) / np.outer(scale, scale)
        weight = pooled + (1 - pooled) * len(NAMES) / (len(NAMES) + n[y])  # few rows lean on both classes
        cov = (1 - weight) * own + weight * whole
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        root = np.linalg.cholesky(cov)
        model[y] = (mean[y] / scale, np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(), np.log(n[y] / (n[0] + n[1])))
    return model


def posterior(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1 for rows of statistics."""
    x, density = x / model["scale"], []
    for y in (0, 1):
        mean, root, logdet, prior = model[y]
        z = (x - mean) @ root.T
        density.append(prior - 0.5 * (logdet + (z * z).sum(axis=1)))
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(len(batch), -1)
            s = posterior(model, x) if model is not None and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(s, 9))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = written(described(docs), "quality-statistics")  # 18 numbers a text
    known = rows.where(~held_out(F.col("doc_id"))).join(labels, "doc_id").dropDuplicates(["doc_id", "x"]).select("y", "x")
    out = score(rows, fit(moments(known)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
