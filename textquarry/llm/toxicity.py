"""Operator 9: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed embedding of the word beside the scaled sum of
hashed embeddings of its character grams of 3 to 6 (bounds marked). A text is read in
overlapping windows of WINDOW words, each STRIDE on, all of them scored; a text's
score is its highest window's. Training sees windows of labelled texts: of a toxic
text the window that scores highest so far, of a clean one its highest and a random
one. Each known word's gate inputs are cached by the worker.

Trained words lose their own embedding in half of the batches, and the parameters are
averaged over the second half of the epochs, so that grams carry what they can.

Learnt from at most SAMPLE rows of each class (those of least hash), only of rows
whose crc32(doc_id as text) mod 5 is not 0; everything else covers all texts.

Defined results: null and empty texts have one window without words, scored by the
bias alone; without labelled rows of both classes every score is 0; rows that repeat
are scored alike; an empty table gives an empty result; a null doc_id is not held out
and has no label; texts of any length are scored whole, in all their windows; other
columns are ignored, and kept by :func:`stage`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, held_out, small_batches

WINDOW, STRIDE = 64, 48
#: Labelled rows of each class that are fitted.
SAMPLE = 1200
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 16
#: Lengths of character grams, bounds counted.
GRAMS = (3, 4, 5, 6)
D_WORD, D_CHAR, H, ATT = 8, 12, 8, 8
EPOCHS, BATCH, RATE, LEAST_BATCHES = 6, 64, 0.01, 400
#: Random windows of a clean text in an epoch; times that a toxic one is seen at most.
CLEAN, MOST_AGAIN = 3, 2
#: Share of words whose own embedding is left out of a batch.
DROPPED = 0.5
#: Embeddings learn by this times the rate.
FASTER = np.float32(5)
#: Words that a worker remembers before it starts anew; words of a step.
KNOWN, STEP = 50_000, 150_000
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\~`^+="
_U = np.uint64


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, gram rows of all words, gram count of each word)."""
    marked = ["\x02" + (w.strip(_EDGE) or w) + "\x03" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters of the word from here on
    place = np.arange(len(codes)) - starts[own]
    with np.errstate(over="ignore"):
        powers = _mix(place.astype(np.uint64) + _U(17)) | _U(1)
        row = _mix(np.add.reduceat(codes * powers, starts)) % _U(WORD_ROWS)
        padded = np.concatenate((codes, np.zeros(GRAMS[-1] - 1, dtype=np.uint64)))
        grams, owner, g = [], [], np.zeros(len(codes), dtype=np.uint64)
        for k in range(GRAMS[-1]):
            g = g * _U(0x9E3779B97F4A7C15) + padded[k : k + len(codes)] * _U(0xC2B2AE3D27D4EB4F) + _U(k)
            if k + 1 in GRAMS:
                whole = left > k
                grams.append(_mix(g[whole]) % _U(GRAM_ROWS))
                owner.append(own[whole])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return row.astype(np.int64), grams[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def _features_in_parts(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features of many words, in little memory."""
    parts = [word_features(words[lo : lo + step]) for lo in range(0, len(words), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int32) for p in parts]), np.concatenate([p[2] for p in parts])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int = 9) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    d = D_WORD + D_CHAR
    # Embeddings begin at zero: what training hasn't seen says nothing.
    p = {"word": np.zeros((WORD_ROWS, D_WORD)), "gram": np.zeros((GRAM_ROWS, D_CHAR))}
    for k in "fb":
        p |= {f"W{k}": rng.normal(0, d**-0.5, (d, 3 * H)), f"U{k}": rng.normal(0, H**-0.5, (H, 3 * H)), f"c{k}": np.zeros(3 * H)}
    p |= {"A": rng.normal(0, (2 * H) ** -0.5, (2 * H, ATT)), "a": np.zeros(ATT), "v": rng.normal(0, ATT**-0.5, ATT), "o": rng.normal(0, (2 * H) ** -0.5, 2 * H), "bias": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def inputs(p: dict, words: list[str]) -> np.ndarray:
    """Input vectors of distinct words."""
    row, grams, n = word_features(words)
    out = np.empty((len(words), D_WORD + D_CHAR), dtype=np.float32)
    out[:, :D_WORD] = p["word"][row]
    sums = np.add.reduceat(p["gram"][grams], np.cumsum(n) - n, axis=0)  # every word has a gram
    out[:, D_WORD:] = sums / np.sqrt(n)[:, None]
    return out


def _gru(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: bool):
    """States (T, B, H) for gate inputs (T, B, 3H); keep: also what the gradient needs."""
    T, B, _ = gates.shape
    h, out, kept = np.zeros((B, H), dtype=np.float32), np.empty((T, B, H), dtype=np.float32), []
    for t in range(T - 1, -1, -1) if back else range(T):
        g, u = gates[t], h @ U
        s = g[:, : 2 * H] + u[:, : 2 * H]
        s = 1 / (1 + np.exp(-s))
        z, r = s[:, :H], s[:, H:]
        n = np.tanh(g[:, 2 * H :] + r * u[:, 2 * H :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            kept.append((t, h, z, r, n, u[:, 2 * H :], m))
        out[t] = h = new
    return out, kept


def forward(p: dict, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows (T, B) by attention over both directions' states."""
    hf, kf = _gru(gf, mask, p["Uf"], False, keep)
    hb, kb = _gru(gb, mask, p["Ub"], True, keep)
    states = np.concatenate((hf, hb), axis=2)
    e = np.tanh(states @ p["A"] + p["a"])
    w = e @ p["v"]
    w = np.where(mask > 0, w, -1e9)
    w = np.exp(w - w.max(axis=0)) * mask
    w = w / np.maximum(w.sum(axis=0), 1e-9)
    pooled = (states * w[:, :, None]).sum(axis=0)
    logit = pooled @ p["o"] + p["bias"][0]
    return logit, (states, e, w, pooled, kf, kb)


def _gru_back(dout: np.ndarray, kept: list, U: np.ndarray):
    """Gradients: of gate inputs, of U."""
    T, B, _ = dout.shape
    dg, dU, carry = np.zeros((T, B, 3 * H), dtype=np.float32), np.zeros_like(U), np.zeros((B, H), dtype=np.float32)
    for t, h, z, r, n, un, m in reversed(kept):
        dh = dout[t] + carry
        dn = dh * m * (1 - z) * (1 - n * n)
        dz = -dh * m * (n - h) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate((dz, dr, dn * r), axis=1)
        dg[t] = np.concatenate((dz, dr, dn), axis=1)
        dU += h.T @ du
        carry = dh * (1 - m * (1 - z)) + du @ U.T
    return dg, dU


def gradients(p: dict, X: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """(of parameters but embeddings, of the distinct words' inputs X, loss)."""
    gf, gb = (X @ p["Wf"] + p["cf"])[ids], (X @ p["Wb"] + p["cb"])[ids]
    logit, (states, e, w, pooled, kf, kb) = forward(p, gf, gb, mask, True)
    prob = _sigmoid(logit)
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    d = ((prob - y) / len(y)).astype(np.float32)
    out = {"o": pooled.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
    dpool = d[:, None] * p["o"]
    dstates = w[:, :, None] * dpool
    dw = (states * dpool).sum(axis=2)
    dw = w * (dw - (w * dw).sum(axis=0))
    de = dw[:, :, None] * p["v"] * (1 - e * e)
    out["v"] = (e * dw[:, :, None]).sum(axis=(0, 1))
    out["A"] = states.reshape(-1, 2 * H).T @ de.reshape(-1, ATT)
    out["a"] = de.sum(axis=(0, 1))
    dstates = dstates + de @ p["A"].T
    dX = np.zeros_like(X)
    for k, part, kept in (("f", dstates[:, :, :H], kf), ("b", dstates[:, :, H:], kb)):
        dg, out[f"U{k}"] = _gru_back(part, kept, p[f"U{k}"])
        flat, at = dg.reshape(-1, 3 * H), ids.reshape(-1)
        sums = _summed(at, flat, len(X))
        out[f"W{k}"], out[f"c{k}"] = X.T @ sums, sums.sum(axis=0)
        dX += sums @ p[f"W{k}"].T
    return out, dX, loss


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, dense."""
    return np.stack([np.bincount(at, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


def _by_row(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices, sums of rows)."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0).astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window of texts of so many words; a text has one at least."""
    n = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first, np.minimum(WINDOW, counts[text] - first)


def _laid(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask), each (T, B): words of windows that start at places of flat."""
    T = max(1, int(n.max(initial=1)))
    at = start[None, :] + np.arange(T)[:, None]
    mask = np.arange(T)[:, None] < n[None, :]
    ids = flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else np.zeros_like(at)
    return np.where(mask, ids, 0), mask.astype(np.float32)


class Scorer:
    """Scores texts; the gate inputs of known words are kept."""

    def __init__(self, p: dict):
        self.p, self.seen = p, {}
        self._clear()

    def _clear(self) -> None:
        self.seen = {"": 0}
        self.size, self.gf, self.gb = 1, np.zeros((1024, 3 * H), dtype=np.float32), np.zeros((1024, 3 * H), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        need = self.size + len(words)
        if need > len(self.gf):
            for k in ("gf", "gb"):
                more = np.zeros((max(need, 2 * len(self.gf)), 3 * H), dtype=np.float32)
                more[: self.size] = getattr(self, k)[: self.size]
                setattr(self, k, more)
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            X = inputs(self.p, part)
            self.gf[self.size : self.size + len(part)] = X @ self.p["Wf"] + self.p["cf"]
            self.gb[self.size : self.size + len(part)] = X @ self.p["Wb"] + self.p["cb"]
            self.seen.update(zip(part, range(self.size, self.size + len(part)), strict=True))
            self.size += len(part)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        if self.size > KNOWN:
            self._clear()
        split = [(t or "").lower().split() for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        fresh_words = set().union(*split) - self.seen.keys()
        self._learn(sorted(fresh_words))
        get = self.seen.__getitem__
        flat = np.concatenate([np.fromiter(map(get, s), dtype=np.int64, count=len(s)) for s in split]) if len(split) else np.zeros(0, dtype=np.int64)
        text, first, n = windows(counts)
        start = (np.cumsum(counts) - counts)[text] + first
        out = np.empty(len(text), dtype=np.float32)
        by = np.argsort(n, kind="stable")  # windows alike in length go together
        for lo in range(0, len(by), 1024):
            w = by[lo : lo + 1024]
            ids, mask = _laid(flat, start[w], n[w])
            out[w] = forward(self.p, self.gf[ids], self.gb[ids], mask)[0]
        return text, out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, logit = self.logits(texts)
        best = np.full(len(texts), -np.inf, dtype=np.float32)
        np.maximum.at(best, text, logit)
        return _sigmoid(best)


def train(texts: list[str | None], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> dict[str, np.ndarray]:
    """Parameters fitted to whole texts and their labels (0, 1), by Adam."""
    p, rng = fresh(seed), np.random.Generator(np.random.PCG64(seed + 1))
    toxic = np.asarray(toxic)
    split = [(t or "").lower().split() for t in texts]
    vocabulary = sorted(set().union(*split)) or [""]
    number = {w: i for i, w in enumerate(vocabulary)}
    flat = np.concatenate([np.fromiter(map(number.__getitem__, s), dtype=np.int32, count=len(s)) for s in split] or [np.zeros(0, dtype=np.int32)])
    counts = np.array([len(s) for s in split], dtype=np.int64)
    del split, number
    row, grams, n_grams = _features_in_parts(vocabulary)
    gram_at = np.cumsum(n_grams) - n_grams
    text, first, n = windows(counts)
    start = (np.cumsum(counts) - counts)[text] + first
    mean: dict[str, np.ndarray] = {}
    m1, m2, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    steps = max(epochs, -(-LEAST_BATCHES * BATCH // (4 * max(1, len(texts)))))  # a small sample is seen more often
    for epoch in range(steps):
        if epoch:
            scorer = Scorer(p)  # forgets words as it goes, as when scoring
            logit = np.concatenate([scorer.logits(texts[lo : lo + 200])[1] for lo in range(0, len(texts), 200)])
        else:
            logit = rng.random(len(text))
        order = np.lexsort((-logit, text))
        top = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
        clean = rng.permutation(np.flatnonzero(toxic[text] == 0))[: CLEAN * int(np.sum(toxic == 0))]
        bad = top[toxic[text[top]] == 1]
        again = max(1, round(len(clean) / (2 * max(1, len(bad)))))  # of the few toxic windows each is seen more often
        chosen = rng.permutation(np.concatenate((top[toxic[text[top]] == 0], clean, np.repeat(bad, min(again, MOST_AGAIN)))))
        for lo in range(0, len(chosen), BATCH):
            w = chosen[lo : lo + BATCH]
            ids, mask = _laid(flat, start[w], n[w])
            used, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            k = n_grams[used]
            g = grams[np.repeat(gram_at[used] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            X = np.empty((len(used), D_WORD + D_CHAR), dtype=np.float32)
            X[:, :D_WORD] = p["word"][row[used]]
            k_root = np.sqrt(k)[:, None]
            X[:, D_WORD:] = np.add.reduceat(p["gram"][g], np.cumsum(k) - k, axis=0) / k_root
            # Words are left out by halves, so that what grams can tell isn't learnt by heart.
            whole = np.where(rng.random((len(used), 1)) < DROPPED, 0, 1 / (1 - DROPPED)).astype(np.float32)
            X[:, :D_WORD] *= whole
            grad, dX, _ = gradients(p, X, inverse, mask, toxic[text[w]].astype(np.float32))
            step += 1
            scale = np.float32(RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step))
            for key, at, d in [(key, slice(None), d) for key, d in grad.items()] + [
                ("word", *_by_row(row[used], dX[:, :D_WORD] * whole)),
                ("gram", *_by_row(g, np.repeat(dX[:, D_WORD:] / k_root, k, axis=0))),
            ]:  # of the embeddings only the rows in use move
                a = m1[key][at] * np.float32(0.9) + np.float32(0.1) * d
                b = m2[key][at] * np.float32(0.999) + np.float32(0.001) * d * d
                m1[key][at], m2[key][at] = a, b
                p[key][at] -= (scale * FASTER if key in ("word", "gram") else scale) * a / (np.sqrt(b) + np.float32(1e-8))
        if epoch >= steps // 2:
            mean = {k: x.astype(np.float64) / (steps - steps // 2) + (mean[k] if mean else 0) for k, x in p.items()}
    p = {k: x.astype(np.float32) for k, x in mean.items()}
    # The bias moves so that 0.5 parts the fitted texts best.
    best = np.concatenate([np.log((s := Scorer(p).scores(texts[lo : lo + 200]).astype(np.float64)) + 1e-12) - np.log(1 - s + 1e-12) for lo in range(0, len(texts), 200)])
    order = np.argsort(best)
    right = np.concatenate(([np.sum(toxic == 1)], np.sum(toxic == 1) + np.cumsum(np.where(toxic[order] == 0, 1, -1))))
    at = np.flatnonzero(right == right.max())
    at = int(at[len(at) // 2])
    if 0 < at < len(best):
        p["bias"] = p["bias"] - np.float32((best[order[at - 1]] + best[order[at]]) / 2)
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> list:
    """Up to sample rows of each class of those that may be learnt from, texts whole."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    return sorted(rows.collect(), key=lambda r: r.doc_id)


def score(docs: DataFrame, p: dict | None) -> DataFrame:
    """doc_id, score, n_windows of every row."""
    small_batches(docs.sparkSession)
    p = docs.sparkSession.sparkContext.broadcast(p)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p.value) if p.value is not None else None

        def made(ids: list, texts: list) -> pa.RecordBatch:
            s = scorer.scores(texts).astype(np.float64) if scorer else np.zeros(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s)], names=["doc_id", "score"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "") // 6
                if size >= STEP:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)
        del scorer
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    rows = labelled_sample(docs, labels, "toxic")
    texts, y = [r.text for r in rows], np.array([r.y for r in rows], dtype=np.int64)
    del rows
    p = train(texts, y) if len(set(y.tolist())) == 2 else None
    give_back()
    return p


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fitted(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    small_batches(spark)
    p = spark.sparkContext.broadcast(fitted(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p.value) if p.value is not None else None
        for batch in batches:
            at, size = 0, 0
            for i, t in enumerate(texts := batch.column("text").to_pylist()):
                size += len(t or "") // 6
                if size >= STEP or i == len(texts) - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield part.filter(pa.array(scorer.scores(texts[at : i + 1]) < 0.5)) if scorer else part
                    at, size = i + 1, 0
        del scorer
        give_back()

    return docs.mapInArrow(keep, docs.schema)
