"""Sparse retrieval: counts within a row, inverted shards with impact-ordered lists, exact top-k that skips what can't win.

A shard holds the lists of some thousand texts, a list the texts of a term by falling
weight; its first weight bounds what the term can give in the shard, and its k-th weight is
what k texts reach at least. A query leaves out a shard whose bounds together don't reach
its k-th best score so far, and within one all texts that only minor terms hold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.sources.scratch import small, written

# The usual BM25 constants with a constant mean length.
K1, B, MEAN_LENGTH = 1.2, 0.75, 256.0
#: Texts of a shard, about; pairs of a query and a term that are on the driver at a time, but for a query's own.
SHARD, PAIRS = 4096, 1_000_000
#: So many queries that have the same frequent terms in a shard are answered as one; a term that fewer texts than one in RARE hold is rare; list entries of rare terms that are looked at at once.
MANY, RARE, ENTRIES = 8, 256, 1 << 21
#: Groups of queries whose scores of a shard's texts are held at once.
GROUPS = 256
#: Distinct terms that are sent to all tasks; beyond this a join picks them.
SENT_TERMS = 200_000
#: Scores compare at nine decimals: what lies this near may still win a tie.
_NEAR = 1e-8
_LISTS = "bucket int, sub long, term string, docs array<int>, weights array<double>, ids array<{}>"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


def term_counts(docs: DataFrame, key: str = "doc_id", stop: Sequence[str] = (), stem: Callable[[str], str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(key, dl, terms, counts): each row of docs (key, texto) with its distinct terms, counted within the row.

    stop: terms that are left out; stem: what each remaining one becomes; dl: number of a text's
    terms after that; only: terms that are of interest, others count in dl alone. A null text has no terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frozenset(stop), None if only is None else frozenset(only)))
    return words(docs, key).mapInArrow(lambda batches: counted(batches, sent.value, stem), f"`{key}` {docs.schema[key].dataType.simpleString()}, dl int, terms array<string>, counts array<bigint>")


def words(docs: DataFrame, *kept: str) -> DataFrame:
    """What :func:`counted` takes: the kept columns of docs, and of texto the text itself where it is Latin-1, else its tokens with spaces between (lists take longer to send)."""
    wide = F.col("texto").rlike(r"[^\x00-\xff]")
    return docs.select(*kept, F.when(~wide, F.col("texto")).alias("t"), F.when(wide, F.array_join(tokens(F.col("texto")), " ")).alias("w"))


def counted(batches: Iterator[pa.RecordBatch], chosen: tuple = ((), None), stem: Callable[[str], str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of :func:`words` with dl, terms and counts in the place of their last two columns; chosen: stop and only of :func:`term_counts`."""
    left_out, wanted = chosen
    for batch in batches:
        n = len(batch)
        found, row = _latin_tokens(batch.column("t"))
        if batch.column("w").null_count < n:
            w = pc.split_pattern(pc.fill_null(batch.column("w"), ""), " ")
            own, at = w.flatten(), np.repeat(np.arange(n), pc.list_value_length(w).to_numpy(zero_copy_only=False))
            some = pc.not_equal(own, "")
            found, row = pa.concat_arrays([found, own.filter(some)]), np.concatenate((row, at[some.to_numpy(zero_copy_only=False)]))
        d = found.dictionary_encode()
        codes, words = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        if left_out or stem:
            known: dict[str, int] = {}
            to = np.array([-1 if w in left_out else known.setdefault(stem(w) if stem else w, len(known)) for w in words.to_pylist()], dtype=np.int64)
            codes, words = to[codes] if len(codes) else codes, pa.array(list(known), pa.string())
            codes, row = codes[codes >= 0], row[codes >= 0]
        dl = np.bincount(row, minlength=n).astype(np.int32)
        if wanted is not None and len(codes):
            keep = np.fromiter((w in wanted for w in words.to_pylist()), dtype=bool, count=len(words))[codes]
            codes, row = codes[keep], row[keep]
        pair, tf = np.unique(row * max(1, len(words)) + codes, return_counts=True)
        owner, code = np.divmod(pair, max(1, len(words)))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32())
        terms = pa.ListArray.from_arrays(ends, words.take(pa.array(code)).cast(pa.string()))
        kept = [batch.schema.names.index(c) for c in batch.schema.names if c not in ("t", "w")]
        names = [batch.schema.names[i] for i in kept]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(dl), terms, pa.ListArray.from_arrays(ends, pa.array(tf))], names=[*names, "dl", "terms", "counts"])


def _latin() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, whether a letter or digit) by code point up to 255; as places of UTF-8, a lead byte's second bytes have their code point."""
    lower, mine = np.arange(256), np.zeros(256, dtype=bool)
    for c in range(256):
        mine[c] = unicodedata.category(chr(c))[0] in "LN"
        lower[c] = ord(chr(c).lower())
    return lower.astype(np.uint8), mine


def _latin_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, the row of each) of Latin-1 texts, as :func:`tokens` has them; all bytes of a batch are looked at together."""
    lower, mine = _LATIN
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(bounds[-1] - bounds[0]) if len(bounds) else 0
    if not size:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low, own = lower[raw & 0x7F], mine[raw & 0x7F] & (raw < 0x80)
    lead = np.flatnonzero(raw >= 0xC0)  # of two bytes: up to U+00FF
    point = ((raw[lead] & 0x03) << 6) | (raw[lead + 1] & 0x3F)
    own[lead] = own[lead + 1] = mine[point]
    small_ = lower[point]
    low[lead], low[lead + 1] = 0xC0 | small_ >> 6, 0x80 | small_ & 0x3F
    before, after = np.append(False, own[:-1]), np.append(own[1:], False)
    before[bounds[:-1][bounds[:-1] < size]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[own])).cast(pa.string())
    return found, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))


_LATIN = _latin()


def weight(tf, dl, k1: float = K1, b: float = B, mean: float = MEAN_LENGTH):
    """A term's weight in a text; for columns and arrays alike."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def postings(docs: DataFrame, k1: float = K1, b: float = B, mean: float = MEAN_LENGTH, **words) -> DataFrame:
    """(doc_id, term, tf, weight) of docs (doc_id, texto); words: stop and stem of :func:`term_counts`."""
    own = term_counts(docs, **words).select("doc_id", "dl", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    own = own.select("doc_id", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"), "dl")
    return own.select("doc_id", "term", "tf", weight(F.col("tf"), F.col("dl"), k1, b, mean).alias("weight"))


def idf(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, n, idf) of postings over n_docs documents."""
    per = post.groupBy("term").agg(F.count("*").alias("n"))
    return per.withColumn("idf", _idf(F.col("n"), F.lit(float(n_docs))))


def _idf(n: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - n + 0.5) / (n + 0.5))


def query_terms(queries: DataFrame, **words) -> DataFrame:
    """(query_id, term): distinct terms of queries (query_id, query)."""
    own = term_counts(queries.select("query_id", F.col("query").alias("texto")), "query_id", **words)
    return own.select("query_id", F.explode("terms").alias("term")).distinct()


def shards(counts: DataFrame, n: int, k1: float = K1, b: float = B, mean: float = MEAN_LENGTH) -> DataFrame:
    """(bucket, sub, term, docs, weights, ids) of counted texts (doc_id, dl, terms, counts, bucket), n shards in each bucket.

    A row with term null has the shard's ids in order; docs are places among them. Both lists
    of a term are by falling weight.
    """
    kind = counts.schema["doc_id"].dataType.simpleString()
    rows = counts.select(F.col("bucket").cast("int").alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long").alias("sub"), "doc_id", "dl", "terms", "counts")
    return rows.groupBy("bucket", "sub").applyInArrow(_builder(k1, b, mean), _LISTS.format(kind))


def shards_in_place(counts: DataFrame, size: int, k1: float = K1, b: float = B, mean: float = MEAN_LENGTH) -> DataFrame:
    """The same, of texts that lie by bucket: each task cuts what it has of a bucket into shards of `size` texts, so nothing is shuffled."""
    kind = counts.schema["doc_id"].dataType.simpleString()
    counts = counts.select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "dl", "terms", "counts")
    return counts.mapInArrow(_in_place(size, k1, b, mean), _LISTS.format(kind))


def shards_of_texts(texts: DataFrame, size: int, k1: float = K1, b: float = B, mean: float = MEAN_LENGTH) -> DataFrame:
    """The same of texts (doc_id, texto, bucket), which are counted by the task that cuts them."""
    kind, cut = texts.schema["doc_id"].dataType.simpleString(), _in_place(size, k1, b, mean)
    return words(texts, "bucket", "doc_id").mapInArrow(lambda batches: cut(counted(batches)), _LISTS.format(kind))


def _in_place(size: int, k1: float, b: float, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    build = _builder(k1, b, mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = TaskContext.get().partitionId() << 32  # no two tasks give a shard the same number

        def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal sub
            table = pa.Table.from_batches(held)
            yield from build(table.append_column("sub", pa.array(np.full(len(table), sub)))).combine_chunks().to_batches()
            sub += 1

        held, n, at = [], 0, None
        for batch in batches:
            of = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and of[lo] != at:
                    yield from shard(held)
                    held, n = [], 0
                at = of[lo]
                while lo < hi:
                    part = batch.slice(lo, min(hi - lo, size - n))
                    held.append(part)
                    lo, n = lo + len(part), n + len(part)
                    if n == size:
                        yield from shard(held)
                        held, n = [], 0
        if held:
            yield from shard(held)

    return run


def _builder(k1: float, b: float, mean: float) -> Callable[[pa.Table], pa.Table]:
    """Makes a shard's lists of its counted texts."""

    def build(table: pa.Table) -> pa.Table:
        ids = pc.array_sort_indices(table.column("doc_id").combine_chunks())
        table = table.take(ids)
        col = lambda c: table.column(c).combine_chunks()
        lengths = pc.list_value_length(col("terms")).to_numpy(zero_copy_only=False)
        d = col("terms").flatten().dictionary_encode()
        code, row = d.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)
        w = weight(col("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(col("dl").to_numpy(zero_copy_only=False), lengths).astype(np.float64), k1, b, mean)
        order = np.lexsort((row, -w, code))
        ends = np.concatenate(([0, 0], np.cumsum(np.bincount(code, minlength=len(d.dictionary))))) if len(code) else np.array([0, 0])
        m = len(ends) - 1
        at = lambda c, t: pa.array([table.column(c)[0].as_py()] * m, t)
        all_ids = pa.ListArray.from_arrays(pa.array([0] + [len(lengths)] * m, pa.int32()), col("doc_id"))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (row[order].astype(np.int32), w[order])]
        terms = pa.concat_arrays([pa.nulls(1, pa.string()), d.dictionary.cast(pa.string()) if len(code) else pa.array([], pa.string())])
        return pa.table([at("bucket", pa.int32()), at("sub", pa.int64()), terms, *lists, all_ids], names=["bucket", "sub", "term", "docs", "weights", "ids"])

    return build


def top_k(scored: DataFrame, k: int, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best of each query with rank from 1; ties by id. Scores compare at nine decimals."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(at: np.ndarray, gain: np.ndarray, need: float, k: int, ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(list entries that it read, scores, places) of a shard's k best texts for the terms whose lists are `at`."""
    none = np.array([]), np.array([], dtype=np.int64)
    bound = gain * weights[ends[at]]
    order = np.argsort(-bound, kind="stable")
    at, gain = at[order], gain[order]
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # what a term and those after it can give together
    if rest[0] < need:
        return 0, *none
    major = int(np.searchsorted(-rest, -need, side="right"))  # a text without any of these can't reach it
    score, read, lo, hi, step = np.zeros(n), 0, 0, max(1, major), 1
    while lo < len(at):  # the terms that can give most first, then more and more of the minor ones
        part = at[lo:hi]
        m = ends[part + 1] - ends[part]
        where = np.repeat(ends[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        score += np.bincount(docs[where], weights=weights[where] * np.repeat(gain[lo:hi], m), minlength=n)
        read += int(m.sum())
        if not (score + rest[min(hi, len(at))] >= max(need, _NEAR)).any():
            return read, *none
        lo, hi, step = hi, hi + step, step * 2
    score = np.round(score, 12)
    hit = np.flatnonzero((score > 0) & (score >= need))
    shown = np.round(score[hit], 9)
    if len(hit) > k:
        hit = hit[shown >= np.partition(shown, len(hit) - k)[len(hit) - k]]
    hit = hit[np.argsort(-np.round(score[hit], 9), kind="stable")[:k]]  # places are in the order of ids, which decides ties
    return read, score[hit], hit


class _Query:
    """A query's terms, its best k so far and the score that others must reach."""

    def __init__(self, name, terms: list[tuple[str, float]], least: float, k: int):
        self.name, self.terms, self.k, self.need, self.best = name, terms, k, least - _NEAR, []

    def search(self, place: dict[str, int], ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, ids: pa.Array) -> int:
        """Takes in one shard; the number of list entries that it read."""
        own = [(place[t], i) for t, i in self.terms if t in place]
        if not own:
            return 0
        read, score, hit = _scored(np.array([a for a, _ in own]), np.array([i for _, i in own]), self.need, self.k, ends, docs, weights, len(ids))
        self.take(score.tolist(), ids.take(pa.array(hit)).to_pylist())
        return read

    def take(self, score: list[float], ids: list) -> None:
        if not score:
            return
        self.best = sorted([*self.best, *zip(score, ids, strict=True)], key=lambda x: (-round(x[0], 9), x[1]))[: self.k]
        if len(self.best) == self.k:
            self.need = max(self.need, self.best[-1][0] - _NEAR)


class _Asked:
    """A block of queries in a task: all of them are held against a shard at once.

    Queries that have the same frequent terms in a shard have the same scores there but for the
    texts that hold a rare term of theirs. MANY or more of these are answered as one, under the
    frequent terms: a text's whole score is no less than that, so the k best texts by these terms
    and the query's few texts with a rare one are all that it can need of the shard.
    """

    def __init__(self, names: list, terms: pa.Array, codes: np.ndarray, gain: np.ndarray, starts: np.ndarray, least: np.ndarray, k: int, rare: np.ndarray | None = None):
        self.place, self.codes, self.gain, self.starts, self.k = {t: i for i, t in enumerate(terms.to_pylist())}, codes, gain, starts, k
        self.ends = np.append(starts[1:], len(codes))
        self.need = least - _NEAR
        marks = np.random.default_rng(0).integers(0, 1 << 62, (2, len(terms)), dtype=np.int64).astype(np.uint64)
        self.marks = marks[0][codes], marks[1][codes]
        rare = np.zeros(len(terms), dtype=bool) if rare is None else rare
        self.rare, self.frequent = rare[codes], tuple(np.where(rare[codes], np.uint64(0), m) for m in self.marks)
        self.owner = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.first, self.row = np.zeros(len(terms)), np.zeros(len(terms), dtype=np.int64)
        self.names, self.alone, self.groups, self.members = names, {}, {}, {}
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size, self.most = 0, max(4 * k * len(starts), 1 << 19)

    def shard(self, terms: list[str], ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, ids: pa.Array) -> None:
        known = np.array([self.place.get(t, -1) for t in terms], dtype=np.int64)
        has = np.flatnonzero(known >= 0)
        if not len(has):
            return
        self.first[known[has]], self.row[known[has]] = weights[ends[has]], has
        first = self.first[self.codes]
        bound = np.add.reduceat(self.gain * first, self.starts)
        live = np.flatnonzero((bound > 0) & (bound >= self.need))
        args = ends, docs, weights, ids
        if len(live):
            many, left = [], []
            for who in self._alike(live, first, self.frequent):
                (many if len(who) >= MANY else left).append(who)
            for lo in range(0, len(many), GROUPS):
                self._common(many[lo : lo + GROUPS], first, *args)
            if left:
                self._each(np.concatenate(left), first, *args)
        self.first[known[has]] = 0.0

    def _alike(self, live: np.ndarray, first: np.ndarray, marks: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """live queries, parted by which of the marked terms they have in the shard."""
        one, two = (np.add.reduceat(np.where(first > 0, m, np.uint64(0)), self.starts)[live] for m in marks)
        order = np.lexsort((live, two, one))
        live, one, two = live[order], one[order], two[order]
        edges = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        return np.split(live, edges[1:])

    def _each(self, live: np.ndarray, first: np.ndarray, ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, ids: pa.Array) -> None:
        """Queries that have few like them, by all their terms."""
        for who in self._alike(live, first, self.marks):
            span = slice(self.starts[who[0]], self.ends[who[0]])
            own = first[span] > 0
            _, score, hit = _scored(self.row[self.codes[span][own]], self.gain[span][own], float(self.need[who].min()), self.k, ends, docs, weights, len(ids))
            if len(hit):
                score, found = score.tolist(), ids.take(pa.array(hit)).to_pylist()
                for w in who.tolist():
                    q = self.alone.setdefault(w, None) or _Query(w, [], self.need[w] + _NEAR, self.k)
                    q.take(score, found)
                    self.alone[w], self.need[w] = q, max(self.need[w], q.need)

    def _common(self, many: list[np.ndarray], first: np.ndarray, ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, ids: pa.Array) -> None:
        """Groups of queries by their frequent terms, then what rare terms add."""
        n, group = len(ids), np.full(len(self.starts), -1)
        base = np.zeros((len(many), n))
        for i, who in enumerate(many):
            group[who] = i
            span = slice(self.starts[who[0]], self.ends[who[0]])
            own = (first[span] > 0) & ~self.rare[span]
            code = self.codes[span][own]
            for at, gain in zip(self.row[code].tolist(), self.gain[span][own].tolist(), strict=True):
                lo, hi = ends[at], ends[at + 1]
                base[i, docs[lo:hi]] += gain * weights[lo:hi]  # a list has a text once
            key = np.sort(code).astype(np.int32).tobytes()
            g = self.groups.get(key) or _Query(key, [], 0.0, self.k)
            score = np.round(base[i], 12)
            need = max(float(self.need[who].min()), g.need)
            hit = np.flatnonzero((score > 0) & (score >= need))
            if len(hit):
                shown = np.round(score[hit], 9)
                if len(hit) > self.k:
                    full = shown >= np.partition(shown, len(hit) - self.k)[len(hit) - self.k]
                    hit, shown = hit[full], shown[full]
                hit = hit[np.argsort(-shown, kind="stable")[: self.k]]  # places are in the order of ids
                g.take(score[hit].tolist(), ids.take(pa.array(hit)).to_pylist())
            if not g.best:
                continue
            self.groups[key] = g
            seen = self.members.setdefault(key, [])
            seen.append(who)
            if len(seen) > 32:
                self.members[key] = [np.unique(np.concatenate(seen))]
            if len(g.best) == self.k:
                self.need[who] = np.maximum(self.need[who], g.need)
        pairs = np.flatnonzero(self.rare & (first > 0) & (group[self.owner] >= 0))
        if not len(pairs):
            return
        at = self.row[self.codes[pairs]]
        m = ends[at + 1] - ends[at]
        # A query's pairs lie together, and stay together in a step.
        cuts = np.flatnonzero(np.diff(np.cumsum(m) // ENTRIES) > 0) + 1
        cuts = np.unique(np.searchsorted(self.owner[pairs], self.owner[pairs[cuts]]))
        for own in np.split(np.arange(len(pairs)), cuts[cuts > 0]):
            mine = m[own]
            where = np.repeat(ends[at[own]] - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())
            place, back = np.unique(np.repeat(self.owner[pairs[own]], mine) * n + docs[where], return_inverse=True)
            query, text = np.divmod(place, n)
            score = np.round(base[group[query], text] + np.bincount(back, weights=weights[where] * np.repeat(self.gain[pairs[own]], mine)), 12)
            fine = score >= self.need[query]
            if fine.any():
                self.held.append((query[fine], score[fine], ids.take(pa.array(text[fine]))))
                self.size += int(fine.sum())
        if self.size > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Leaves k texts of each query among those that hold a rare term, ties by id."""
        if not self.held:
            return None
        query, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        t = pa.table([query, score, -np.round(score, 9), pa.chunked_array([h[2] for h in self.held]).combine_chunks()], names=["q", "score", "by", "id"])
        t = t.sort_by([("q", "ascending"), ("by", "ascending"), ("id", "ascending")])
        q = t["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = np.flatnonzero(place == self.k - 1)
        self.need[q[last]] = np.maximum(self.need[q[last]], -t["by"].to_numpy()[last] - _NEAR)
        t = t.filter(pa.array(place < self.k)).combine_chunks()
        ids = t["id"].combine_chunks()
        self.held, self.size = [(t["q"].to_numpy(), t["score"].to_numpy(), ids)], len(t)
        self.most = max(self.most, 2 * len(t))
        return self.held[0]

    def rows(self) -> Iterator[tuple]:
        """Columns (query, terms, text, score): of a query, of terms, or of a query that has the terms, then without a text."""
        for w, q in self.alone.items():
            yield [self.names[w]] * len(q.best), [None] * len(q.best), [d for _, d in q.best], [s for s, _ in q.best]
        if (held := self.settle()) is not None:
            query, score, ids = held
            yield [self.names[w] for w in query.tolist()], [None] * len(query), ids, score
        for key, g in self.groups.items():
            yield [None] * len(g.best), [key] * len(g.best), [d for _, d in g.best], [s for s, _ in g.best]
            who = np.unique(np.concatenate(self.members[key])).tolist()
            yield [self.names[w] for w in who], [key] * len(who), [None] * len(who), [None] * len(who)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows of lists, a shard at a time."""
    held, at = [], None
    for batch in batches:
        if not len(batch):
            continue
        both = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "sub")])
        edges = [0, *(np.flatnonzero((both[:, 1:] != both[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = tuple(both[:, lo].tolist())
            if held and here != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            at = here
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def search(lists: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank) from shards (of :func:`shards`); each distinct term of a query (query_id, term) weighs 1.

    Lists of asked terms are brought together by shard once, as sorted rows; blocks of queries go
    through them a shard at a time, and a task's k best of a query, or of the terms that many
    queries have in common, are all that is shuffled.
    """
    spark, kind, qkind = lists.sparkSession, lists.schema["ids"].dataType.elementType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    own = lists.where("term is not null").join(small(asked.select("term").distinct()), "term", "left_semi").select("bucket", "sub", "term", "docs", "weights", "ids")
    heads = lists.where("term is null").select("bucket", "sub", "term", "docs", "weights", "ids")
    n_docs = heads.agg(F.sum(F.size("ids"))).first()[0] or 0
    per = own.groupBy("term").agg(F.sum(F.size("docs")).alias("n"), F.max(F.get("weights", F.lit(k - 1))).alias("kth"))
    per = per.withColumn("idf", _idf(F.col("n"), F.lit(float(n_docs))))
    rare = F.col("n") * RARE < F.lit(n_docs)
    pairs = written(asked.join(per, "term").select("query_id", "term", "idf", F.coalesce(F.col("idf") * F.col("kth"), F.lit(0.0)).alias("least"), rare.alias("rare")), "asked")
    blocks = max(1, -(-pairs.count() // PAIRS))
    whole = own.unionByName(heads).repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "term")
    if blocks > 1:
        whole = whole.persist(StorageLevel.DISK_ONLY)  # partitions stay as they are dealt: a shard is in one
    out = None
    for b in range(blocks):
        got = (pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else pairs).toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")])
        if not len(got):
            continue
        d, q = got["term"].combine_chunks().dictionary_encode(), got["query_id"].combine_chunks().dictionary_encode()
        starts = np.flatnonzero(np.append(True, np.diff(q.indices.to_numpy(zero_copy_only=False)) != 0))
        least = np.maximum.reduceat(got["least"].to_numpy(), starts)
        codes, few_ = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(d.dictionary), dtype=bool)
        few_[codes] = got["rare"].to_numpy(zero_copy_only=False)
        sent = spark.sparkContext.broadcast((q.dictionary.to_pylist(), d.dictionary, codes, got["idf"].to_numpy(), starts, least, few_))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            all_ = _Asked(*sent.value[:-1], k, sent.value[-1])
            for t in _by_shard(batches):
                col = lambda c, t=t: t.column(c).combine_chunks()
                head = pc.is_null(col("term")).to_numpy(zero_copy_only=False)
                if head.all() or not head.any():
                    continue
                ids, lists = col("ids").take(pa.array(np.flatnonzero(head)[:1])).flatten(), t.filter(pa.array(~head))
                docs, weights = lists.column("docs").combine_chunks(), lists.column("weights").combine_chunks()
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64))))
                all_.shard(lists.column("term").to_pylist(), ends, docs.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False), ids)
            schema = pa.schema(list(zip(("query_id", "terms", "doc_id", "score"), (_ARROW[qkind], pa.binary(), _ARROW[kind], pa.float64()), strict=True)))
            parts = [pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema) for cols in all_.rows()]
            yield from pa.concat_tables([schema.empty_table(), *parts]).combine_chunks().to_batches(max_chunksize=65_536)

        found = written(whole.mapInArrow(run, f"query_id {qkind}, terms binary, doc_id {kind}, score double"), "sparse")
        sent.destroy()
        group = top_k(found.where("query_id is null").select("terms", "doc_id", "score"), k, by="terms").drop("rank")
        shared_ = found.where("doc_id is null").select("query_id", "terms").distinct().join(group, "terms").select("query_id", "doc_id", "score")
        hit = found.where("terms is null").select("query_id", "doc_id", "score").unionAll(shared_)
        # Under terms of other shards a text may have less than all that it has of the query.
        hit = hit.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        hit = written(top_k(hit, k).drop("rank"), "sparse") if blocks > 1 else hit
        out = hit if out is None else out.unionAll(hit)
    if blocks > 1:
        whole.unpersist()
    if out is None:
        out = asked.limit(0).crossJoin(lists.limit(0)).select("query_id", F.get("ids", F.lit(0)).alias("doc_id"), F.lit(0.0).alias("score"))
    return top_k(out, k)


def few(terms: DataFrame, most: int = SENT_TERMS) -> list[str] | None:
    """Distinct terms (term), if they are few enough to be sent to all tasks."""
    got = terms.limit(most + 1).collect()
    return [r.term for r in got] if len(got) <= most else None


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The same from texts (doc_id, texto) and queries (query_id, query) without an index: only terms that some query has get lists."""
    spark = docs.sparkSession
    asked = written(query_terms(queries), "query-terms")
    n = max(-(-docs.count() // SHARD), spark.sparkContext.defaultParallelism)
    counts = term_counts(docs, only=few(asked.select("term").distinct()))
    return search(written(shards(counts.withColumn("bucket", F.lit(0)), n), "shards"), asked, k)
