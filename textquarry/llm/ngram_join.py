"""Operator 3: n-gram Jaccard self-join, giving groups of linked documents.

Sets are distinct 5-word shingles (64-bit hashes). The steps:

1. Sieve. In hash order, two sets with Jaccard >= t share at least l hashes within
   their first n - ceil(t n) + l; a document whose prefix has fewer than l hashes that
   any other prefix has takes no part in what follows. Prefixes travel packed by hash
   range; what repeats within a pack is credited there, so a hash that a third of all
   documents hold travels once a pack, and a range is met piece by piece, of which only
   distinct hashes are kept.
2. Equal sets are one class, represented by its least node.
3. Rare-first order. Each remaining shingle's key is the power of two below its document
   frequency, then 58 bits of its hash; frequency-1 shingles, which can't be shared, stand
   first and only count. The prefix of n - ceil(t n) + 1 keys is what a set is probed with;
   of the smaller set of a pair the first n - ceil(2t/(1+t) n) + 1 keys are indexed.
4. Stars. In each key's list, by length band, all sets are paired with the least one;
   distinct pairs pass length, positional and suffix filters and are verified.
5. Rest. Lists that still hold several components are joined across components only,
   smaller indexed sets with larger probing ones of their band or the next, so that a
   group of thousands of near copies never becomes all its pairs; new pairs pass the
   same filters and are verified once. No link between components is lost: every linked
   pair shares such a key, and within a component none is needed. Candidates are sets of
   different components whose rarest seventh (the smaller one's) and rarest quarter
   meet at a place that leaves room for the similarity.

A node is a row: its doc_id where ids are neither repeated nor null nor negative, else a
number that the rows get in a table written for it.

Defined results: a null, empty or wordless text has an empty set, no links and
itself as component; a null doc_id keeps its size, links as others do and has the least
doc_id of its component, null if there is none; rows that repeat a doc_id are documents
of their own; texts of any length are taken whole, in steps; an empty table gives an
empty result; other columns are ignored here and kept by :func:`stage`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, small_batches, unbound, written
from textquarry.llm.components import components

N = 5
#: Similarity as a fraction of whole numbers: 75 / 100.
NUM, DEN = 75, 100
#: Words of a step within a batch, and known words of a worker (a cache, nothing else).
STEP, KNOWN = 300_000, 100_000
#: Bytes of a text whose words are at hand at once.
TEXT_STEP = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Prefix hashes of a pack; of a bucket (a range of hashes), about; and of a piece of it that is met at once.
PACK, BUCKET, PIECE = 1_000_000, 400_000, 200_000
#: Buckets that packs are parted into; where there are more, coarse ranges are parted once more.
FAN = 4096
NOBODY = -1
BROADCAST_ROWS = 1_000_000


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        return h


_known = _Words()
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 65)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes, step: int) -> Iterator[np.ndarray]:
    """Hashes of a text's words, those of about step bytes at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + step) if at + step < len(text) else None
        end = cut.start() if cut else len(text)
        w = text[at:end].split()
        yield np.fromiter(map(_known.__getitem__, w), dtype=np.int64, count=len(w)).view(np.uint64)
        at = end


def shingle_sets(texts: list[str | None], n: int = N, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each text's distinct shingle hashes, ascending, one after another; of a text's words about TEXT_STEP bytes are at hand."""
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            low, found, lead, total = (t or "").encode().lower(), [], np.zeros(0, dtype=np.uint64), 0
            for h in _word_hashes(low, step or TEXT_STEP):
                total += len(h)
                h = np.concatenate((lead, h))  # shingles go on from the step before
                lead = h[max(0, len(h) - n + 1) :]
                if len(h) >= n:
                    s = h[: len(h) - n + 1] * _ODD[0]
                    for k in range(1, n):
                        s = s + h[k : len(h) - n + 1 + k] * _ODD[k]
                    found.append(_distinct(_mixed(s).view(np.int64)))
            if 0 < total < n:
                whole = hashlib.blake2b(b" ".join(low.split()), digest_size=8, person=b"whole").digest()
                found = [np.frombuffer(whole, dtype=np.int64)]
            if not found:
                continue
            parts.append(found[0] if len(found) == 1 else _distinct(np.concatenate(found)))
            counts[i] = len(parts[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), counts


def _distinct(s: np.ndarray) -> np.ndarray:
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    """Rows of a batch in pieces of about STEP words."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("node"), batch.column("text"), strict=True):
        t = t.as_py()
        ids.append(i.as_py())
        texts.append(t)
        size += len(t or "") // 6
        if size >= STEP:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _need(n: np.ndarray) -> np.ndarray:
    """ceil(t n): the least overlap with any set."""
    return -(-n * NUM // DEN)


def _asked(n):
    """l of the sieve: shared hashes asked of a prefix."""
    return np.maximum(1, n // 20)


class _Meeting:
    """Prefix hashes of one bucket, met piece by piece; distinct ones are kept, each with its
    holder as long as it has one only."""

    def __init__(self):
        self.h, self.who = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, who: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Holders to be credited, once for each of their hashes that has become shared."""
        order = np.argsort(h, kind="stable")
        who, h = who[order], h[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        times = np.diff(np.append(start, len(h)))
        own = h[start]
        at = np.searchsorted(self.h, own)
        known = np.zeros(len(own), dtype=bool)
        inside = at < len(self.h)
        known[inside] = self.h[at[inside]] == own[inside]
        credit = who[np.repeat(known | (times > 1), times)]
        credit = np.concatenate((credit, self.who[at[known]]))
        self.who[at[known]] = NOBODY
        new = ~known
        self.who = np.insert(self.who, at[new], np.where(times > 1, NOBODY, who[start])[new])
        self.h = np.insert(self.h, at[new], own[new])
        return credit[credit != NOBODY]


def _long(x: np.ndarray) -> bytes:
    return x.astype(np.int64).tobytes()


def _parted(who: np.ndarray, h: np.ndarray, n_buckets: int, coarse: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, nodes, hashes) of ascending hashes; coarse: buckets that stay together."""
    b = (((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)) // np.uint64(coarse)
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(h)), strict=True):
        yield int(b[lo]), _long(who[lo:hi]), h[lo:hi].tobytes()


_PACKED = ["bucket", "node", "x", "d1", "d2", "hits"]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PACKED)


def sieve(docs: DataFrame) -> DataFrame:
    """(node, n, d1, d2, hits) of docs (node, text): set size, digest of the set, and how many
    of its prefix hashes another prefix has; nodes are distinct and not negative."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n_buckets = max(1, size // 6 * 3 // 10 // BUCKET + 1)
    coarse = -(-n_buckets // FAN)  # buckets of a coarse range

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, fronts, owners = 0, 0, [], []

        def told(turn: int, node: np.ndarray, n=None, d1=None, d2=None, hits=None) -> tuple:
            zero = bytes(8 * len(node))
            return (n_buckets + turn % n_buckets, _long(node), *(zero if x is None else _long(x) for x in (n, d1, d2, hits)))

        def close() -> pa.RecordBatch:
            h, who = np.concatenate(fronts), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            times = np.diff(np.append(np.flatnonzero(first), len(h)))
            node, hits = np.unique(who[np.repeat(times > 1, times)], return_counts=True)
            # One of each hash goes on; those that repeat here are credited and have no holder later.
            rows = [(b, w, x, b"", b"", b"") for b, w, x in _parted(np.where(times > 1, NOBODY, who[first]), h[first], n_buckets, coarse)]
            return _blobs([*rows, told(turn, node, hits=hits)])

        for batch in batches:
            for ids, texts in _steps(batch):
                s, n = shingle_sets(texts)
                node = np.array(ids, dtype=np.int64)
                starts = np.cumsum(n) - n
                d1, d2 = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    with np.errstate(over="ignore"):
                        u = s.view(np.uint64)
                        d1[full] = np.add.reduceat(u, starts[full]).view(np.int64)
                        d2[full] = np.add.reduceat(_mixed(u * _ODD[40]), starts[full]).view(np.int64)
                own = np.repeat(np.arange(len(n)), n)
                front = np.arange(len(s)) - starts[own] < (n - _need(n) + _asked(n))[own]
                fronts.append(s[front])
                owners.append(node[own[front]])
                held += len(fronts[-1])
                turn += 1
                yield _blobs([told(turn, node, n, d1, d2)])
                if held >= PACK:
                    yield close()
                    held, fronts, owners = 0, [], []
        if held:
            yield close()
        fronts, owners = [], []
        give_back()

    def pieces(batches: Iterator[pa.RecordBatch], most: int):
        """(bucket, nodes, hashes) of at most about so many hashes of one bucket, then None; other rows as they are."""
        at, who, h, held = None, [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in _PACKED), strict=True):
                b = row[0].as_py()
                if b >= n_buckets:
                    yield tuple(x.as_py() for x in row)
                    continue
                if held and (b != at or held >= most):
                    yield at, np.concatenate(who), np.concatenate(h)
                    who, h, held = [], [], 0
                at = b
                who.append(np.frombuffer(row[1].as_py(), dtype=np.int64))
                h.append(np.frombuffer(row[2].as_py(), dtype=np.int64))
                held += len(h[-1])
        if held:
            yield at, np.concatenate(who), np.concatenate(h)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, PACK):
            if len(x) > 3:
                yield _blobs([x])
                continue
            order = np.argsort(x[2], kind="stable")
            yield _blobs([(b, w, h, b"", b"", b"") for b, w, h in _parted(x[1][order], x[2][order], n_buckets, 1)])
        give_back()

    names = ["node", "n", "d1", "d2", "hits"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, meeting, credit, held = None, _Meeting(), [], 0

        def told(node, n, d1, d2, hits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node, n, d1, d2, hits)], names=names)

        def close() -> pa.RecordBatch:
            node, hits = np.unique(np.concatenate(credit), return_counts=True)
            zero = np.zeros(len(node), dtype=np.int64)
            return told(node, zero, zero, zero, hits)

        for x in pieces(batches, PIECE):
            if len(x) > 3:
                yield told(*(np.frombuffer(c, dtype=np.int64) for c in x[1:]))
                continue
            if x[0] != at:
                at, meeting = x[0], _Meeting()
            credit.append(meeting.add(x[1], x[2]))
            held += len(credit[-1])
            if held >= PACK:  # a node's credits of many buckets in one row
                yield close()
                credit, held = [], 0
        if held:
            yield close()
        meeting, credit = None, []
        give_back()

    schema = "bucket long, node binary, x binary, d1 binary, d2 binary, hits binary"
    packed = docs.select("node", "text").mapInArrow(pack, schema)
    if coarse > 1:
        packed = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(part, schema)
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "node long, n long, d1 long, d2 long, hits long")
    # Rows of hits have zeros for the rest.
    out = met.groupBy("node").agg(F.max("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.sum("hits").alias("hits"))
    return written(out, "join-sieve")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, hs) of docs (node, text): all shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _steps(batch):
                s, n = shingle_sets(texts)
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(s))], names=["node", "hs"])
        give_back()

    return docs.select("node", "text").mapInArrow(run, "node long, hs array<long>")


def _enough(a: int, b: int) -> int:
    """Least overlap of sets of a and b that reaches the similarity."""
    return -(-(a + b) * NUM // (NUM + DEN))


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """Lower bound of the symmetric difference of two ascending arrays, by halving (suffix filter)."""
    bound = abs(len(x) - len(y))
    if depth == 0 or bound > most or not len(x) or not len(y):
        return bound
    mid = y[len(y) // 2]
    i, j = int(np.searchsorted(x, mid)), len(y) // 2
    left = _apart(x[:i], y[:j], most, depth - 1)
    if left + abs((len(x) - i) - (len(y) - j)) > most:
        return left + abs((len(x) - i) - (len(y) - j))
    return left + _apart(x[i:], y[j:], most - left, depth - 1)


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> bool:
    """Whether sets with shared-able keys a, b (ascending) and whole sizes na, nb are linked."""
    if min(na, nb) * DEN < max(na, nb) * NUM:
        return False
    need = _enough(na, nb)
    # Of na + nb elements at most na + nb - 2 need may be unshared; those of frequency 1 are.
    most = na + nb - 2 * need - (na - len(a)) - (nb - len(b))
    if most < 0 or _apart(a, b, most, 3) > most:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    length = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
    rows = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b").where(length).select("a", "b")
    rows = rows.join(left, "a").join(right, "b").select("a", "na", "ka", "b", "nb", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                ok = []
                cols = [batch.column(c) for c in ("na", "ka", "nb", "kb")]
                for na, ka, nb, kb in zip(*cols, strict=True):
                    ok.append(linked(ka.values.to_numpy(), na.as_py(), kb.values.to_numpy(), nb.as_py()))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with a distinct number in a column, its name, whether that is doc_id itself)."""
    name = "node"
    while name in docs.columns:
        name += "_"
    seen = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count_if(F.col("doc_id").isNull() | (F.col("doc_id") < 0)).alias("odd")).first()
    if (seen.n or 0) <= 1 and not seen.odd:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, True
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "join-numbered"), name, False


def _few(ids: DataFrame) -> DataFrame:
    """ids, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _least(n: str) -> Column:
    """The least overlap with any set of a set's size."""
    return F.expr(f"({n} * {NUM} + {DEN - 1}) div {DEN}")


def _overlap(a: str, b: str) -> Column:
    """The least overlap of linked sets of sizes a and b."""
    return F.expr(f"(({a} + {b}) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}")


def _may_link(x: str, y: str) -> Column:
    """Length and positional filters of two rows (n, pos) that meet at a key."""
    near = F.least(f"{x}_n", f"{y}_n") * DEN >= F.greatest(f"{x}_n", f"{y}_n") * NUM
    room = F.least(F.col(f"{x}_n") - F.col(f"{x}_pos"), F.col(f"{y}_n") - F.col(f"{y}_pos"))
    return near & (room >= _overlap(f"{x}_n", f"{y}_n"))


def _as(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "pos", "comp")))


def across(mixed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of mixed (key, big, node, n, pos, comp, band) that may be linked, of different components.

    Of a key's largest component big no two sets meet.
    """
    probe = mixed.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    index = mixed.where(F.col("pos") <= F.col("n") - F.expr(f"(n * {2 * NUM} + {NUM + DEN - 1}) div {NUM + DEN}"))
    rest, big = F.col("comp") != F.col("big"), F.col("comp") == F.col("big")
    out = None
    for p, i in ((probe.where(rest), index), (probe.where(big), index.where(rest))):
        met = _as(p, "x", "key", "band").join(_as(i, "y", "key", "band"), ["key", "band"])
        smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_node") < F.col("x_node")))
        met = met.where(smaller & (F.col("x_comp") != F.col("y_comp")) & _may_link("x", "y")).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        out = met if out is None else out.unionAll(met)
    return out.distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(node, n_shingles, component) of docs (node, text); component: its least node."""
    meta = sieve(docs)
    classes = meta.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("rep"))
    member = written(meta.join(unbound(classes, "d1"), ["n", "d1", "d2"], "left").select("node", "n", F.coalesce("rep", "node").alias("rep"), "hits"), "join-classes")
    asked = F.greatest(F.lit(1), F.expr("n div 20"))
    alive = member.where((F.col("n") > 0) & (F.col("node") == F.col("rep")) & (F.col("hits") >= asked)).select("node")
    alive = _few(written(alive, "join-alive"))
    full = full_sets(docs.join(alive, "node", "left_semi"))
    each = full.select("node", F.explode("hs").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    key = F.shiftleft(F.least(F.length(F.bin("df")) - 1, F.lit(31)).cast("long"), 58).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 58) - 1)))
    keys = each.join(unbound(df, "h"), "h").select("node", key.alias("key")).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    front = F.col("n") - _least("n") + 1 - (F.col("n") - F.size("keys"))
    sets = member.where("node = rep").select("node", "n").join(keys, "node").withColumn("front", front).where("front > 0")
    sets = written(sets, "join-sets")
    # Linked sizes differ by 4/3 at most, so by a band at most.
    band = F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).alias("band")
    tokens = sets.select("node", "n", band, (F.col("n") - F.size("keys")).alias("rare"), F.posexplode(F.slice("keys", F.lit(1), F.col("front").cast("int"))).alias("j", "key"))
    tokens = written(tokens.select("key", "node", "n", "band", (F.col("rare") + F.col("j")).cast("int").alias("pos")), "join-prefixes")
    hub = F.min(F.struct("node", "n", "pos")).alias("hub")
    hubs = tokens.groupBy("key", "band").agg(hub, F.count("*").alias("c")).where("c > 1").select("key", "band", *(F.col(f"hub.{c}").alias(f"x_{c}") for c in ("node", "n", "pos")))
    star = tokens.select("key", "band", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos"))).join(unbound(hubs, "key"), ["key", "band"])
    star = star.where((F.col("x_node") != F.col("y_node")) & _may_link("x", "y")).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    star = written(star.distinct(), "join-star")
    links = written(verified(star, sets), "join-links")
    comp = written(components(links), "join-components")
    # Across components.
    own = tokens.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    own = written(own, "join-labelled")
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count("*").alias("k")).where("k > 1").select("key", "big")
    mixed = written(own.join(unbound(sizes, "key"), "key"), "join-mixed")
    pairs = written(across(mixed).join(star, ["a", "b"], "left_anti"), "join-pairs")
    more = written(verified(pairs, sets), "join-more")
    if not more.isEmpty():
        comp = written(components(links.unionAll(more)), "join-components")
    out = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("node", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def linked_groups(rows: DataFrame, node: str, plain: bool) -> DataFrame:
    """(node, doc_id, n_shingles, component_id, first) of numbered rows: first is the node that stays
    of a group, the one of least doc_id (null last)."""
    own = rows.select(F.col(node).alias("node"), "doc_id", "text")
    found = groups(own.select("node", "text"))
    if plain:
        return found.select("node", F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("component").alias("first"))
    found = written(found.join(own.select("node", "doc_id"), "node"), "join-found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    found = found.join(unbound(first, "component"), "component")
    return found.select("node", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), F.col("best.node").alias("first"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_groups(*numbered(docs)).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id (a null one only where there is no
    other); of rows that repeat wholly one stays."""
    rows, node, plain = numbered(docs)
    gone = linked_groups(rows, node, plain).where("first <> node").select(F.col("node").alias(node))
    return rows.join(_few(written(gone, "join-gone")), node, "left_anti").select(*docs.columns)


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
  THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.o)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
"""
