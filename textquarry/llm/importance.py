"""Operator 12: resampling towards a target by hashed n-gram importance, over an integer word dictionary.

A task numbers the distinct words of its documents; an n-gram is a tuple (id of the
shorter n-gram before, id of its last word), so that each distinct tuple of a run of
about RUN words is one integer. Its bytes are put together from the dictionary and
hashed once; the tuple's bucket goes back to all its occurrences, and counts are summed by
bucket. Dictionaries stay in their task (KNOWN words at most, then a new one begins):
what is shuffled are BUCKETS counts a task, and no word or n-gram.

Documents are read once and stored as their features' buckets; a bucket's gain is a log
ratio of its shares of all features in the target and in the documents; a document's
weight is its features' mean gain. With a Gumbel key from a hash of its id added, the
highest scores are a weighted sample without replacement; ranks come from a sort by ranges.

Defined results: null and empty texts have no features and weight 0; a null id hashes as
the empty text and comes last in ties; rows that repeat are rows of their own, tied ones
in any order among their equals; an empty target has no counts (every gain comes from the
documents' own counts); an empty table gives an empty result; texts of any length are
taken whole, STEP bytes at a time; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, written

#: Words of a run, words of a dictionary, and bytes of a text that are split at once, about.
RUN, KNOWN, STEP = 300_000, 200_000, 1 << 20
BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Documents with fewer words aren't drawn; percent of the others that are.
LEAST_WORDS, SHARE = 20, 25
#: A-Z become a-z; digits, a-z and all bytes of other scripts stay; the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Ids(dict):
    """word: id, in the order that they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: bytes, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, step by step."""
    plain, at = text.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + step)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Hasher:
    """Buckets of all features of texts; hashes every distinct tuple of a run once."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        self.longest, self.buckets = longest, buckets
        self._forget()

    def _forget(self) -> None:
        self.ids, self.words, self.hashes = _Ids(), [], []

    def of(self, texts: list[bytes], run: int = RUN, step: int = STEP) -> tuple[list[np.ndarray], list[int]]:
        """(buckets of each text's features, number of its words)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        counts, todo, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            lead: list[bytes] = []  # the last words of the step before: their n-grams go on
            for words in words_of(text, step):
                if not words:
                    continue
                counts[i] += len(words)
                todo.append((i, len(lead), lead + words))
                lead = (lead + words)[len(lead) + len(words) - self.longest + 1 :] if self.longest > 1 else []
                size += len(words)
                if size >= run:
                    self._run(todo, out)
                    todo, size = [], 0
        if todo:
            self._run(todo, out)
        return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint16) for x in out], counts

    def _run(self, todo: list, out: list[list[np.ndarray]]) -> None:
        if len(self.ids) > KNOWN:
            self._forget()
        n = np.array([len(words) for _, _, words in todo])
        flat = np.concatenate([np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words)) for _, _, words in todo])
        new = list(self.ids)[len(self.words) :]
        self.words += new
        self.hashes += [zlib.crc32(w) for w in new]
        part = np.repeat(np.arange(len(todo)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        lead = np.array([x for _, x, _ in todo])
        at, tuple_id, hashes = np.arange(len(flat)), flat, self.hashes
        for k in range(1, self.longest + 1):
            if k > 1:  # n-grams that end at `at`: the tuple before and the word
                keep = np.flatnonzero(place[at] >= k - 1)
                previous = np.full(len(flat), -1)
                previous[at] = tuple_id
                at = at[keep]
                distinct, tuple_id = np.unique(previous[at - 1] * len(self.words) + flat[at], return_inverse=True)
                before, last = np.divmod(distinct, len(self.words))
                spaced = [zlib.crc32(b" ", h) for h in hashes]
                hashes = list(map(zlib.crc32, map(self.words.__getitem__, last.tolist()), map(spaced.__getitem__, before.tolist())))
            bucket = (np.array(hashes, dtype=np.int64) % self.buckets).astype(np.uint16)
            own = place[at] >= lead[part[at]]  # what ends among the leading words was counted in the step before
            ends = np.cumsum(np.bincount(part[at][own], minlength=len(todo)))
            for (i, _, _), piece in zip(todo, np.split(bucket[tuple_id[own]], ends[:-1]), strict=True):
                out[i].append(piece)


def hashed(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, buckets) of every row; buckets: two bytes a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 4 * STEP or i == len(texts) - 1:
                    found, counts = hasher.of(texts[at : i + 1])
                    cells = pa.array([x.tobytes() for x in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, i + 1 - at), pa.array(counts, pa.int64()), cells], names=["doc_id", "n_words", "buckets"])
                    at, size = i + 1, 0
        del hasher
        give_back()

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all buckets, number of each row)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint16), np.fromiter((len(x) // 2 for x in rows), dtype=np.int64, count=len(rows))


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Number of features by bucket, over all hashed rows; BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("buckets"))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, with one added to every count."""
    n = len(source)
    up, down = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * up / (float(s + 1) * down))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of hashed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _flat(batch.column("buckets"))
            upto = np.concatenate(([0], np.cumsum(gain[flat])))
            ends = np.cumsum(n)
            weight = np.where(n > 0, (upto[ends] - upto[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """Every row of docs (doc_id, text) with its weight, score and, where it is drawn, rank; target (text)."""
    rows = written(hashed(docs), "importance-buckets")
    goal = hashed(target.withColumn("doc_id", F.lit(0)))
    own = weighed(rows, gains(bucket_counts(rows), bucket_counts(goal)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    key = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = F.col("n_words") >= least_words
    own = own.withColumn("score", (F.col("weight") + key).cast("long")).withColumn("able", able)
    # Those that can be drawn come first, by score; a range's rows are numbered from the rows before it.
    order = [F.desc("able"), F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    placed = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-ranks")
    part = F.shiftright("at", 33)
    before, total, n_able = [], 0, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect()):  # a row a range
        before += [F.lit(r.part), F.lit(total)]
        total, n_able = total + r.n, n_able + r.able
    base = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    rank = (base + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= share * n_able // 100), rank).alias("rank"), "n_words")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")).drop("n_words")


#: The bytes' CRC-32 by its table of 256 remainders, which a recursive query works out.
OP12_SQL = """
WITH RECURSIVE bits AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
words AS (SELECT true AS doc, row_number() OVER () AS no, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
grams AS (SELECT doc, no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
per AS (SELECT doc, no, g, count(*) AS n FROM grams GROUP BY ALL),
bytes AS (SELECT g, list_transform(range(0, octet_length(encode(g)) * 2, 2), lambda i: ('0x' || substr(hex(encode(g)), i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT g FROM per)),
hash AS (SELECT g, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
cnt AS (SELECT bucket, sum(n) FILTER (doc) AS s, sum(n) FILTER (NOT doc) AS t FROM per JOIN hash USING (g) GROUP BY bucket),
tot AS (SELECT sum(s) AS s, sum(t) AS t FROM cnt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(c.t, 0) + 1)::DOUBLE * (coalesce(tot.s, 0) + 10000)::DOUBLE / ((coalesce(c.s, 0) + 1)::DOUBLE * (coalesce(tot.t, 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM cnt c, tot),
wt AS (SELECT no, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM per JOIN hash USING (g) JOIN gain USING (bucket) WHERE doc GROUP BY no),
sc AS (SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN wt USING (no) WHERE doc),
rk AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS LAST) AS r FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * (SELECT count(*) FROM sc WHERE able) // 100 THEN r END AS rank FROM rk
"""
