"""Operator 11: personal data by patterns, and by a linear-chain conditional random field.

Base spans come from the patterns of four kinds (email, ip, card, phone), each found in
one scan of the whole text in time proportional to it. The field adds spans of KINDS
(addresses, document numbers, names, local phone numbers) that overlap no base span. Its
words are runs without white space; a word's features are its shape, its ends, its digits
and, where the labelled table has it, the word itself; weights are by place from two
words before to two after. It is trained on a small labelled table (pii_table) by the
exact likelihood, and decoded by Viterbi in numpy over many windows at once: CORE words
with MARGIN more on both sides, a span belonging to the window in whose core it begins.

Defined results: null and empty texts have no spans; rows that repeat are rows of their
own with equal spans; an empty table gives an empty result; a null id stays; texts of any
length are read whole, the patterns at once and the field in pieces of about STEP
characters which overlap by PAD; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, small_batches
from textquarry.llm.pii_table import KINDS, drawn

BASE = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
CORE, MARGIN, TOGETHER = 96, 16, 1024
#: Runs of more words are no span (repeated words look like long addresses).
MOST_WORDS = 12
STEP, PAD = 1_000_000, 2000
#: Words before and after that a label's score sees; words and feature sets that a task remembers.
REACH, KNOWN = 2, 400_000
EPOCHS, RATE, RIDGE = 200, 0.1, 4e-5
#: Share of the words that are learnt without themselves and their ends.
DROPPED = 0.2
#: Longer words have no features but their length.
LONGEST = 64
_NEVER = np.float32(-1e4)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&_/\\~`^+=-°"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(ips, cards) of a text, from its runs of digits."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    ips, cards, i = [], [], 0
    while i + 3 < len(runs):
        if all(runs[k + 1][0] == runs[k][1] + 1 and text[runs[k][1]] == "." for k in range(i, i + 3)):
            if all(_small(text[a:b]) for a, b in runs[i : i + 4]):
                ips.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        if 13 <= sum(b - a for a, b in runs[i : j + 1]) <= 19 and _luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            cards.append((runs[i][0], runs[j][1]))
        i = j + 1
    return ips, cards


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed in BASE, then start."""
    ips, cards = numbers(text)
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdecimal() for c in m[0]) <= 15] if "+" in text else []
    return [(kind, a, b) for kind, own in zip(BASE, (emails(text), ips, cards, phones), strict=True) for a, b in own]


# The field.

_SHAPE = {**{ord(c): "d" for c in "0123456789"}, **{ord(c): "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "x" for c in "abcdefghijklmnopqrstuvwxyz"}}


def _case(core: str) -> str:
    return "x" if core.islower() else "X" if core.isupper() else "Xx" if core[1:].islower() else "xX"


def features(word: str) -> list[str]:
    """Feature names of a word without white space."""
    if len(word) > LONGEST:
        return ["long"]
    core = word.strip(_EDGE)
    lead, tail = word[: len(word) - len(word.lstrip(_EDGE))], word[len(word.rstrip(_EDGE)) :]
    out = ["bias", "w=" + core.lower(), "lead=" + lead[-1:], "tail=" + tail[:1]]
    if not core:
        return [*out, "s="]
    if core.isalpha():
        return [*out, "s=" + _case(core), "f=" + core.lower()[-3:], "one" if len(core) == 1 else "more"]
    full = "".join(c if c in "dXx" or not c.isalpha() else "X" if c.isupper() else "x" for c in core.translate(_SHAPE))
    return [*out, "s=" + re.sub(r"(.)\1+", r"\1", full), "s+=" + re.sub(r"x+", "x", full), f"digits={min(12, full.count('d'))}"]


class Field:
    """Weights of a linear chain: weight (places, features, labels), move (labels, labels)."""

    def __init__(self, names: dict[str, int], weight: np.ndarray, move: np.ndarray):
        self.names, self.weight, self.move = names, weight, move
        self.barred = np.zeros((len(LABELS), len(LABELS)), dtype=np.float32)  # from, to
        for j, b in enumerate(LABELS):
            if b.startswith("I-"):
                self.barred[[i for i, a in enumerate(LABELS) if a[2:] != b[2:] or a == "O"], j] = _NEVER
        self.first = np.array([_NEVER if b.startswith("I-") else 0 for b in LABELS], dtype=np.float32)

        self.frames: dict[tuple, tuple[int, ...]] = {}

    def known(self, word: str) -> tuple[int, ...]:
        """The features of a word that the field has weights for."""
        core, get = word.strip(_EDGE), self.names.get
        if len(word) > LONGEST or not core.isalpha():
            return tuple(n for f in features(word) if (n := get(f)) is not None)
        # Of a word of letters all but itself and its end is one of few frames.
        at = 0 if len(core) == len(word) else len(word) - len(word.lstrip(_EDGE))
        frame = (word[max(0, at - 1) : at], word[at + len(core) : at + len(core) + 1], len(core) == 1, _case(core))
        if frame not in self.frames:
            own = features(frame[0] + core + frame[1])
            self.frames[frame] = tuple(n for f in own if f[:2] not in ("w=", "f=") and (n := get(f)) is not None)
        low = core.lower()
        return self.frames[frame] + tuple(n for f in ("w=" + low, "f=" + low[-3:]) if (n := get(f)) is not None)

    def loglike(self, emit: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, its gradients by emit (T, B, L) and by move) of padded sequences, by scaled sums forward and backward."""
        T, B, L = emit.shape
        move = np.exp(self.move + self.barred)
        top = emit.max(axis=2, keepdims=True)
        e = np.exp(emit - top)
        ahead, back, scale = np.empty((T, B, L)), np.ones((T, B, L)), np.ones((T, B, 1))
        ahead[0] = e[0] * np.exp(self.first)
        for t in range(T):
            if t:
                ahead[t] = np.where(mask[t][:, None], (ahead[t - 1] @ move) * e[t], ahead[t - 1])
            scale[t] = ahead[t].sum(axis=1, keepdims=True)
            ahead[t] /= scale[t]
        for t in range(T - 2, -1, -1):
            back[t] = np.where(mask[t + 1][:, None], (e[t + 1] * back[t + 1] / scale[t + 1]) @ move.T, back[t + 1])
        total = (np.log(scale[:, :, 0]) + top[:, :, 0] * mask).sum()
        at = (np.arange(T)[:, None], np.arange(B)[None, :], gold)
        both = mask[1:] & mask[:-1]
        score = (emit[at] * mask).sum() + self.first[gold[0]].sum() + ((self.move + self.barred)[gold[:-1], gold[1:]] * both).sum()
        d_emit = -ahead * back * mask[:, :, None]
        d_emit[at] += mask
        after = e[1:] * back[1:] / scale[1:] * both[:, :, None]
        d_move = -(ahead[:-1].reshape(-1, L).T @ after.reshape(-1, L)) * move
        np.add.at(d_move, (gold[:-1][both], gold[1:][both]), 1.0)
        return float(score - total), d_emit, d_move

    def viterbi(self, emit: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best labels (T, B) for scores (T, L, B); beyond a window's words what stood before goes on."""
        T, L, B = emit.shape
        move = (self.move + self.barred).astype(np.float32)
        score = np.empty((T, L, B), dtype=np.float32)
        score[0] = emit[0] + self.first[:, None]
        for t in range(1, T):
            for j in range(L):
                score[t, j] = (score[t - 1] + move[:, j, None]).max(axis=0)
            score[t] += emit[t]
            if not mask[t].all():
                score[t] = np.where(mask[t], score[t], score[t - 1])
        out = np.empty((T, B), dtype=np.int8)
        out[-1] = now = score[-1].argmax(axis=0)
        for t in range(T - 2, -1, -1):
            before = (score[t] + move[:, now]).argmax(axis=0)
            out[t] = now = np.where(mask[t + 1], before, now)
        return out


def train(rows: list[tuple[list[str], list[str]]], epochs: int = EPOCHS, ridge: float = RIDGE, least: int = 3) -> Field:
    """A field fitted to labelled rows (words, labels) by Adam; features of fewer than `least` rows are left out."""
    seen: dict[str, int] = {}
    for words, _ in rows:
        for f in {f for w in words for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    places, L = 2 * REACH + 1, len(LABELS)
    field = Field(names, np.zeros((places, len(names), L)), np.zeros((L, L)))
    kinds: dict[tuple[int, ...], int] = {(): 0}
    rng, by_heart = random.Random(1), {i for f, i in names.items() if f.startswith(("w=", "f="))}
    T, B = max(len(w) for w, _ in rows), len(rows)
    ids, gold, mask = np.zeros((T + 2 * REACH, B), dtype=np.int64), np.zeros((T, B), dtype=np.int64), np.zeros((T, B), dtype=bool)
    for b, (words, labels) in enumerate(rows):
        n = len(words)
        for t, w in enumerate(words):
            own = field.known(w)
            if rng.random() < DROPPED:  # what shapes can tell isn't learnt by heart
                own = tuple(f for f in own if f not in by_heart)
            ids[REACH + t, b] = kinds.setdefault(own, len(kinds))
        gold[:n, b], mask[:n, b] = [LABELS.index(x) for x in labels], True
    owner = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
    feature = np.array([f for k in kinds for f in k], dtype=np.int64)
    count = max(1, int(mask.sum()))
    mean = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weight, field.move)]
    for step in range(1, epochs + 1):
        table = np.stack([_by(owner, field.weight[p][feature], len(kinds)) for p in range(places)])
        emit = sum(table[p][ids[p : p + T]] for p in range(places))
        _, d_emit, d_move = field.loglike(emit, mask, gold)
        flat = d_emit.reshape(-1, L)
        grad = np.stack([_by(feature, _by(ids[p : p + T].ravel(), flat, len(kinds))[owner], len(names)) for p in range(places)])
        for x, d, (m, v) in zip((field.weight, field.move), (grad, d_move), mean, strict=True):
            d = d / count - ridge * x
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


def _by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums (n, columns) of rows by index."""
    return np.stack([np.bincount(at, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1)


class Tagger:
    """Finds a field's spans in texts; words' feature sets are remembered."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.kinds: dict[tuple[int, ...], int] = {(): 0}  # 0: beyond a text's ends
        self.table = np.zeros((2 * REACH + 1, 1024, len(LABELS)), dtype=np.float32)

    def _learn(self, words: set[str]) -> None:
        for w in words:
            known = self.field.known(w)
            kind = self.kinds.get(known)
            if kind is None:
                kind = self.kinds[known] = len(self.kinds)
                if kind == self.table.shape[1]:
                    self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
                self.table[:, kind] = self.field.weight[:, list(known)].sum(axis=1)
            self.words[w] = kind

    def tagged(self, split: list[list[str]]) -> Iterator[tuple[int, int, int, str]]:
        """(text, first word, last word, kind) of split texts, in order of their places."""
        if len(self.words) > KNOWN:
            self._forget()
        self._learn(set().union(*split) - self.words.keys())
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        starts = np.cumsum(counts + 2 * REACH) - counts - REACH  # of a text's words, among gaps
        flat = np.zeros(int(counts.sum()) + 2 * REACH * (len(split) + 1), dtype=np.int64)
        for s, words in zip(starts, split, strict=True):
            flat[s : s + len(words)] = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        n = -(-counts // CORE)
        text = np.repeat(np.arange(len(split)), n)
        core = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * CORE
        lo, hi = np.maximum(core - MARGIN, 0), np.minimum(core + CORE + MARGIN, counts[text])
        found = []
        order = np.argsort(hi - lo, kind="stable")
        for at in range(0, len(order), TOGETHER):
            w = order[at : at + TOGETHER]
            size = hi[w] - lo[w]
            T = int(size.max())
            place = np.arange(T)[:, None]
            mask = place < size
            where = np.where(mask, starts[text[w]] + lo[w] + place, starts[text[w]] + lo[w])
            emit = sum(self.table[p][flat[where + p - REACH]] for p in range(2 * REACH + 1))
            best = self.field.viterbi(np.ascontiguousarray(emit.transpose(0, 2, 1)), mask)
            for b, t in np.argwhere(((best > 0) & (best % 2 == 1) & mask).T):
                first = int(lo[w[b]] + t)
                if not core[w[b]] <= first < core[w[b]] + CORE:
                    continue
                end = int(t) + 1
                while end < size[b] and best[end, b] == best[t, b] + 1:
                    end += 1
                if end - t > MOST_WORDS:
                    continue
                found.append((int(text[w[b]]), first, int(lo[w[b]] + end - 1), LABELS[best[t, b]][2:]))
        last = (-1, -1)
        for i, a, b, kind in sorted(found):
            if (i, a) > last:  # a span that began in the window before goes first
                yield i, a, b, kind
                last = (i, b)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of whole texts, without their outer punctuation."""
        out: list[list[Span]] = [[] for _ in texts]
        parts = [(i, *p) for i, t in enumerate(texts) for p in pieces(t)]
        lo = 0
        while lo < len(parts):  # about STEP characters at once
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size < STEP):
                size += parts[hi][4] - parts[hi][1]
                hi += 1
            split = [texts[i][a:d].split() for i, a, _, _, d in parts[lo:hi]]
            places: dict[int, list[tuple[int, int]]] = {}
            for k, first, last, kind in self.tagged(split):
                i, a, b, c, d = parts[lo + k]
                if k not in places:
                    places = {k: [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", texts[i][a:d])]}
                start, end = places[k][first][0], places[k][last][1]
                if b <= start < c:
                    whole = texts[i][start:end]
                    start, end = start + len(whole) - len(whole.lstrip(".,;:!?\"'[]{}<>|*#")), end - len(whole) + len(whole.rstrip(".,;:!?\"'[]{}<>|*#"))
                    if start < end:
                        out[i].append((kind, start, end))
            lo = hi
        return out


_SPACE = re.compile(r"\s")


def pieces(text: str, step: int | None = None, pad: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, c, d): text[b:c] are pieces of about step characters that end before white space, text[a:d] with their surroundings."""
    step, pad, b = step or STEP, PAD if pad is None else pad, 0

    def space(at: int) -> int:
        m = _SPACE.search(text, at) if at < len(text) else None
        return m.start() if m else len(text)

    while b < len(text):
        c = space(b + step)
        yield (min(b, space(b - pad)) if b > pad else 0), b, c, space(c + pad)
        b = c


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans as they are, and those of the field that overlap none; by kind as listed, then start."""
    taken = sorted((a, b) for _, a, b in base)
    ends = [0]  # the furthest end of the spans up to each
    for _, b in taken:
        ends.append(max(ends[-1], b))
    free = [s for s in more if ends[bisect.bisect_left(taken, (s[2], 0))] <= s[1]]
    return base + sorted(free, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # as large as the labelled table makes it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            whole = [all_spans(b, m) for b, m in zip(base, tagger.spans(texts), strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            added = pa.array([len(w) - len(b) for w, b in zip(whole, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(map(joined, whole), pa.string()), added], names=_NAMES)
        del tagger
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in _NAMES))


_NAMES = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return found(docs, train(drawn()))
