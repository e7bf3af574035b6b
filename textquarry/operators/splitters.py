"""Splitters for whole texts: by the first separator that occurs, and by sentences.

Both cut a text into units that lie side by side, until each is small enough, and then
lay windows of units over them. A window takes as many units as fit; the next one begins
with as many of its last units as the overlap allows and leave room for the unit after.
Places are offsets, so a piece is a slice of its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and overlaps, in characters and in tokens, and the separators in their order.
SIZE, OVERLAP, SEPARATORS = 1000, 200, ("\n\n", "\n", ". ", " ", "")
SENTENCE_SIZE, SENTENCE_OVERLAP = 1024, 200
#: Characters of pieces that are handed on together, about.
PIECES = 4 << 20
#: A sentence ends with its end marks and the white space after them; a clause with its mark.
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n][.!? \t\r\n\f\x0B]*|[^.!?\n]+")
_CLAUSE = re.compile(r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]")

Span = tuple[int, int]


def windows(sizes: Sequence[int] | np.ndarray, size: int, overlap: int) -> Iterator[Span]:
    """(first, end) of the windows over units of these sizes; a unit beyond size stands alone."""
    upto = np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64))))
    n, first = len(upto) - 1, 0
    while n:
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + size, side="right")) - 1)
        yield first, end
        if end >= n:
            return
        least = max(upto[end] - overlap, upto[end + 1] - size)
        first = min(end, int(np.searchsorted(upto, least, side="left")))


def _before(text: str, lo: int, hi: int, sep: str) -> list[int]:
    """Ends of the parts of text[lo:hi] when it is cut before each separator."""
    if not sep:
        return list(range(lo + 1, hi + 1))
    at, cuts = text.find(sep, lo, hi), []
    while at >= 0:
        if at > lo:
            cuts.append(at)
        at = text.find(sep, at + len(sep), hi)
    return [*cuts, hi]


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> Iterator[Span]:
    """Places of the pieces, in order; neighbours of one cut that are small enough share windows."""

    def cut(lo: int, hi: int, level: int) -> Iterator[Span]:
        level = next((k for k in range(level, len(separators)) if separators[k] and text.find(separators[k], lo, hi) >= 0 or not separators[k]), len(separators) - 1)
        if not separators[level]:  # single characters: windows by counting
            for a, b in windows(np.ones(hi - lo, dtype=np.int64), size, overlap):
                yield lo + a, lo + b
            return
        at, run = lo, []  # run: ends of the small parts since the last large one
        for end in [*_before(text, lo, hi, separators[level]), None]:
            if end is not None and end - (run[-1] if run else at) < size:
                run.append(end)
                continue
            if run:
                edges = [at, *run]
                for a, b in windows(np.diff(edges), size, overlap):
                    yield edges[a], edges[b]
                at, run = run[-1], []
            if end is not None:
                if level + 1 < len(separators):
                    yield from cut(at, end, level + 1)
                else:
                    yield at, end
                at = end

    if text:
        yield from cut(0, len(text), 0)


def estimate(text: str) -> int:
    """Tokens by length: a quarter of the characters, 1 at least."""
    return max(1, len(text) // 4)


def sentence_spans(text: str, size: int = SENTENCE_SIZE, overlap: int = SENTENCE_OVERLAP, count: Callable[[str], int] = estimate) -> Iterator[Span]:
    """Places of the pieces: paragraphs, cut to sentences, clauses, words and characters as far as needed."""
    cuts = [
        lambda lo, hi: _before(text, lo, hi, "\n\n\n"),
        lambda lo, hi: [m.end() for m in _SENTENCE.finditer(text, lo, hi)],
        lambda lo, hi: [m.end() for m in _CLAUSE.finditer(text, lo, hi)],
        lambda lo, hi: _before(text, lo, hi, " "),
        lambda lo, hi: _before(text, lo, hi, ""),
    ]
    ends, sizes, todo = [], [], [(0, len(text))] if text else []
    while todo:
        lo, hi = todo.pop()
        n = count(text[lo:hi])
        if n <= size or hi - lo == 1:
            ends.append(hi)
            sizes.append(n)
            continue
        parts = next(p for f in cuts if len(p := f(lo, hi)) > 1)
        todo += reversed(list(zip([lo, *parts[:-1]], parts, strict=True)))
    edges = [0, *ends]
    for a, b in windows(sizes, size, overlap):
        yield edges[a], edges[b]


def pieces(text: str, spans: Iterator[Span]) -> list[str]:
    """The texts at these places without outer white space; empty ones are left out."""
    return [p for a, b in spans if (p := text[a:b].strip())]


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return pieces(text, recursive_spans(text, size, overlap))


def sentence_pieces(text: str, told: int = 0, size: int = SENTENCE_SIZE, overlap: int = SENTENCE_OVERLAP, count: Callable[[str], int] = estimate) -> list[str]:
    """told: tokens of the metadata that stands before each piece and takes of its room."""
    if told >= size:
        raise ValueError(f"metadata of {told} tokens leaves no room in pieces of {size}")
    return pieces(text, sentence_spans(text, size - told, overlap, count))


def cut_batches(batches: Iterator[pa.RecordBatch], cut: Callable[..., list[str]], names: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """Pieces of texts, those of many texts in one batch."""
    for batch in batches:
        more, row, found, size, whole = [batch.column(n).to_pylist() for n in names], [], [], 0, batch.column("doc_id")

        def out(whole=whole):
            own, place = whole.take(pa.array(row, pa.int64())), pa.array((np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32))
            chunk = pc.binary_join_element_wise(own.cast(pa.string()), place.cast(pa.string()), "::")
            return pa.RecordBatch.from_arrays([own, place, chunk, pa.array(found, pa.string())], names=["doc_id", "chunk_ix", "chunk_id", "texto"])

        for i, t in enumerate(batch.column("texto")):
            own = cut(t.as_py() or "", *(m[i] for m in more))
            row += [i] * len(own)
            found += own
            size += sum(map(len, own))
            if size > PIECES:
                yield out()
                row, found, size = [], [], 0
        if found:
            yield out()


def split_with(docs: DataFrame, cut: Callable[..., list[str]], level: str, *also: Column) -> DataFrame:
    """(doc_id, chunk_ix, chunk_id, texto, nivel_segmentacao) of a splitter over whole texts; also: columns that it takes beside the text."""
    names = [f"__{i}" for i in range(len(also))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "texto", *(c.alias(n) for c, n in zip(also, names, strict=True)))
    return own.mapInArrow(lambda batches: cut_batches(batches, cut, names), f"doc_id {kind}, chunk_ix int, chunk_id string, texto string").withColumn("nivel_segmentacao", F.lit(level))
