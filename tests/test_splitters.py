"""Splitters against the rules told plainly; what the SQL counterparts can't reach (sizes, odd texts)."""

import random

import pytest

from textquarry.operators import splitters as S


def _plain(sizes, size, overlap):
    """Unit by unit: a full window is told, its first units go until the overlap is small and the next unit fits."""
    out, window, total = [], [], 0
    for i, n in enumerate(sizes):
        if window and total + n > size:
            out.append((window[0], i))
            while window and (total > overlap or total + n > size):
                total -= sizes[window.pop(0)]
        window.append(i)
        total += n
    return [*out, (window[0], len(sizes))] if window else out


def test_windows():
    rng = random.Random(1)
    for _ in range(3000):
        size = rng.randrange(1, 40)
        sizes = [rng.randrange(1, size + 1) for _ in range(rng.randrange(25))]
        overlap = rng.randrange(0, size)
        assert list(S.windows(sizes, size, overlap)) == _plain(sizes, size, overlap)
    assert list(S.windows([9, 1, 1], 5, 2)) == [(0, 1), (1, 3)]  # a unit beyond the size stands alone


def _text(rng, n):
    return "".join(rng.choice(["word", "é", " ", " ", ". ", "\n", "\n\n", "\n\n\n", ",", "x" * rng.randrange(1, 60), "! ", ".", "？"]) for _ in range(n))


def _recursive(text, size, overlap, seps):
    """The rules as they are told: cut before the first separator that occurs, go on with what is too large, lay windows over the rest."""
    k = next(i for i, s in enumerate(seps) if s in text)
    if seps[k]:
        head, *rest = text.split(seps[k])
        parts = [p for p in [head, *(seps[k] + r for r in rest)] if p]
    else:
        parts = list(text)
    out, run = [], []

    def told():
        out.extend("".join(run[a:b]) for a, b in _plain([len(p) for p in run], size, overlap))
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            told()
            out.extend(_recursive(p, size, overlap, seps[k + 1 :]))
    told()
    return out


@pytest.mark.parametrize("size,overlap", [(20, 6), (50, 0), (1000, 200)])
def test_recursive(size, overlap):
    rng = random.Random(size)
    for _ in range(200):
        text = _text(rng, rng.randrange(1, 120))
        want = [p.strip() for p in _recursive(text, size, overlap, S.SEPARATORS)]
        assert S.recursive_pieces(text, size, overlap) == [p for p in want if p]
        assert all(len(p) <= size for p in S.recursive_pieces(text, size, overlap))
    assert S.recursive_pieces("") == [] and S.recursive_pieces(" \n ") == []


def test_sentences():
    assert S.sentence_pieces("One. Two! Three? Four", size=2, overlap=0) == ["One. Two!", "Three? Four"]
    assert S.sentence_pieces("One. Two! Three? Four", size=2, overlap=1) == ["One. Two!", "Two! Three?", "Three? Four"]
    rng = random.Random(4)
    for _ in range(200):
        text = _text(rng, rng.randrange(1, 150))
        size = rng.randrange(3, 30)
        spans = list(S.sentence_spans(text, size, size // 4))
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a < b and c <= b and b < d for (a, b), (c, d) in zip(spans, spans[1:]))  # nothing is left out, windows go on
        edges = sorted({x for s in S.sentence_spans(text, 1, 0) for x in s})  # every cut that any size makes is one of these
        assert all(a in edges and b in edges for a, b in spans)
    assert S.sentence_pieces("a b c " * 400, told=1000) != S.sentence_pieces("a b c " * 400)
    with pytest.raises(ValueError, match="no room"):
        S.sentence_pieces("a", told=1024)


def test_long_texts_without_separators():
    text = "x" * 3_000_000
    found = list(S.recursive_spans(text))
    assert found[0] == (0, 1000) and found[1] == (800, 1800) and found[-1][1] == len(text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 900), (2, None), (3, "")], "doc_id long, texto string")
    got = S.split_with(docs, S.recursive_pieces, "recursivo").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_id for r in got] == [f"1::{i}" for i in range(len(got))] and len(got) > 1


def test_pieces_of_many_texts_come_together():
    import pyarrow as pa

    from textquarry.operators import splitters

    texts = ["um dois tres " * n for n in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(texts)], names=["doc_id", "texto"])
    got = list(splitters.cut_batches([batch], splitters.recursive_pieces))
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(i, k, f"{i}::{k}", p) for i, t in enumerate(texts) for k, p in enumerate(splitters.recursive_pieces(t or ""))]
    assert len(got) == 1  # a batch a text is far slower
