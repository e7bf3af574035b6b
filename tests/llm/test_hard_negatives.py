import math
import random

import numpy as np
import pytest

from textquarry.llm import hard_negatives as H

KIND = "vec_id long, embedding array<double>, label int, source string"


def _brute(rows):
    """The same by the contract's words, row by row; rows may repeat ids."""
    own = []
    for i, x, label, *_ in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    dot = lambda u, v: sum(a * b for a, b in zip(u, v))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, k, m) for m, (j, k, w) in enumerate(own) if m != a]
        for p, j, _, _ in sorted((t for t in scored if t[2] == label), key=order)[:5]:
            fits = sorted((t for t in scored if t[2] != label and 30 * p <= 100 * t[0] <= 90 * p), key=order)[:10]
            out += [(i, j, r + 1, t[1], p, t[0]) for r, t in enumerate(fits)]
    return sorted(out, key=str)


def _run(spark, table, rows):
    path = table("embeddings", rows, KIND)
    return sorted((tuple(r) for r in H.op13_hard_negatives(spark, path).collect()), key=str)


def _rows(n, d, seed=1, groups=False):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(10)]
    rows = []
    for i in range(n):
        label = rng.randrange(10)
        x = [rng.gauss(m if groups else 0, 0.1) for m in middle[rng.randrange(10) if rng.random() < 0.5 else label]]
        rows.append((i, x, label, "s"))
    return rows


@pytest.mark.parametrize("groups", [False, True])
def test_brute_force(spark, table, groups):
    rows = _rows(900, 12, groups=groups)
    want = _brute(rows)
    assert want and _run(spark, table, rows) == want


def test_blocks_steps_and_tables(spark, table, monkeypatch):
    rows = _rows(1500, 9, seed=4, groups=True)  # nine components: subspaces of unequal width
    want = _brute(rows)
    for name, value in (("ANCHORS", 4), ("TABLE", 3), ("STEP", 17), ("SAMPLE", 40)):
        monkeypatch.setattr(H, name, value)
    assert _run(spark, table, rows) == want


def test_ties_repeats_and_odd_rows(spark, table):
    rows = _rows(300, 6, seed=2, groups=True)
    rows += [rows[100]] * 2 + [rows[9]] * 40  # a repeated anchor, a repeated row
    rows += [(1000 + i, rows[3][1], i % 10, "t") for i in range(40)]  # equal vectors
    rows += [(None, rows[5][1], 3, "t"), (None, rows[100][1], 4, "t"), (2001, None, 1, "t"), (2002, [0.1] * 6, None, "t"), (2100, [0.1, None] + [0.1] * 4, 1, "t")]
    rows += [(2200, [float("nan")] * 6, 1, "t"), (2300, [float("inf")] * 6, 2, "t"), (2400, [], 3, "t"), (2500, [0.3, 0.2], 4, "t"), (-300, [0.2] * 6, 4, "t"), (2600, [0.0] * 6, 4, "t")]
    assert _run(spark, table, rows) == _brute(rows)


def test_anchor_alone_and_empty(spark, table):
    assert _run(spark, table, [(100, [0.5, 0.5], 1, "s"), (101, [0.2, 0.2], 2, "s")]) == []
    assert _run(spark, table, []) == []
    assert _run(spark, table, [(100, None, 1, "s")]) == []


def test_large_components(spark, table):
    rows = [(i, [x * 1e6 for x in v], k, s) for i, v, k, s in _rows(220, 8, seed=6, groups=True)]
    assert _run(spark, table, rows) == _brute(rows)  # beyond what doubles sum exactly
    assert H.exact(np.array([[1e30, 1.0]]), np.array([[1e30, 1.0], ])) == [(1 << 63) - 1]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 32, (4000, 64)))
    book = H.Codebook.fit(x[:2000])
    codes, res = book.encode(x)
    q = x[:50]
    tables, slack = book.tables(q)
    near = sum(t[codes[:, m]] for m, t in enumerate(tables))
    off = res[:, None] * np.linalg.norm(q, axis=1) + slack
    true = x @ q.T
    assert (np.abs(true - near) <= off).all()
    kth = np.sort(near - off, axis=0)[-6]
    assert ((near + off) >= kth).mean() < 0.2  # most rows need no exact score


def test_other_columns(spark, table):
    rows = [(*r[:3], 1.0, 2, 3) for r in _rows(250, 6, groups=True)]
    path = table("embeddings", rows, "vec_id long, embedding array<float>, label int, score double, rank int, anchor_id int")
    got = sorted((tuple(r) for r in H.op13_hard_negatives(spark, path).collect()), key=str)
    assert got == _brute([(i, [float(np.float32(c)) for c in x], k) for i, x, k, *_ in rows])
