import random
from collections import defaultdict

import numpy as np
import pytest

from textquarry.llm import mixing as M
from tests.llm.conftest import DOCS


def _rows(n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"{i}-{k}" for k in range(rng.randrange(0, 400))), "en", rng.choice(["a", "a", "a", "b", "c", "Z", None]), 0) for i in range(n)]
    return rows + [(900, None, "en", "a", None), (901, " \n ", "en", "b", 3), (907, "same same", "en", "c", 9), (907, "same same", "en", "c", 9)]


def _targets(sizes, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    """Words wanted of each source: by weight, none above most times its size.

    The excess over a stop is shared by weight among the rest until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out = {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets_fill_by_weight(spark):
    for sizes in ([("a", 100), ("b", 100), ("c", 100), (None, 1000)], [], [("a", 0), (None, 0)], [(f"s{i}", i * i) for i in range(40)]):
        want = _targets(sizes)
        assert not sizes or abs(sum(want.values()) - 1.5 * sum(n for _, n in sizes)) < 1e-6 and all(want[s] <= 2 * n + 1e-9 for s, n in sizes)
        rows = spark.createDataFrame([(s, "" if s is None else "=" + s, n) for s, n in sizes], "source string, source_key string, size long")
        got = {r.source: r.target for r in M.targets(rows).collect()}
        assert got == {s: pytest.approx(x, abs=1e-6) for s, x in want.items()}


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            assert sorted(M.permute(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


@pytest.mark.parametrize("k", [0, 1, 5, 900, 5000, 200_000])
def test_drawn_counts(k):
    for n in (1, 7, 100):
        shards, counts, before = M.drawn_counts(3, k, n, 0, n)
        assert counts.sum() == k and (counts > 0).all() and (np.diff(shards) > 0).all() and (before == np.cumsum(counts) - counts).all()
        # A task that draws some shards draws the same.
        parts = [M.drawn_counts(3, k, n, lo, min(n, lo + 3)) for lo in range(0, n, 3)]
        for whole, some in zip((shards, counts, before), zip(*parts, strict=True), strict=True):
            assert np.concatenate(some).tolist() == whole.tolist()
    other = M.drawn_counts(4, k, 100, 0, 100)
    assert k < 900 or other[1].tolist() != counts.tolist()
    if k >= 5000:  # counts spread as multinomial ones do
        assert 0.6 < counts.std() / (k / 100 * 0.99) ** 0.5 < 1.5


def test_counts_are_multinomial():
    """Of many sources the counts of a shard have the mean and the variance of the law, by halves and one by one alike."""
    for k in (40, 3000):
        x = np.zeros((400, 8))
        for source in range(400):
            shards, counts, _ = M.drawn_counts(source, k, 8, 0, 8)
            x[source, shards] = counts
        assert abs(x.mean() - k / 8) < 1e-9 and (abs(x.mean(axis=0) - k / 8) < 4 * (k / 8 * 7 / 8 / 400) ** 0.5).all()
        assert 0.8 < x.var(axis=0).mean() / (k / 8 * 7 / 8) < 1.2
        assert abs(np.corrcoef(x[:, 0], x[:, 5])[0, 1] + 1 / 7) < 0.2


@pytest.mark.parametrize("run", [1 << 19, 30])
def test_contract(spark, table, monkeypatch, run):
    monkeypatch.setattr(M, "RUN", run)  # so that a source is drawn in several rows
    monkeypatch.setattr(M, "SHARD_SLOTS", 50)
    rows = _rows()
    path = table("documents", rows, DOCS)
    out = M.op5_mixing(spark, path).collect()
    again = M.op5_mixing(spark, path).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    for r in out:
        assert r.source_size == size[r.source]
    goal = _targets(list(size.items()))
    for s in size:
        assert abs(target[s] - goal[s]) < 1e-6 and abs(taken[s] - goal[s]) <= 2 * M.BLOCK


def test_taken_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_SLOTS", 20)
    docs = spark.createDataFrame(_rows(120), DOCS)
    stream, picks = M.mix(docs, block=16)
    stream, picks = stream.collect(), picks.collect()
    for source in {r.source_no for r in stream}:
        own = sorted((r.start, r["size"]) for r in stream if r.source_no == source and r["size"])
        total = sum(n for _, n in own)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        n = -(-total // 16)
        drawn = {(p.pass_no, p.block) for p in picks if p.source_no == source}
        slots = {(p.pass_no, p.block): (p.shard, p.shard_slot) for p in picks if p.source_no == source}
        assert len(set(slots.values())) == len(drawn)
        k = len(drawn)
        assert len([1 for e, _ in drawn if e == 0]) == min(k, n)
        expect = sum(min(total, (b + 1) * 16) - b * 16 for _, b in drawn)
        assert expect == sum(p.n_words for p in picks if p.source_no == source)


def test_stage_words(spark):
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "x") for r in _rows(150)], DOCS + ", start string")
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    text = {r[0]: r[1] for r in _rows(150)}
    _, picks = M.mix(docs)
    assert sum(len(r.text.split()) for r in got) == sum(p.n_words for p in picks.collect())
    for r in got:
        assert r.n_chars == len(r.text)
        if len(r.text.split()) == len(text[r.doc_id].split()):
            assert r.text == text[r.doc_id]
        else:
            assert set(r.text.split()) <= set(text[r.doc_id].split())


def test_gaps_of_cut_texts_stay(spark):
    rows = [(i, "".join(f"{i}-{k}" + ("\n\n" if k % 9 == 0 else " \t" if k % 5 == 0 else " ") for k in range(300)), "en", "ab"[i % 2], 0) for i in range(40)]
    rows.append((99, "c " * 4000, "en", "c", 0))  # its excess makes others be drawn in part
    text = {r[0]: r[1] for r in rows}
    cut = [r for r in M.stage(spark, spark.createDataFrame(rows, DOCS), "").collect() if r.text != text[r.doc_id]]
    assert cut
    for r in cut:
        if r.doc_id == 99:
            continue
        words = r.text.split()
        at = 0
        for word, after in zip(words, words[1:], strict=False):
            at = r.text.index(word, at) + len(word)
            gap = r.text[at : r.text.index(after, at)]
            k = int(word.split("-")[1])
            assert gap == ("\n\n" if k % 9 == 0 else " \t" if k % 5 == 0 else " ")


def test_stage_keeps_null_ids(spark):
    rows = [(None if k % 2 else r[0], *r[1:4], k) for k, r in enumerate(_rows(80))] + [(None, "twin " * 90, "en", "s0", -1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    _, picks = M.mix(docs)
    got = M.stage(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in got) == sum(p.n_words for p in picks.collect())
    text = {(r[0], r[3], t) for r in rows if r[1] for t in r[1].split()}
    assert any(r.doc_id is None for r in got) and all((r.doc_id, r.source, t) in text for r in got for t in r.text.split())


def test_empty(spark, table):
    assert M.op5_mixing(spark, table("documents", [], DOCS)).count() == 0
    assert M.op5_mixing(spark, table("documents", [(1, None, None, None, None)], DOCS)).collect()[0].taken == 0
