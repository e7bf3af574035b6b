import random

import numpy as np

from textquarry.llm import ngram_join as J
from textquarry.llm.components import components
from tests.llm.conftest import DOCS, near_copies


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    comp = {i: i for i in own}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(own[i]), root(i)) for i in ids}


def test_against_brute_force(spark, table):
    for seed in (1, 2):
        rows = near_copies(seed)
        out = J.op3_ngram_join(spark, table("documents", rows, DOCS)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute([(r[0], r[1]) for r in rows])


def test_chains_and_large_groups(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(i, " ".join(base[: 100 - i % 3] + [f"n{i}"])) for i in range(150)]  # one group of near copies
    walk = [f"v{k}" for k in range(100)]
    for i in range(20):  # a chain: ends have little in common
        rows.append((1000 + i, " ".join(walk[i * 3 : i * 3 + 60] + [f"u{k}" for k in range(max(0, i * 3 - 40))])))
    got = {r.node: (r.n_shingles, r.component) for r in J.groups(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_ids_nulls_empty(spark, table):
    text, other = "a b c d e f g", "h i j k l m n o"
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (None, text, "en", "s", 1), (9, text.upper(), "en", "s", 1), (7, None, None, None, None)]
    rows += [(9, other, "en", "s", 1), (None, other + " p q", "en", "s", 1), (-3, "only one", "en", "s", 1), (None, "quite alone here", "en", "s", 1)]
    none = -99
    out = sorted((none if r.doc_id is None else r.doc_id, r.n_shingles, none if r.component_id is None else r.component_id) for r in J.op3_ngram_join(spark, table("documents", rows, DOCS)).collect())
    # other has 4 shingles, its longer form 6: 4 / 6 is no link.
    assert out == sorted([(none, 1, none), (none, 3, 5), (none, 6, none), (-3, 1, -3), (5, 3, 5), (5, 3, 5), (7, 0, 7), (9, 3, 5), (9, 4, 9)])
    assert J.op3_ngram_join(spark, table("documents", [], DOCS)).count() == 0


def test_stage_with_odd_ids_and_clashing_columns(spark):
    text, other = "a b c d e f g", "h i j k l m n o"
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (5, other, 4), (None, other, 5), (None, "x y", 6), (None, None, 7), (None, None, 8)]
    out = J.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, node int"), "")
    assert out.columns == ["doc_id", "text", "node"]
    got = {r.node for r in out.collect()}
    assert len(got & {2, 3}) == 1 and got - {2, 3} == {4, 6, 7, 8}


def test_small_packs_and_hot_hashes(spark, monkeypatch):
    """Coarse ranges parted once more, packs and pieces of a few hashes, a passage in every document."""
    for name, n in (("PACK", 40), ("BUCKET", 15), ("PIECE", 7), ("FAN", 4), ("STEP", 30)):
        monkeypatch.setattr(J, name, n)
    rng = random.Random(6)
    hot = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join(hot + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((4, 5, 60)))])) for i in range(60)]
    df = spark.createDataFrame(rows, "node long, text string").repartition(3)
    meta = {r.node: (r.n, r.hits) for r in J.sieve(df).collect()}
    fronts = {}
    for i, t in rows:
        s, n = J.shingle_sets([t])
        fronts[i] = set(s[: int(n[0]) - int(J._need(n)[0]) + int(J._asked(n)[0])].tolist())
    want = {i: sum(any(h in fronts[j] for j in fronts if j != i) for h in f) for i, f in fronts.items()}
    assert {i: h for i, (_, h) in meta.items()} == want
    got = {r.node: (r.n_shingles, r.component) for r in J.groups(df).collect()}
    assert got == brute(rows)


def test_stage_keeps_one_of_each(spark):
    rows = near_copies(3)
    out = J.stage(spark, spark.createDataFrame(rows, DOCS), "")
    want = {c for _, c in brute([(r[0], r[1]) for r in rows]).values()}
    assert {r.doc_id for r in out.collect()} == want and out.columns == [x.split()[0] for x in DOCS.split(", ")]


def test_linked_filters():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 80, n))
        b = np.unique(np.concatenate((rng.choice(a, max(1, int(len(a) * rng.random()))), rng.integers(0, 80, int(rng.integers(0, 20))))))
        extra_a, extra_b = int(rng.integers(0, 4)), int(rng.integers(0, 4))
        na, nb = len(a) + extra_a, len(b) + extra_b
        c = len(np.intersect1d(a, b))
        assert J.linked(a, na, b, nb) == (100 * c >= 75 * (na + nb - c))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {x: c for x, c in comp.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_steps_within_a_text():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef gh i\tj k\n".split(" ")) for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 50, 400)] + [None, "", " \n", "one  two\tthree", "x" * 90]
    whole = J.shingle_sets(texts)
    for step in (1, 3, 10, 64):
        some = J.shingle_sets(texts, step=step)
        assert (whole[0] == some[0]).all() and (whole[1] == some[1]).all()


def test_a_text_of_fifty_megabytes(monkeypatch):
    """Only a step's words are at hand: peak memory beside the text stays near that of its shingles."""
    import tracemalloc

    text = " ".join(f"w{i % 5000}" for i in range(9_000_000))
    assert len(text) > 50_000_000
    monkeypatch.setattr(J, "_known", type(J._known)())
    tracemalloc.start()
    s, n = J.shingle_sets([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[0] == len(s) == 5000 and peak < 3 * len(text)
