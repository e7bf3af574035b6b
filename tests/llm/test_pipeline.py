import random
from collections import defaultdict

import corpus_pipeline
from textquarry.llm import mixing
from tests.llm.conftest import DOCS, words
from tests.llm.test_mixing import _targets
from tests.llm.test_ngram_join import brute, sets
from tests.llm.test_toxicity import RUDE


def _corpus():
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, 30, 10**6))) for i in range(5)]
    rows, labels, toxic, leaks, copies = [], [], set(), set(), []
    for i in range(260):
        w = words(rng, rng.randrange(40, 160), 10**5)
        kind = i % 10
        if kind in (0, 1, 2):
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
            toxic.add(i)
        elif kind == 3:
            w[10:10] = items[i % 5][1].split()
            leaks.add(i)
        elif kind == 4 and copies:
            w = copies[-1][1].split()
            w[5] = f"edit{i}"
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        if kind == 5:
            copies.append((i, rows[-1][1]))
        labels.append((i, 1, int(i in toxic)))
    return rows, labels, items, toxic, leaks


def test_stages_and_run(spark, table):
    rows, labels, items, toxic, leaks = _corpus()
    table("labels", labels, "doc_id long, quality int, toxic int")
    table("benchmark", items, "item_id long, text string")
    path = table("documents", rows, DOCS)
    docs, columns, seen = spark.read.parquet(f"{path}/documents.parquet"), [c.split()[0] for c in DOCS.split(", ")], []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, path).write.mode("overwrite").parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    ids = [{r.doc_id for r in s} for s in seen]
    assert len(ids[0] & toxic) <= 3 and len(set(range(260)) - toxic - ids[0]) <= 6
    groups = brute([(r.doc_id, r.text) for r in seen[0]])
    assert ids[1] == {c for _, c in groups.values()}
    bench = [sets(t) for _, t in items]
    assert ids[2] == {r.doc_id for r in seen[1] if not any(100 * len(b & sets(r.text)) >= 75 * len(b) for b in bench)}
    assert not ids[2] & leaks and ids[3] <= ids[2]
    size, got = defaultdict(int), defaultdict(int)
    for r in seen[2]:
        size[r.source] += len(r.text.split())
    for r in seen[3]:
        got[r.source] += len(r.text.split())
    goal = _targets(list(size.items()))
    assert all(abs(got[s] - goal[s]) <= 2 * mixing.BLOCK for s in size)
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, seen[3])) == sorted(map(key, seen[4]))
    slots = defaultdict(list)
    for r in seen[4]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(key, corpus_pipeline.run(spark, path).collect())) == sorted(map(key, seen[4]))


def test_empty(spark, table):
    table("labels", [], "doc_id long, quality int, toxic int")
    table("benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, table("documents", [], DOCS)).count() == 0


def test_odd_rows(spark, table):
    """Null, repeated and clashing ids, empty and very long texts, other columns."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, 80, 10**6)) for _ in range(4)]
    long = " ".join(words(rng, 60_000, 10**6))
    item = " ".join(words(rng, 30, 10**6))
    rows = [
        (1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, None), (2, ""), (2, " \n"), (3, long), (None, "x " + item + " y"), (4, item), (-5, texts[3]),
    ]
    rows = [(i, t, "en", "ab"[k % 2] if k % 5 else None, None, k, k) for k, (i, t) in enumerate(rows)]
    table("labels", [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    table("benchmark", [(1, item), (None, item), (2, None)], "item_id long, text string")
    out = corpus_pipeline.run(spark, table("documents", rows, DOCS + ", node int, size int"))
    assert out.columns == [*(c.split()[0] for c in DOCS.split(", ")), "node", "size", "shard", "slot"]
    got = out.collect()
    # One of each group, no benchmark item, nothing without words; the mix may draw rows more or less often.
    allowed = [{0, 1}, {2}, {4, 5}, {9}, {12}]
    assert got and all(any(r.node in g for g in allowed) for r in got)
    assert all(sum(any(r.node == n for r in got) for n in g) <= 1 for g in allowed)
    assert any(r.node == 9 for r in got) and all(r.n_chars == len(r.text) for r in got)
    where = {k: r[1] for k, r in enumerate(rows)}
    assert all(set(r.text.split()) <= set(where[r.node].split()) for r in got)
