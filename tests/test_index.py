"""Stored indexes: parts and manifests, upserts against rebuilds, pages, cells."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import cells as X
from textquarry.operators import retrieve as R
from textquarry.operators import sparse
from textquarry.plans import conditions as P
from textquarry.plans.conditions import CONDITIONS, Index
from textquarry.sources.parts import Store

DOCS = "doc_id string, titulo string, texto string"


def _docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda i: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) + f" nos termos da Lei {(i * 7) % n}/2020"
    return [(f"d{i}", f"Lei {i}/2020, de 2 de maio", text(i)) for i in range(n)]


def _questions(spark, m=12):
    rng = random.Random(3)
    return spark.createDataFrame([(f"q{i}", " ".join(f"w{rng.randrange(70)}" for _ in range(6))) for i in range(m)], "query_id string, query string")


def _hits(cond, index, asked, **more):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_id, round(r.score, 6), r.method) for r in cond.hits(index, asked, **more).collect())


def test_store(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    root = f"file://{tmp_path}/s"
    empty = Store.open(spark, root)
    assert empty.version == 0 and not empty.tables
    one = empty.commit({"t": empty.stage("t", rows((1, "a"), (2, "b"), (2, "c")), "k")}, info={"x": 1})
    assert {r.v for r in one.read("t", [2]).collect()} == {"b", "c"} and one.read("t", [9]).count() == 0
    staged = one.stage("t", rows((2, "B")), "k")
    assert sorted(r.v for r in Store.open(spark, root).read("t").collect()) == ["a", "b", "c"]  # nothing is switched yet
    two = one.commit({"t": staged}, {"t": [2, 3]})
    assert sorted(r.v for r in two.read("t").collect()) == ["B", "a"] and Store.open(spark, root).version == 2 and two.info == {"x": 1}
    assert sorted(r.v for r in Store.open(spark, root, 1).read("t").collect()) == ["a", "b", "c"]
    with pytest.raises(RuntimeError, match="meanwhile"):
        one.commit({"t": one.stage("t", rows((1, "z")), "k")}, {"t": [1]})
    with pytest.raises(ValueError, match="replaced"):
        two.commit({"t": two.stage("t", rows((1, "z")), "k")}, {"t": [2]})
    (tmp_path / "s" / "manifest-0000000003.json").write_text('{"tables": {')  # a writer that died
    assert Store.open(spark, root).version == 2
    (tmp_path / "s" / "manifest-0000000003.json").unlink()
    two.vacuum()
    assert sorted(r.v for r in Store.open(spark, root).read("t").collect()) == ["B", "a"] and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("manifest")]) == 1
    gone = two.commit({"t": two.stage("t", rows((1, "z")).limit(0), "k")}, {"t": [1, 2]})
    assert gone.read("t").count() == 0


@pytest.mark.parametrize("name,cells", [("estrutural-enriquecido_grafo", False), ("estrutural-enriquecido_grafo", True), ("hibrido-denso", True)])
def test_upsert_finds_what_a_rebuild_would(spark, tmp_path, name, cells):
    cond, asked = CONDITIONS[name], _questions(spark)
    docs = _docs(40)
    index = cond.index(spark.createDataFrame(docs, DOCS), root=f"file://{tmp_path}/i", buckets=7, cells=cells)
    before = dict(index.store.tables["segments"])
    changed = [*docs]
    changed[5] = ("d5", "Lei 5/2020, de 2 de maio", "w1 w2 w3 w1 nos termos da Lei 9/2020")
    one = cond.upsert(index, spark.createDataFrame(changed, DOCS))
    after = one.store.tables["segments"]
    assert sum(before[p] != after[p] for p in before) == 1 and before.keys() == after.keys()  # a bucket is written anew
    assert _hits(cond, one, asked) == _hits(cond, cond.index(spark.createDataFrame(changed, DOCS), buckets=7, cells=cells), asked)
    more = [d for d in changed if d[0] not in ("d7", "d8")] + [("new", "Lei 99/2020", "w4 w4 w5 nos termos da Lei 1/2020"), ("long", "Lei 98/2020", "w6 " * 6000)]
    two = cond.upsert(Index.load(spark, f"file://{tmp_path}/i"), spark.createDataFrame(more[-2:], DOCS), spark.createDataFrame([("d7",), ("d8",), ("none",)], "doc_id string"))
    assert _hits(cond, two, asked) == _hits(cond, cond.index(spark.createDataFrame(more, DOCS), buckets=3), asked)
    again = cond.upsert(two, spark.createDataFrame(more, DOCS))
    assert again.store.version == two.store.version  # nothing has changed
    two.store.vacuum()
    assert _hits(cond, Index.load(spark, f"file://{tmp_path}/i"), asked) == _hits(cond, two, asked)


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    cond, asked = CONDITIONS["hibrido-esparso"], _questions(spark)
    index = cond.index(spark.createDataFrame(_docs(20), DOCS), root=f"file://{tmp_path}/i", buckets=3)
    want = _hits(cond, index, asked)
    monkeypatch.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        cond.upsert(index, spark.createDataFrame([("d1", "t", "w1 w1 w1 w2")], DOCS))
    assert _hits(cond, Index.load(spark, f"file://{tmp_path}/i"), asked) == want


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


@pytest.mark.parametrize("name", ["hibrido-esparso", "estrutural-enriquecido_grafo"])
def test_an_index_leaves_nothing_beside_its_parts(spark, tmp_path, name):
    """Neither shuffle files nor documents stay, and documents are dealt in passes."""
    cond, asked = CONDITIONS[name], _questions(spark)
    docs = spark.createDataFrame(_docs(60) + [("short", "Lei 70/2020", "w1"), ("none", None, None)], DOCS)
    before, was = {x for x in _shuffled(spark) if x.startswith("shuffle_")}, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    index = cond.index(docs, root=f"file://{tmp_path}/i", buckets=6)
    for _ in range(20):  # files go a little later
        left = {x for x in _shuffled(spark) if x.startswith("shuffle_")} - before
        if not left:
            break
        time.sleep(0.5)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    named = {f.split("/")[0] for t in index.store.tables.values() for f in t.values()}
    assert {p.name for p in (tmp_path / "i").iterdir() if p.is_dir()} == named and "documents" not in index.store.tables
    assert sorted(r.doc_id for r in index.store.read("marks").collect()) == sorted(r.doc_id for r in docs.collect())
    for t in ("segments", "marks", "lists"):
        for part in index.store.tables[t]:
            assert {r.bucket for r in index.store.read(t, [part]).select("bucket").distinct().collect()} == {int(part)}
    assert _hits(cond, index, asked) == _hits(cond, cond.index(docs, buckets=1), asked)


def test_an_older_index_is_read_and_upserted(spark, tmp_path):
    cond, asked, docs = CONDITIONS["hibrido-esparso"], _questions(spark), _docs(40)
    store = cond.index(spark.createDataFrame(docs, DOCS), root=f"file://{tmp_path}/i", buckets=5).store
    marks = store.read("marks").withColumn("ranges", F.array(F.lit(1)))
    lists = store.read("lists").withColumn("sub", F.pmod(F.xxhash64("sub"), F.lit(1_000_003)).cast("int"))
    old = store.commit({"marks": store.stage("marks", marks, "bucket"), "lists": store.stage("lists", lists, "bucket")})
    docs[5] = ("d5", "Lei 5/2020, de 2 de maio", "w1 w2 w3 w1 nos termos da Lei 9/2020")
    new = cond.upsert(Index(old, old.info), spark.createDataFrame(docs, DOCS))
    assert new.store.read("marks").columns == ["doc_id", "bucket", "mark"]
    assert _hits(cond, new, asked) == _hits(cond, cond.index(spark.createDataFrame(docs, DOCS)), asked)
    assert [tuple(r) for page in new.pages(32) for r in page] == [tuple(r) for r in new.segments.select(*P.POINT).orderBy("point_id").collect()]


def test_parts_in_passes(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 9).cast("int").alias("k"), F.col("id").cast("string").alias("v"))
    store = Store.open(spark, f"file://{tmp_path}/s")
    staged = store.stage("t", rows, "k", ["v"], passes=4)
    assert sorted(staged.folders) == [str(i) for i in range(9)] and sorted(map(tuple, store.staged(staged).collect())) == sorted(map(tuple, rows.collect()))
    store.drop(staged)
    assert not list((tmp_path / "s").iterdir())


def test_shards_in_place(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 9)))) for i in range(300)], "doc_id string, texto string").coalesce(2)
    counts = sparse.term_counts(docs).withColumn("bucket", F.substring("doc_id", 2, 1).cast("int"))
    got = sparse.shards_in_place(counts, 35)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    heads = [r for r in rows if r.term is None]
    assert len({(r.bucket, r.sub) for r in heads}) == len(heads) and max(len(r.ids) for r in heads) == 35
    assert sorted(i for r in heads for i in r.ids) == [f"d{i:03}" for i in range(300)] and all(i[1] == str(r.bucket) for r in heads for i in r.ids)
    ids = {(r.bucket, r.sub): r.ids for r in heads}
    found = {(ids[r.bucket, r.sub][d], r.term): round(w, 9) for r in rows if r.term is not None for d, w in zip(r.docs, r.weights, strict=True)}
    assert found == {(r.doc_id, r.term): round(r.weight, 9) for r in sparse.postings(docs).collect()}


def test_pages(spark, tmp_path):
    cond = CONDITIONS["hibrido-esparso"]
    index = cond.index(spark.createDataFrame(_docs(90), DOCS), root=f"file://{tmp_path}/i", buckets=2)
    want = [tuple(r) for r in index.segments.select(*P.POINT).orderBy("point_id").collect()]
    first, token = index.page(n=20)
    later = cond.upsert(index, spark.createDataFrame([(f"n{i}", "t", "w1 w2") for i in range(30)], DOCS), spark.createDataFrame([("d3",)], "doc_id string"))
    rows = first
    while token:
        page, token = later.page(token, 20)  # of the version that the scan began with
        rows += page
    assert [tuple(r) for r in rows] == want
    fresh = [tuple(r) for page in later.pages(32) for r in page]
    assert fresh == [tuple(r) for r in later.segments.select(*P.POINT).orderBy("point_id").collect()] and len(fresh) == len(want) + 29
    last = (later.store.version, (50 << (60 - P.RANGE_BITS)) - 1, "")
    monkey = []
    real = Store.read
    Store.read = lambda self, name, parts=None: monkey.append(parts) or real(self, name, parts)
    try:
        later.page(last, 1000)
    finally:
        Store.read = real
    assert monkey and all(p[0] >= 49 for p in monkey)  # earlier ranges aren't read


def _exact(x, q, k):
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
    return {i: sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:k] for i in range(len(q))}


@pytest.mark.parametrize("groups", [True, False])
def test_cells(spark, tmp_path, groups):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(30, 16)) * (3 if groups else 0)
    x = middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    x[17], x[18] = x[16], 0
    q = x[::60] + rng.normal(size=(50, 16)) * 0.1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    cells = X.Cells.build(rows, f"file://{tmp_path}/c", n_cells=40)
    cells = X.Cells.open(spark, f"file://{tmp_path}/c")
    want = _exact(x, q, 5)
    got = {}
    for r in sorted(cells.search(asked).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want
    near = {}
    for r in cells.search(asked, recall=0.95).collect():
        near.setdefault(r.query_id, set()).add(r.doc_id)
    assert np.mean([len(near[i] & set(want[i])) / 5 for i in want]) >= 0.9
    assert cells.takes["0.9"] <= cells.takes["0.95"] <= cells.takes["0.99"] <= 40
    if groups:
        assert cells.takes["0.95"] <= 8  # so a query reads a fifth of the rows at most
    read = cells.search(asked.limit(1), probes=2)
    files = {f.split("__part=")[1].split("/")[0] for f in cells.store.read("vectors", list(np.argsort(-(X._unit(q[:1]) @ cells.centres.T)[0])[:2])).inputFiles()}
    assert len(files) == 2 and read.count() == 5
    assert cells.search(asked.limit(0)).count() == 0


def test_cells_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, vector array<double>")
    cells = X.Cells.build(rows, f"file://{tmp_path}/c")
    assert cells.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).count() == 0


def test_sparse_search_by_a_loop(spark, monkeypatch):
    import math

    rng = random.Random(5)
    words = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(1, 80))) for _ in range(400)]
    texts[30] = texts[31] = texts[32]
    asked = {i: " ".join(rng.choices(words, k=rng.choice([1, 3, 40]))) for i in range(30)} | {90: "none", 91: ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string")
    n, df = len(texts), {w: sum(w in t.split() for t in texts) for w in words}

    def score(q, t):
        t = t.split()
        return sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * sparse.weight(t.count(w), len(t)) for w in set(q.split()) if w in t)

    want = {}
    for q, text in asked.items():
        best = sorted(((round(score(text, t), 9), d) for d, t in enumerate(texts)), key=lambda x: (-x[0], x[1]))
        want |= {(q, i + 1): d for i, (s, d) in enumerate([b for b in best if b[0] > 0][:5])}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    run = lambda: {(r.query_id, r["rank"]): r.doc_id for r in R.bm25_topk(docs, queries, 5).collect()}
    assert run() == want
    for name, value in (("SHARD", 30), ("PAIRS", 40), ("SENT_TERMS", 10)):
        monkeypatch.setattr(sparse, name, value)
    assert run() == want


def test_queries_with_the_same_terms_are_answered_as_one(spark, monkeypatch):
    import math

    import pyarrow as pa

    rng = random.Random(8)
    common = ["urgente", "do", "cliente"]
    texts = [" ".join(rng.sample(common, rng.randrange(1, 4)) + [f"n{rng.randrange(150)}"] * rng.randrange(0, 3)) for _ in range(500)]
    asked = {i: f"do cliente urgente n{i}" for i in range(200)}
    n, words = len(texts), [t.split() for t in texts]
    df = {}
    for t in words:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    score = lambda q, t: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * sparse.weight(t.count(w), len(t)) for w in set(q.split()) if w in t)
    want = {}
    for q, text in asked.items():
        best = sorted(((round(score(text, t), 9), d) for d, t in enumerate(words)), key=lambda x: (-x[0], x[1]))
        want |= {(q, i + 1): d for i, (s, d) in enumerate([b for b in best if b[0] > 0][:12])}
    monkeypatch.setattr(sparse, "SHARD", 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    run = lambda: {(r.query_id, r["rank"]): r.doc_id for r in R.bm25_topk(docs, queries, 12).collect()}
    assert run() == want
    monkeypatch.setattr(sparse, "PAIRS", 300)
    assert run() == want
    # 200 queries, of which two have a term of their own in the shard.
    codes = np.array([[0, 1, 2, 3 + i] for i in range(200)]).ravel()
    all_ = sparse._Asked(list(range(200)), pa.array([*common, *(f"n{i}" for i in range(200))]), codes, np.ones(800), np.arange(0, 800, 4), np.zeros(200), 5)
    all_.shard(["do", "n7", "n9"], np.array([0, 3, 4, 5]), np.array([0, 1, 2, 1, 2]), np.array([1.0, 1.0, 1.0, 2.0, 2.0]), pa.array([10, 11, 12]))
    assert len(all_.groups) == 1 and sorted(all_.alone) == [7, 9] and all_.alone[7].best[0] == (3.0, 11)


def test_lists_are_skipped():
    """Minor terms and hopeless shards aren't read."""
    import pyarrow as pa

    lists = {"common": (range(1000), [1.0] * 1000), "one": ([1, 2], [2.0, 1.0]), "two": ([2, 7], [2.0, 1.5])}
    place, n = {t: i for i, t in enumerate(lists)}, np.cumsum([0] + [len(d) for d, _ in lists.values()])
    docs, weights, ids = np.concatenate([d for d, _ in lists.values()]), np.concatenate([w for _, w in lists.values()]), pa.array(range(1000))
    q = sparse._Query("q", [("one", 5.0), ("two", 5.0), ("common", 0.1)], 0.0, 1)
    assert q.search(place, n, docs, weights, ids) == 1004 and q.best == [(15.1, 2)]
    assert q.search(place, n, docs, weights * 0.7, ids) == 0  # 14.07 can't reach 15.1
    assert q.search(place, n, docs, weights, ids.take(pa.array(range(1000)))) == 1004
    q.need = 16.0
    assert q.search(place, n, docs, weights, ids) == 4  # 15 and 0.1 can't: the common term isn't read
    q.need = 20.05
    assert q.search(place, n, docs, weights, ids) in (2, 4) and q.best == [(15.1, 2)]
    few = sparse._Query("q", [("common", 1.0), ("none", 9.0)], 0.5, 3)
    assert few.search(place, n, docs, weights, ids) == 1000 and few.best == [(1.0, 0), (1.0, 1), (1.0, 2)]


def test_counts_within_a_row(spark):
    docs = spark.createDataFrame([(1, "B a b. c"), (2, None), (3, ""), (4, "a-a_a")], "doc_id long, texto string")
    got = {r.doc_id: (r.dl, dict(zip(r.terms, r.counts))) for r in sparse.term_counts(docs).collect()}
    assert got == {1: (4, {"a": 1, "b": 2, "c": 1}), 2: (0, {}), 3: (0, {}), 4: (3, {"a": 3})}
    got = {r.doc_id: (r.dl, dict(zip(r.terms, r.counts))) for r in sparse.term_counts(docs, stop=["c"], only=["b"]).collect()}
    assert got == {1: (3, {"b": 2}), 2: (0, {}), 3: (0, {}), 4: (3, {})}
    for df in (sparse.postings(docs), R.hash_embedding(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_stream_feeds_an_index(spark, tmp_path):
    import json

    from textquarry.streaming.ingest import stream_index

    cond, asked, folder = CONDITIONS["hibrido-esparso"], _questions(spark), tmp_path / "in"
    folder.mkdir()
    docs = _docs(12)
    batches = [docs[:8], [*docs[8:], ("d1", "Lei 1/2020", "w3 w3 w4")], [("d2", None, None), ("d5", "t", "w9 w9")]]
    state = {}
    for n, batch in enumerate(batches):
        lines = [{"doc_id": d, "titulo": t, "texto": x, "apagado": x is None} for d, t, x in batch]
        (folder / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
        stream_index(spark, str(folder), cond, f"file://{tmp_path}/i", f"{tmp_path}/check").awaitTermination()
        for d, t, x in batch:
            state.pop(d, None)
            if x is not None:
                state[d] = (d, t, x)
        index = Index.load(spark, f"file://{tmp_path}/i")
        assert _hits(cond, index, asked) == _hits(cond, cond.index(spark.createDataFrame(list(state.values()), DOCS)), asked)


def test_queries_with_rare_terms_of_their_own_are_answered_as_one(spark, monkeypatch):
    import math

    rng = random.Random(9)
    common = ["urgente", "do", "cliente", "lei"]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 6)) + [f"n{rng.randrange(400)}" for _ in range(rng.randrange(3))]) for _ in range(900)]
    asked = {i: f"do cliente urgente n{i} n{i + 1}" for i in range(250)} | {900: "n7 n8", 901: "n9"}
    n, words = len(texts), [t.split() for t in texts]
    df = {}
    for t in words:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    gain = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
    want = {}
    for q, text in asked.items():
        all_ = [(round(sum(gain(w) * sparse.weight(t.count(w), len(t)) for w in set(text.split()) if w in t), 9), d) for d, t in enumerate(words)]
        want |= {(q, i + 1): d for i, (s, d) in enumerate(sorted((x for x in all_ if x[0] > 0), key=lambda x: (-x[0], x[1]))[:7])}
    docs, queries = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string"), spark.createDataFrame(list(asked.items()), "query_id long, query string")
    run = lambda: {(r.query_id, r["rank"]): r.doc_id for r in R.bm25_topk(docs, queries, 7).collect()}
    monkeypatch.setattr(sparse, "SHARD", 300)
    for rare, groups, entries in ((20, 1, 8), (1 << 40, 256, 1 << 21)):
        for name, value in (("RARE", rare), ("GROUPS", groups), ("ENTRIES", entries)):
            monkeypatch.setattr(sparse, name, value)
        assert run() == want


def test_work_on_a_shard_does_not_grow_with_queries_that_differ_by_a_rare_term(monkeypatch):
    import pyarrow as pa

    m, n, calls = 300, 400, []
    lists = [(np.arange(n), np.full(n, 0.9))] * 2 + [(np.array([i]), np.array([1.1])) for i in range(m)]
    terms = ["do", "cliente"] + [f"n{i}" for i in range(m)]
    ends = np.concatenate(([0], np.cumsum([len(d) for d, _ in lists])))
    docs, weights = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
    codes = np.array([c for i in range(m) for c in (0, 1, 2 + i)])
    gain, rare = np.array([0.01, 0.01, 5.0] * m), np.array([False] * 2 + [True] * m)
    asked = sparse._Asked(list(range(m)), pa.array(terms), codes, gain, np.arange(0, 3 * m, 3), np.zeros(m), 3, rare)
    real = sparse._scored
    monkeypatch.setattr(sparse, "_scored", lambda *a: calls.append(1) or real(*a))
    asked.shard(terms, ends, docs, weights, pa.array(range(n)))
    assert not calls and not asked.alone and len(asked.groups) == 1
    best = {}
    for names, _, ids, score in asked.rows():
        for q, d, s in zip(names, list(ids), score, strict=True):
            best.setdefault(q, []).append((d.as_py() if hasattr(d, "as_py") else d, s))
    assert all(best[i][0][0] == i and round(best[i][0][1], 9) == 5.518 for i in range(m))


def test_tokens_of_a_batch(spark):
    """The bytes of Latin-1 texts are looked at together; the tokens are those of the column expression."""
    texts = ["", None, " ", "Ação É ª º µ ½ x² ÀÉÞ×÷ß ÿ", "aB9", "9", "...", "İstanbul ΑΒΓ straße", "日本 語 a1", "x\u0100.", "…", "a", "Z\x85z\xa0y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string")
    want = {r.doc_id: sorted(r.t or []) for r in docs.select("doc_id", sparse.tokens(F.col("texto")).alias("t")).collect()}
    got = {r.doc_id: sorted(t for t, c in zip(r.terms, r.counts) for _ in range(c)) for r in sparse.term_counts(docs.coalesce(1)).collect()}
    assert got == want
    plan = sparse.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "array_join" in plan  # no lists go to the workers


def test_an_index_without_points(spark):
    cond = CONDITIONS["hibrido-esparso"]
    docs = spark.createDataFrame(_docs(20), DOCS)
    whole, bare = cond.index(docs), cond.index(docs, points=False)
    assert "points" in whole.store.tables and "points" not in bare.store.tables
    assert _hits(cond, bare, _questions(spark)) == _hits(cond, whole, _questions(spark))
    more = spark.createDataFrame([("d3", "Lei 3/2020, de 2 de maio", "w1 w2 w3 outro")], DOCS)
    later = cond.upsert(bare, more)
    assert "points" not in later.store.tables
    assert _hits(cond, later, _questions(spark)) == _hits(cond, cond.upsert(whole, more), _questions(spark))
    with pytest.raises(ValueError, match="without points"):
        later.page()
