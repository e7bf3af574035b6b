import random

from textquarry.llm import decontamination as D
from tests.llm.conftest import DOCS, words
from tests.llm.test_ngram_join import sets


def _tables(rng):
    items = [(i, " ".join(words(rng, rng.randrange(1, 60), 10_000))) for i in range(20)] + [(50, None), (51, ""), (52, "two words")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 400), 10_000)
        for _ in range(rng.randrange(0, 3)):
            t = (items[rng.randrange(20)][1]).split()
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = "changed"
            cut = t[rng.randrange(0, 6) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i, " ".join(w).title(), "en", "s", 0))
    return docs + [(90, None, None, None, None), (91, "", "", "", 0), (92, "Two  words", "en", "s", 9)], items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = _tables(random.Random(seed))
        a = spark.createDataFrame(docs, DOCS)
        b = spark.createDataFrame(items, "item_id long, text string")
        want = {}
        for d in docs:
            for i, t in items:
                x, y = sets(t), sets(d[1])
                if x and 100 * len(x & y) >= 75 * len(x):
                    want[(d[0], i)] = (len(x), len(x & y))
        assert len(want) > 5
        assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in D.contained(a, b).collect()} == want
        blocks = D.candidates(a, b, broadcast_rows=40)  # several blocks of the sketch
        assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= set(want)
        for how in ({"copies": 0}, {"copies": 2, "broadcast_rows": 40}, {"broadcast_rows": 10, "most_blocks": 1}):  # by shingles, by a shuffled join
            assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in D.contained(a, b, **how).collect()} == want
        kept = {r.doc_id for r in a.join(D.contained(a, b), "doc_id", "left_anti").collect()}
        assert kept == {d[0] for d in docs} - {d for d, _ in want}


def test_edges(spark, table):
    docs = [(1, "a b c d e f", "en", "s", 1), (1, "x", "en", "s", 1), (1, "a b c d e f", "en", "s", 1)]
    table("benchmark", [(1, "a b c d e f")], "item_id long, text string")
    path = table("documents", docs, DOCS)
    assert [(r.doc_id, r.item_id, r.containment) for r in D.op4_decontamination(spark, path).collect()] == [(1, 1, 1.0)]
    assert D.stage(spark, spark.createDataFrame([(2, "A B C D E F", 1), (3, "z", 2)], "doc_id long, text string, hash int"), path).collect() == [(3, "z", 2)]
    table("benchmark", [], "item_id long, text string")
    assert D.op4_decontamination(spark, path).count() == 0
    assert D.op4_decontamination(spark, table("documents", [], DOCS)).count() == 0


def test_stage_by_text(spark, table):
    path = table("benchmark", [(1, "a b c d e f")], "item_id long, text string")
    docs = [(None, "x a b c d e f"), (None, "clean"), (None, None), (4, "a b c d e f y"), (4, "clean too")]
    out = D.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    assert {tuple(r) for r in out} == {(None, "clean"), (None, None), (4, "clean too")} and len(out) == 3


def test_null_ids_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000)) + " a b c d e f g " + " ".join(f"v{k}" for k in range(60_000))
    docs = spark.createDataFrame([(None, "x a b c d e f g"), (None, "clean"), (7, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c d e f g"), (None, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in D.contained(docs, items).collect()}
    assert got == {(None, 1): (3, 3), (7, 1): (3, 3)}


def test_a_document_that_holds_the_whole_benchmark(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(6, 40), 10_000))) for i in range(300)]
    whole = " ".join(t for _, t in items)
    docs = [(1, whole), (1, whole), (None, whole + " x"), (2, items[7][1]), (1, "other text of the same id " + items[3][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in D.contained(a, b).collect()}
    assert got == {(d, i): 1.0 for d in (1, None) for i in range(300)} | {(2, 7): 1.0}


def test_clashing_columns(spark, table):
    path = table("benchmark", [(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "k"), (2, "z", 6, "l")], "doc_id long, text string, item_id int, __key string")
    out = D.stage(spark, docs, path)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "z", 6, "l")]
