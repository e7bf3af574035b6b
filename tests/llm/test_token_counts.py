import os

import pytest

from textquarry.llm import token_counts as K
from tests.llm.conftest import DOCS

pytestmark = pytest.mark.skipif(not os.path.exists(K.RANKS), reason="no vocabulary file here")
TEXTS = ["Hello world, it's me.", "", None, "a" * 3000, "Olá ção\n\n\n  ß 123", "Hello world, it's me.", " " * 50]


def test_histogram_by_brute_force(spark, table):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 3)]
    out = {r.n_tokens: r for r in K.op7_token_counts(spark, table("documents", rows, DOCS)).collect()}
    enc = K.encoder(K.RANKS)
    lengths = [len(enc.encode_ordinary(r[1] or "")) for r in rows]
    assert set(out) == set(lengths)
    for n, r in out.items():
        assert r.n_docs == lengths.count(n) and r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.tokens_to == sum(x for x in lengths if x <= n) and r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_tokens and abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12


def test_limits(spark):
    lengths = [0, 1, 5, 5, 2000, 70000]
    hist = K.histogram(spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, n_tokens long"))
    limits = [0, 3, 5, 1024, 2000, 99999]
    got = {r.context_limit: (r.truncated_tokens, r.docs_longer) for r in K.at_limits(hist, limits).collect()}
    assert got == {x: (sum(min(x, y) for y in lengths), sum(y > x for y in lengths)) for x in limits}


def test_empty(spark, table):
    assert K.op7_token_counts(spark, table("documents", [], DOCS)).count() == 0


def test_pieces_of_long_texts():
    encode = K.encoder(K.RANKS).encode_ordinary
    for text in ("It's 12 a-b  c\n d's  " * 50, "x" * 500, "a b " * 99, " \n" * 60, "ß é" * 70):
        for step in (1, 7, 64):
            assert K.length(encode, text, step) == len(encode(text))
    assert K.length(encode, None) == K.length(encode, "") == 0


def test_other_columns(spark, table):
    path = table("documents", [(1, "Hello world", 9, "x"), (2, None, 8, "y")], "doc_id int, text string, n_tokens int, n_docs string")
    assert {r.n_tokens: r.n_docs for r in K.op7_token_counts(spark, path).collect()} == {0: 1, 2: 1}
