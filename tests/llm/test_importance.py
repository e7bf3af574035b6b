import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textquarry.llm import importance as I
from tests.llm.conftest import DOCS, words

KEYS = ["doc_id", "n_features", "weight", "score", "rank"]


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _features(text):
    w = _words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _bucket(f):
    return zlib.crc32(f.encode()) % 10000


def _brute(docs, bench):
    s, t = (Counter(_bucket(f) for x in texts for f in _features(x)) for texts in ([d[1] for d in docs], bench))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text, *_ in docs:
        f = _features(text)
        weight = sum(gain(_bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(text)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def _docs(n=120, seed=1):
    rng = random.Random(seed)
    rows = [(i * 3, " ".join(words(rng, rng.randrange(0, 90), 300)), "en", "s", 0) for i in range(n)]
    odd = [None, "", " \n ", "one", "A" * 5, "ÀB c\x00d-e f_g 7", "日本 語x,Y", "it's 3.14 \U0001f600a " * 9, rows[5][1], rows[5][1].upper(), rows[7][1].replace(" ", "  ,")]
    return rows + [(1000 + k, t, "en", None, None) for k, t in enumerate(odd)]


def _run(spark, table, docs, bench, schema=DOCS):
    table("benchmark", list(enumerate(bench)), "item_id long, text string")
    path = table("documents", docs, schema)
    out = I.op12_importance(spark, path)
    assert out.columns == KEYS and all(t == "bigint" for _, t in out.dtypes)
    return sorted((tuple(r) for r in out.collect()), key=str)


BENCH = ["w1 w2 w3 w4 W5", None, "", "w10 w11. w10 w11 日本", "w1 w2"]


def test_brute_force(spark, table):
    docs = _docs()
    got = _run(spark, table, docs, BENCH)
    assert got == _brute(docs, BENCH) and sum(r[4] is not None for r in got) > 10


def test_repeats_null_ids_and_hot_copies(spark, table):
    docs = _docs(60) + [(9, "w1 w2 " * 20, "en", "s", 0)] * 70 + [(None, "w3 w4 " * 15, "en", "s", 0), (None, None, None, None, None)]
    got, want = _run(spark, table, docs, BENCH), _brute(docs, BENCH)
    assert got == want


def test_empty_tables(spark, table):
    assert _run(spark, table, [], BENCH) == []
    docs = _docs(30)
    assert _run(spark, table, docs, []) == _brute(docs, [])


def test_other_columns(spark, table):
    docs = [(i, t, "x", 5, [1.0], 2) for i, t, *_ in _docs(40)]
    assert _run(spark, table, docs, BENCH, "doc_id int, text string, rank string, score int, buckets array<double>, n_words int") == _brute(docs, BENCH)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_steps_and_forgotten_words(monkeypatch, longest):
    rng = random.Random(3)
    texts = [" ".join(words(rng, n, 50)).encode() for n in (0, 1, 2, 700, 30, 5)]
    whole, counts = I.Hasher(longest).of(texts)
    monkeypatch.setattr(I, "KNOWN", 5)
    small, same = I.Hasher(longest).of(texts, run=7, step=11)
    assert counts == same == [0, 1, 2, 700, 30, 5]
    for t, a, b in zip(texts, whole, small, strict=True):
        w = t.decode().split()
        want = [_bucket(" ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        assert sorted(a) == sorted(b) == sorted(want)


def test_one_hash_for_a_distinct_tuple(monkeypatch):
    seen = []
    real = zlib.crc32
    monkeypatch.setattr(I.zlib, "crc32", lambda data, value=0: seen.append((data, value)) or real(data, value))
    I.Hasher().of([b"a b a b a b c"] * 50)
    grams = [x for x in seen if x[0] != b" " and x[1]]
    assert len(grams) == len(set(grams)) == 3  # a b, b a, b c


def test_very_long_text():
    text = ("word%d " * 7 % tuple(range(7))).encode() * 400_000
    found, counts = I.Hasher().of([text, b"x"])
    assert counts == [2_800_000, 1] and len(found[0]) == 2 * 2_800_000 - 1
    assert len(np.unique(found[0])) <= 14
