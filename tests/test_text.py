import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import segment as S
from textquarry.operators import splitters as W


def _column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    titles = [
        "Aviso 12/2026, de 3 de março", "Decreto-Lei 1/2026 de 40 de maio", "Anúncio de 5 de Março", "Despacho n.º 15-C/2026, de 1 de Foo", "Lei 7/2025 de 2 de MARCO", "", None, "  ",
    ]
    got = [tuple(x) for x in _column(spark, titles, T.parse_title)]
    assert got == [
        ("Aviso", "12/2026", "2026-03-03"), ("Decreto-Lei", "1/2026", "2026-05-40"), ("Anúncio", "", ""), ("Despacho", "15-C/2026", ""), ("Lei", "7/2025", "2025-03-02"),
        ("?", "", ""), ("?", "", ""), ("?", "", ""),
    ]


def test_strip_and_collapse(spark):
    texts = [" a b \x85", "\x1c x \x1f", "", "a\n\n b\t", "​a"]
    assert _column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert _column(spark, texts, T.collapse) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_summary_entity_citations(spark):
    t = "Sumário: \n  Um  texto breve... \nEntidade Adjudicante:  Câmara  X\nNos termos da Lei n.º 27/2006, do DESPACHO 3-B/2020 e da portaria 1/2001; Decreto-Lei n.º 27/2006."
    row = spark.range(1).select(F.lit(t).alias("t"), F.lit("1/2001").alias("n"))
    fm = row.select(T.frontmatter(F.lit("Lei"), F.col("n"), F.lit(""), F.col("t")).alias("f")).first().f
    assert fm.sumario == "Um texto breve..." and fm.entidade == "Câmara X"
    assert row.select(T.citations(F.col("t"), F.col("n")).alias("c")).first().c == ["27/2006", "3-B/2020"]
    assert row.select(T.question_summary(F.col("t")).alias("s")).first().s == "Um texto breve"
    assert row.select(T.summary(F.lit("x" * 500 + "Sumário: tarde")).alias("s")).first().s is None


def test_enriched_leaves_out_empty_parts(spark):
    fm = T.frontmatter(F.lit("Lei"), F.lit(""), F.lit(""), F.lit("corpo"))
    assert spark.range(1).select(T.enriched(fm, F.lit("corpo")).alias("e")).first().e == "Tipo: Lei\n\ncorpo"


def test_point_id_and_tokens(spark):
    values = ["a::0", "é::1", ""]
    assert _column(spark, values, T.point_id) == [int(hashlib.md5(v.encode()).hexdigest()[:15], 16) for v in values]
    assert _column(spark, ["", "abc", "a" * 9], T.token_estimate) == [1, 1, 2]


@pytest.mark.parametrize(
    ("answer", "scores"),
    [
        ('{"fidelidade": 1, "relevancia": 0.5, "correcao": 0}', (1.0, 0.5, 0.0)),
        ('claro: ```json\n{"fidelidade": 0.1, "relevancia": 0.2, "correcao": 0.3}\n``` fim', (0.1, 0.2, 0.3)),
        ('{"fidelidade": 1, "relevancia": 0.5}', None),
        ('{"fidelidade": "x", "relevancia": 0.5, "correcao": 1}', None),
        ("nada", None),
        ('{"fidelidade": 1} e {"relevancia": 1}', None),
    ],
)
def test_judge_scores(spark, answer, scores):
    got = spark.range(1).select(T.judge_scores(F.lit(answer)).alias("s")).first().s
    assert (tuple(got) if got else None) == scores


def test_reasoning_is_a_fallback(spark):
    got = spark.range(1).select(T.judge_scores(F.lit(""), F.lit('{"fidelidade": 1, "relevancia": 1, "correcao": 1}')).alias("s")).first().s
    assert tuple(got) == (1.0, 1.0, 1.0)


ARTICLE = re.compile(T.RE_ARTICLE, re.IGNORECASE)


def _articulated(t):
    n = [int(m.group(1)) for m in ARTICLE.finditer(t)]
    return len(n) >= 2 and n[0] <= 2 and sum(b - a in (0, 1) for a, b in zip(n, n[1:])) / (len(n) - 1) >= 0.6


def _expected(t):
    """Segments by the rules, one text at a time."""
    if _articulated(t):
        at = [(m.start(), m.group(1)) for m in ARTICLE.finditer(t)]
        cuts = [(0, None)] + at if at[0][0] else at
        ends = [a for a, _ in cuts[1:]] + [len(t)]
        parts = [(t[a:b].strip(), "preambulo" if n is None else f"Artigo {n}", "artigo") for (a, n), b in zip(cuts, ends)]
        return [p for p in parts if len(p[0]) >= 40]
    if len(t) <= 8000:
        return [(t, "documento", "bloco")]
    return [(t[o : o + 4000].strip(), f"janela@{o}", "janela") for o in range(0, len(t), 3600) if t[o : o + 4000].strip()]


def test_segments(spark):
    rng = random.Random(3)
    texts = ["", "curto", "x" * 8000, "y" * 8001, "z " * 9000, " " * 8100, "Artigo 1\n\nArtigo 2\nx", "Artigo 3.º a\nArtigo 4.º b"]
    for _ in range(60):
        n, t = 0, "Preâmbulo " * rng.randrange(0, 8)
        for _ in range(rng.randrange(0, 8)):
            n += rng.choice([0, 1, 1, 1, 3])
            t += "\n" + rng.choice(["Artigo {}.º\n", "## Art. {} - A\n", "**ARTIGO {}º\n", "  artigo {}\n"]).format(n) + "palavra " * rng.randrange(0, 12)
        texts.append(t)
    got = _column(spark, texts, S.segments)
    assert [[tuple(s) for s in x] for x in got] == [_expected(t) for t in texts]
    assert sum(x[0][2] == "artigo" for x in got if x) > 10


def test_sections(spark):
    got = _column(spark, ["1 - OBJETO\n2 – PRAZO DE\n2.1 - SUB TEMA\nx 3 - NADA", ""], T.section_headings)
    assert got == [["1", "2"], []]


def test_splitters():
    rng = random.Random(5)
    text = "\n\n".join(". ".join(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))) for _ in range(30))
    for size, overlap in ((200, 40), (50, 0), (1000, 200)):
        pieces = W.recursive_pieces(text, size, overlap)
        assert all(0 < len(p) <= size for p in pieces)
        assert {w.strip(".") for w in text.split()} == {w.strip(".") for p in pieces for w in p.split()} - {""}
    runs = W.sentence_pieces(text, size=100, overlap=20)
    # Each sentence is rounded down by itself, so a run may be a few tokens longer.
    assert all(len(p) // 4 <= 120 for p in runs) and set(text.split()) == {w for p in runs for w in p.split()}
    assert W.recursive_pieces("") == [] and W.sentence_pieces("") == []


def test_fingerprint_ignores_order():
    assert T.fingerprint({"a": 1, "b": "ç"}) == T.fingerprint({"b": "ç", "a": 1}) and len(T.fingerprint({})) == 16


def test_no_python_in_scalar_plans(spark):
    rows = spark.createDataFrame([("Artigo 1 x", "Lei 1/2020")], "t string, n string")
    plan = rows.select(S.segments(F.col("t")), T.parse_title(F.col("n")), T.judge_scores(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counters(spark):
    import os

    import pytest

    from textquarry.operators.tokens import counter

    rows = spark.createDataFrame([(1, "Olá mundo, isto é um texto."), (2, ""), (3, None)], "doc_id long, texto string")
    count, name = counter()
    assert [r.n for r in rows.select(count(F.col("texto")).alias("n")).collect()] == [6, 1, 1] and name == "chars/4"
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no vocabulary file here")
    count, name = counter(ranks)
    got = [r.n for r in rows.select(count(F.col("texto")).alias("n")).collect()]
    assert got[0] > 6 and got[1:] == [1, 1] and name == "bpe:byte_bpe_50k.tiktoken"
