import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import context as C
from textquarry.operators import metrics as M
from textquarry.operators import overlap as O
from textquarry.operators import questions as Q
from textquarry.operators import retrieve as R
from textquarry.plans import runner
from textquarry.plans.conditions import CONDITIONS


def test_bm25_by_hand(spark):
    docs = {1: "gato preto gato", 2: "cão preto", 3: "ave", 4: ""}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, texto string")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25_topk(rows, spark.createDataFrame([(9, "GATO, preto preto")], "query_id long, query string"), 5).collect()}
    idf = lambda n: math.log(1 + (4 - n + 0.5) / (n + 0.5))
    w = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 256))
    assert got == {(9, 1): pytest.approx(w(2, 3) * idf(1) + w(1, 3) * idf(2)), (9, 2): pytest.approx(w(1, 2) * idf(2))}


def test_dense_by_numpy(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    x[5], x[6] = x[4], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id long, vector array<double>").repartition(5)
    got = R.dense_topk(rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>"), 6).collect()
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
    for i in range(7):
        want = sorted(range(300), key=lambda j: (-round(s[i, j], 9), j))[:6]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_dense_without_queries(spark):
    rows = spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<double>")
    assert R.dense_topk(rows, rows.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_dense_rows_and_queries_that_are_alike(spark, monkeypatch, alike):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(12, 6))[rng.integers(0, 12, 900)], rng.normal(size=(5, 6))[rng.integers(0, 5, 40)]
    monkeypatch.setattr(R, "SCORES", 50)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rows = spark.createDataFrame([(f"{i}::0", v.tolist()) for i, v in enumerate(x)], "doc_id string, vector array<double>").repartition(3)
    got = R.dense_topk(rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>"), 7, alike=alike).collect()
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    for i in range(40):
        want = [f"{j}::0" for j in sorted(range(900), key=lambda j: (-round(s[i, j], 9), f"{j}::0"))[:7]]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_a_dense_task_holds_little():
    """Many rows of one score leave k of a query, whatever their number."""
    import pyarrow as pa

    best = R._Best(2, 3)
    best.most = 100
    for at in range(0, 1000, 10):
        best.take(np.ones((2, 10)), pa.array(range(at, at + 10)), np.arange(10), np.ones(10, dtype=np.int64))
        assert best.size <= 120
    assert best.settle()["id"].to_pylist() == [0, 1, 2, 0, 1, 2]


def test_fusion(spark):
    schema = "query_id long, doc_id long, rank int"
    a, b = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema), spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    got = [(r.doc_id, round(r.score, 6)) for r in R.rrf([a, b]).orderBy("rank").collect()]
    assert got == [(11, round(1 / 2 + 1 / 3, 6)), (10, 0.5), (12, round(1 / 3, 6))]


def test_expansion_against_a_loop(spark):
    rng = random.Random(2)
    cites = {d: sorted({f"{rng.randrange(40)}/20" for _ in range(rng.randrange(5))}) for d in range(40)}
    index = {f"{d}/20": d for d in range(0, 40, 2)}
    hits = {q: rng.sample(range(40), 5) for q in range(30)}
    want = {}
    for q, own in hits.items():
        new = []
        for d in own:
            for n in cites[d]:
                t = index.get(n)
                if t is not None and t not in own and t not in new and len(new) < 3:
                    new.append(t)
        for i, t in enumerate(new):
            want[(q, i + 1)] = t
    h = spark.createDataFrame([(q, i + 1, d) for q, own in hits.items() for i, d in enumerate(own)], "query_id long, rank int, doc_id long")
    e = R.citation_edges(spark.createDataFrame(list(cites.items()), "doc_id long, citacoes array<string>"))
    x = R.number_index(spark.createDataFrame([(d, f"{d}/20" if d % 2 == 0 else "") for d in range(40)], "doc_id long, numero string"))
    extra = R.expand(h, e, x)
    assert {(r.query_id, r.i): r.target for r in extra.collect()} == want
    whole = R.with_expansion(h.withColumn("score", F.lit(1.0)), extra)
    assert whole.where("method = 'grafo_expansao'").count() == len(want) and whole.agg(F.max("rank")).first()[0] <= 8


def test_budget_skips_and_goes_on(spark):
    sizes = [2000, 3000, 2500, 900, 100, 50]
    rows = spark.createDataFrame([(1, i + 1, n, f"b{i}") for i, n in enumerate(sizes)], "query_id long, rank int, tokens int, texto string")
    r = C.packed(rows).first()
    assert (r.tokens, r.n_used, r.prompt_ranks, r.reported_ranks, r.context) == (6000, 4, [1, 2, 4, 5], [1, 2, 3, 4], "b0\n\nb1\n\nb3\n\nb4")


def _measure(hits, targets, k=5):
    u = list(dict.fromkeys(x for x in hits if x))[:k]
    t = set(targets)
    rel = [float(x in t) for x in u]
    n = sum(rel)
    dcg = sum(x / math.log2(i + 2) for i, x in enumerate(rel))
    ideal = sum(1 / math.log2(i + 2) for i in range(int(n)))
    return n / max(1, len(u)), len(t & set(u)) / len(t), next((1 / (i + 1) for i, x in enumerate(rel) if x), 0.0), dcg / ideal if n else 0.0, float(n > 0)


def test_measures_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), [rng.choice(["", None, *"pqrstuvw"]) for _ in range(rng.randrange(9))], rng.choices("pqrst", k=rng.randrange(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, tipo string, hits array<string>, targets array<string>")
    got = {r.query_id: tuple(r[m] for m in M.METRICS) for r in M.per_query(df).collect()}
    want = {i: _measure(h, t) for i, _, h, t in rows if t}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
    table = {r.estrato: r for r in M.aggregate(M.per_query(df), "tipo").collect()}
    assert set(table) == {"total", "tipo=a", "tipo=b", "tipo=?"} and table["total"].n == len(want)
    assert table["total"].recall == pytest.approx(sum(w[1] for w in want.values()) / len(want), abs=1e-6)


def test_bootstrap():
    assert M.bootstrap([]) == (0.0, 0.0) and M.bootstrap([0.33333333]) == (0.3333, 0.3333)
    low, high = M.bootstrap([0.0, 1.0] * 20)
    assert 0.3 < low < 0.5 < high < 0.7 and M.bootstrap([0.0, 1.0] * 20) == (low, high)


def test_poisson_intervals(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", rng.choice("ab"), rng.random() if i % 9 else None) for i in range(400)] + [("z", "one", 0.25)]
    df = spark.createDataFrame(rows, "query_id string, tipo string, v double")
    got = {r.grp: r for r in M.poisson_bootstrap(df, "v", "query_id", "tipo").collect()}
    for g in "ab":
        v = np.array([x for _, t, x in rows if t == g and x is not None])
        half = 1.96 * v.std() / len(v) ** 0.5
        assert got[g].n == len(v) and abs(got[g].low - (v.mean() - half)) < 0.25 * half and abs(got[g].high - (v.mean() + half)) < 0.25 * half
    assert (got["one"].low, got["one"].high) == (0.25, 0.25)
    assert M.poisson_bootstrap(df.repartition(7), "v", "query_id", "tipo").orderBy("grp").collect() == M.poisson_bootstrap(df.coalesce(1), "v", "query_id", "tipo").orderBy("grp").collect()
    w = M.poisson_weights(np.arange(1, 3001) * 715_827 % M.PRIME)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs(np.corrcoef(w[:, 3], w[:, 900])[0, 1]) < 0.06 and abs(np.corrcoef(w[5], w[6])[0, 1]) < 0.06


def test_bleu_and_rouge():
    assert O.bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and O.bleu("x", "a") == 0.0
    assert O.bleu("the cat the cat", "the cat sat") == pytest.approx((2 / 4 * 1 / 3 * 0.1 / 2 * 0.1 / 1) ** 0.25)
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "adjustment": "adjust", "controlling": "control", "sky": "sky", "feed": "feed", "conflated": "conflat"}
    assert {w: O.porter(w) for w in words} == words
    assert O.rouge_l("the cats sat", "the cat sat down") == pytest.approx(2 * 3 / 7)
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.choices("abc", k=rng.randrange(9)), rng.choices("abc", k=rng.randrange(9))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert O.common_subsequence(a, b) == t[-1][-1]


def test_questions(spark):
    s = "uma descrição bastante longa do ato"
    docs = [(i, "Aviso", f"{i}/2020", f"Sumário: {s} {i if i != 3 else 2}.\n") for i in range(6)] + [(10, "Anúncio", "1/2020", f"Sumário: {s} dez\n"), (11, "Aviso", "2/2020", "Sumário: curto\n"), (12, "Aviso", "", "nada")]
    out = Q.questions(spark.createDataFrame(docs, "doc_id long, tipo string, numero string, texto string")).orderBy("id").collect()
    assert [r.id for r in out] == [f"ID_AVI_00{i}" for i in range(4)] and {r.documentos_esperados[0] for r in out} == {0, 1, 4, 5}
    assert all(r.para_geracao and r.ground_truth in r.query and r.ancora.startswith("Aviso ") for r in out)


def test_all_conditions_run(spark):
    docs = spark.createDataFrame([(i, f"Lei {i}/2020, de 2 de maio", f"assunto{i} palavra comum. Nos termos da Lei {(i + 1) % 6}/2020. " * 5) for i in range(6)], "doc_id long, titulo string, texto string")
    asked = spark.createDataFrame([(1, "assunto1", [1], "identificador", "r", True), (2, "assunto4 comum", [4], None, "r", False)], "query_id long, query string, targets array<long>, tipo string, ground_truth string, para_geracao boolean")
    assert len(CONDITIONS) == 7
    for name in ("hibrido-hibrido", "estrutural-enriquecido_grafo", "langchain"):
        out = runner.run(CONDITIONS[name], docs, asked, k=2, retrieval_only=False).collect()
        assert len(out) == 2 and all(len(r.hits) >= 2 and len(r.contextos) == len(r.metadados) == r.n_blocos_recuperados for r in out)
        by = {r.query_id: r for r in out}
        assert by["1"].resposta and by["2"].resposta is None and by["1"].tokens_contexto > 0
        assert by["1"].metadados[0].titulo.startswith("Lei ") and by["1"].metadados[0].tipo == "Lei" and by["1"].metadados[0].nivel
        assert by["1"].tempo_retrieval_s > 0 and by["1"].tempo_geracao_s > 0 == by["2"].tempo_geracao_s
    out = runner.run(CONDITIONS["hibrido-esparso"], docs, asked, k=2)
    tables = runner.evaluate(out)
    assert {r.estrato for r in tables["retrieval"].collect()} == {"total", "tipo=identificador", "tipo=?"}
    assert tables["tempos"].count() == 1 and {r.grp for r in tables["ic95_recall"].collect()} == {"total", "tipo=identificador", "tipo=?"}


def test_models_can_be_put_in(spark):
    class Lengths:
        def __call__(self, texts):
            return [[float(len(t)), 1.0, float(t.startswith("passage: "))] for t in texts]

    docs = spark.createDataFrame([(i, "Lei 1/2020", "x" * (60 + 40 * i)) for i in range(5)], "doc_id long, titulo string, texto string")
    asked = spark.createDataFrame([(1, "y" * 102)], "query_id long, query string")
    c = CONDITIONS["hibrido-denso"]
    got = c.hits(c.index(docs, Lengths), asked, 5, Lengths).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5] and all(r.score > 0.99 for r in got)
    post = R.postings(docs.select("doc_id", F.lit("the running dogs run").alias("texto")), stop=["the"], stem=O.porter).where("doc_id = 0").collect()
    assert {r.term: r.tf for r in post} == {"run": 2, "dog": 1}


def test_passages_are_found_by_a_word(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["ab", "cde", "fghi", "jklmn", "op,"]) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "\nend"]) for _ in range(60)]
    asked = [t[rng.randrange(len(t)) :][: rng.randrange(1, 25)] for t in texts[:40]] + ["x", "ab", " ", "none of them here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string")
    got = {(r.query_id, r.doc_id) for r in M.held_by(spark.createDataFrame([(i, q) for i, q in enumerate(asked) if q], "query_id long, query string"), docs).collect()}
    assert got == {(i, d) for i, q in enumerate(asked) if q for d, t in enumerate(texts) if q in t}


def test_judge_and_patience(spark):
    rows = spark.createDataFrame([(1, "que lei", "z" * 4000 + " fim", "a lei um", "a lei"), (2, "q", "c", "r", None)], "query_id long, query string, context string, referencia string, resposta string")
    got = {r.query_id: r for r in C.judged(rows).collect()}
    assert got[1].correctness == pytest.approx(2 / 3, abs=1e-3) and got[1].faithfulness == 0.0 and got[2].answer_relevancy == 0.0
    prompt = rows.select(C.judge_prompt(*(F.col(c) for c in ("query", "context", "referencia", "resposta"))).alias("p")).first().p
    assert "fim" not in prompt and prompt.count("z") == 4000 + prompt.split("CONTEXTO:")[0].count("z")
    calls, slept = [], []

    def call(p):
        calls.append(p)
        if len(calls) < 3:
            raise RuntimeError("429 too many")
        return "ok"

    assert C.Patient(call, pause=1, wait=10, sleep=slept.append)(["a"]) == ["ok"] and slept == [10, 20, 1]
    with pytest.raises(RuntimeError, match="other"):
        C.Patient(lambda p: (_ for _ in ()).throw(RuntimeError("other")), sleep=slept.append)(["a"])


def test_messages_and_system_rules(spark):
    import json

    from textquarry.functions import text as T

    asked = []
    assert C.Chat(lambda m: asked.append(m) or "ok")(["p"]) == ["ok"] and [m["role"] for m in asked[0]] == ["system", "user"]
    assert asked[0][0]["content"] == T.SYSTEM_PROMPT and [m["role"] for m in C.Chat(lambda m: asked.append(m) or "ok", None)(["p"]) and asked[1]] == ["user"]
    told = spark.range(1).select(T.messages(F.lit('a "b"')).alias("m"), T.messages(F.lit("c"), None).alias("n"), T.qa_prompt(F.lit("C"), F.lit("Q")).alias("q")).first()
    assert json.loads(told.m) == [{"role": "system", "content": T.SYSTEM_PROMPT}, {"role": "user", "content": 'a "b"'}] and json.loads(told.n) == [{"role": "user", "content": "c"}]
    assert told.q.startswith("SISTEMA: És") and told.q.endswith("RESPOSTA:")
    assert C.Extractive()([told.q]) == ["C"]


def test_one_failing_prompt_spoils_no_other(spark):
    class Picky:
        def __call__(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("quota")
            return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "query_id long, prompt string").coalesce(1)
    assert {r.query_id: r.resposta for r in C.answered(rows, Picky).collect()} == {1: "A", 2: "ERRO: quota", 3: "C"}


def test_seeded_shuffle_and_subset(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    order = list(range(50))
    random.Random(42).shuffle(order)
    got = {r.place: r.doc_id for r in Q.shuffled(rows, "doc_id").collect()}
    assert [got[i] for i in range(50)] == order
    nodes = rows.withColumnRenamed("doc_id", "node")
    assert R.visible(nodes, nodes.where("node < 3")).where("not hidden").count() == 3
    assert R.visible(nodes, nodes.limit(0)).where("not hidden").count() == 50


def test_generator_errors_become_rows(spark):
    class Broken:
        def __call__(self, prompts):
            raise RuntimeError("quota")

    rows = spark.createDataFrame([(1, "p")], "query_id long, prompt string")
    assert C.answered(rows, Broken).first().resposta == "ERRO: quota"


def test_stream(spark, tmp_path):
    from textquarry.streaming.ingest import stream_segments

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"doc_id": "d{k}", "texto": "um texto"}}\n')
        stream_segments(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["d0::0", "d1::0"]
