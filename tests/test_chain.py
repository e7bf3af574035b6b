"""From dump files to the comparison table."""

import json

import pytest

from textquarry.operators import context as C
from textquarry.plans import runner
from textquarry.plans.conditions import CONDITIONS
from textquarry.sources import corpus, runs


def _dumps(path):
    acts = [
        {"guid": f"g{i}", "title": f"Aviso {i}/2020, de 2 de maio", "url": "u", "error": None,
         "article_text": f"Sumário: Concurso para o posto de trabalho assunto{i} especial.\nTexto do assunto{i} com o Aviso n.º {(i + 1) % 9}/2020. " * 2}
        for i in range(9)
    ]
    (path / "a.json").write_text(json.dumps(acts[:5] + ["solto", {"title": "sem id"}, {"title": "x", "nested": {"guid": "g99"}, "article_text": "y" * 80}]))
    (path / "b.json").write_text(json.dumps(acts[5]))
    (path / "c.json").write_text(json.dumps(acts[6:] + [acts[0]]))
    (path / "d.json").write_text("[{")


def test_from_dumps_to_comparison(spark, tmp_path, capsys):
    (tmp_path / "dumps").mkdir()
    _dumps(tmp_path / "dumps")
    rows = corpus.classified(corpus.elements(spark, f"{tmp_path}/dumps"))
    assert {r.estado: r.n for r in corpus.reject_counts(rows).collect()} == {"aceite": 9, "nao_dict": 1, "sem_guid": 2, "guid_duplicado": 1, "ficheiro_partido": 1}
    runner.main(["--corpus", f"{tmp_path}/dumps", "--make-questions", f"{tmp_path}/q.json"])
    asked = json.loads((tmp_path / "q.json").read_text())
    assert len(asked) == 9 and all(q["documentos_esperados"][0].startswith("g") for q in asked)
    out = f"file://{tmp_path}/out"
    common = ["--corpus", f"{tmp_path}/dumps", "--questions", f"{tmp_path}/q.json", "--out", out, "--top-k", "3"]
    runner.main([*common, "--condition", "hibrido-esparso", "--repetitions", "2"])
    runner.main([*common, "--condition", "hibrido-denso", "--retrieval-only"])
    files = sorted(p for p in (tmp_path / "out").glob("*.json"))
    assert len(files) == 3
    told = json.loads(files[-1].read_text())
    assert told["condicao"] == "hibrido-esparso" and len(told["resultados"]) == 9 and told["ingestao"]["n_documentos"] == 9 and told["config"]["top_k"] == "3" or told["config"]["top_k"] == 3
    first = told["resultados"][0]
    assert first["metadados"][0].keys() == {"doc_id", "titulo", "tipo", "numero", "nivel", "score", "method"} and first["resposta"] and first["tempo_geracao_s"] > 0
    assert runs.by_query(runs.run_results(runs.run_files(spark, out)).where("condicao = 'hibrido-esparso'")).count() == 9
    runner.main(["--evaluate", out, "--top-k", "3"])
    done = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("*_avaliacao.json")]
    assert len(done) == 3
    sparse = next(x for x in done if x["condicao"] == "hibrido-esparso")
    assert sparse["retrieval"]["recall@3"] == 1.0 and sparse["retrieval"]["ic95_recall"] == [1.0, 1.0] and sparse["retrieval_estratificado"]["tipo=identificador"]["n_queries"] == 9
    assert sparse["juiz_llm"]["_detalhe"]["n_falhas_parse"] == 0 and 0 <= sparse["classicas"]["rouge_l"] <= 1 and len(sparse["classicas"]["rouge_l_ic95"]) == 2
    assert "total" in runner.console(sparse)
    runner.main(["--compare", out])
    lines = (tmp_path / "out" / "comparacao.csv").read_text().splitlines()
    assert len(lines) == 3 and lines[0].startswith("condicao,n_exec") and {x.split(",")[0]: x.split(",")[1] for x in lines[1:]} == {"hibrido-denso": "1", "hibrido-esparso": "2"}


class Never:
    def __call__(self, prompts):
        raise RuntimeError("must not be asked")


def test_resume_keeps_valid_answers(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"Lei {i}/2020", f"palavra{i} comum " * 30) for i in range(3)], "doc_id string, titulo string, texto string")
    asked = spark.createDataFrame([(f"q{i}", f"palavra{i}", [f"d{i}"], "semantica", "r", i < 2) for i in range(3)], "query_id string, query string, targets array<string>, tipo string, ground_truth string, para_geracao boolean")

    class Once:
        def __call__(self, prompts):
            return ["ERRO: quota" if "palavra1" in p.split("PERGUNTA")[-1] else "resposta" for p in prompts]

    out, c = f"file://{tmp_path}", CONDITIONS["hibrido-esparso"]
    runner.benchmark(spark, c, docs, asked, out, make=Once)
    path = runner.benchmark(spark, c, docs, asked, out, resume=True, make=Never)
    got = {r["id"]: r["resposta"] for r in json.loads(open(path.removeprefix("file://")).read())["resultados"]}
    assert got == {"q0": "resposta", "q1": "ERRO: must not be asked", "q2": None}
    path = runner.benchmark(spark, c, docs, asked, out, resume=True, make=C.Extractive)
    got = {r["id"]: r["resposta"] for r in json.loads(open(path.removeprefix("file://")).read())["resultados"]}
    assert got["q0"] == "resposta" and not got["q1"].startswith("ERRO")


def test_a_run_that_dies_goes_on(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"Lei {i}/2020", f"palavra{i} comum " * 30) for i in range(4)], "doc_id string, titulo string, texto string")
    asked = spark.createDataFrame([(f"q{i}", f"palavra{i % 4}", [f"d{i % 4}"], "semantica", "r", True) for i in range(24)], "query_id string, query string, targets array<string>, tipo string, ground_truth string, para_geracao boolean")
    out, c, real, seen = f"file://{tmp_path}", CONDITIONS["hibrido-esparso"], runner.run, []

    def dies(cond, docs, questions, *args, **more):
        seen.append({r.query_id for r in questions.collect()})
        if len(seen) == 2:
            raise RuntimeError("the second partition is killed")
        return real(cond, docs, questions, *args, **more)

    monkeypatch.setattr(runner, "run", dies)
    with pytest.raises(RuntimeError, match="1 of 8 partitions failed.*killed"):
        runner.benchmark(spark, c, docs, asked, out)
    assert len(seen) == 8 and not list(tmp_path.glob("*_r1_*.json"))  # the others were asked all the same
    path = runner.benchmark(spark, c, docs, asked, out, resume=True)
    assert len(seen) == 9 and seen[8] == seen[1]  # only that one is asked again
    got = json.loads(open(path.removeprefix("file://")).read())["resultados"]
    assert sorted(r["id"] for r in got) == sorted(f"q{i}" for i in range(24)) and all(r["metadados"] for r in got)
    assert not list((tmp_path / "journal").glob("*"))


def test_an_index_follows_its_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"Lei {i}/2020", f"palavra{i} comum " * 30) for i in range(6)], "doc_id string, titulo string, texto string")
    c, root = CONDITIONS["hibrido-esparso"], f"file://{tmp_path}"
    first, _ = runner.ingest(spark, c, docs, root)
    changed = docs.where("doc_id <> 'd2'").unionByName(spark.createDataFrame([("d9", "Lei 9/2020", "nova palavra")], docs.schema))
    second, told = runner.ingest(spark, c, changed, root)
    assert second.store.version == first.store.version + 1 and told["n_documentos"] == 6
    asked = spark.createDataFrame([("a", "nova"), ("b", "palavra2")], "query_id string, query string")
    assert [(r.query_id, r.doc_id) for r in c.hits(second, asked).collect()] == [("a", "d9")]


def test_cells_of_a_table_with_commas(spark, tmp_path):
    runs.write_comparison(spark.createDataFrame([('a, "b"', 1.5, None)], "condicao string, x double, y double"), f"file://{tmp_path}/c.csv")
    assert (tmp_path / "c.csv").read_text() == 'condicao,x,y\n"a, ""b""",1.5,\n'


def test_files_with_a_row_a_line_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i:03}", "a \"b\",\n[x" + "y" * i, ["d1"], i % 2 == 0) for i in range(200)], "id string, query string, documentos_esperados array<string>, para_geracao boolean")
    rows = rows.selectExpr("id", "query", "'semantica' tipo", "1 camada", "'r' ground_truth", "documentos_esperados", "para_geracao", "cast(null as string) resposta", "array('c') contextos", "array(named_struct('doc_id', 'd1')) metadados", "0.5D tempo_retrieval_s")
    root = f"file://{tmp_path}/r"
    path = runs.write_run(rows.repartition(7), root, "f", "c", 1, {"k": 5}, {}, "x")
    want = sorted(map(str, runs.run_results(runs.run_files(spark, root)).collect()))
    assert len(want) == 200 and sorted(map(str, runs.results(spark, root).collect())) == want == sorted(map(str, runs.results(spark, path).collect()))
    _, _, so, odd = runs.lined(spark, f"{root}/*.json", runs.RESULT, lambda c: c.startswith("{") & c.rlike(r'"resultados":\s*\[$'), "]}")
    assert len(so) == 1 and not odd
    file = next((tmp_path / "r").glob("*.json"))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    whole = file.read_text()
    told = json.loads(whole)
    assert [r["id"] for r in told["resultados"]] == [f"q{i:03}" for i in range(200)]
    for other in (json.dumps(told), json.dumps(told, indent=1), whole.replace("},\n", "}\n,")):
        file.write_text(other)
        assert sorted(map(str, runs.results(spark, root).collect())) == want
    file.write_text(whole[:-3])  # cut off: no rows, as before
    assert runs.results(spark, root).count() == runs.run_results(runs.run_files(spark, root)).count() == 0
    asked = rows.select("id", "query", "tipo", "camada", "documentos_esperados")
    runs.write_questions(asked.repartition(5), f"{root}/q/q.json")
    plain = (tmp_path / "r" / "q" / "q.json").read_text()
    got = sorted(map(str, corpus.question_file(spark, f"{root}/q/q.json").collect()))
    (tmp_path / "r" / "q" / "p.json").write_text(json.dumps(json.loads(plain), indent=2))
    assert len(got) == 200 and got == sorted(map(str, corpus.question_file(spark, f"{root}/q/p.json").collect()))
    runs.write_questions(asked.limit(0), f"{root}/q/none.json")
    assert json.loads((tmp_path / "r" / "q" / "none.json").read_text()) == []
    with pytest.raises(ValueError, match="no questions"):
        corpus.question_file(spark, f"{root}/q/none.json")
