import json

import pytest

from textquarry.operators import metrics as M
from textquarry.plans import runner
from textquarry.sources import corpus, runs

LONG = "texto " * 20


def _write(folder, name, data):
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")


@pytest.fixture()
def dump(tmp_path):
    item = lambda guid, text=LONG, **k: {"guid": guid, "title": "Aviso 1/2026, de 3 de março", "url": "u", "article_text": text} | k
    _write(tmp_path, "a_1.json", [item("1", "curto"), item("1"), item("1"), item("2", error="timeout"), item("3", error=False), item("4", error=""), "solto", 5, None, [1]])
    _write(tmp_path, "a_2.json", [item(None), item("  "), item(77), {"title": "sem guid", "article_text": LONG}, item("5", "x" * 49), item("6", "x" * 50), item("7", " " + "x" * 50 + " "), item("8", "x" * 500), item("9", "x" * 501), item("10", None)])
    _write(tmp_path, "b.json", item("11"))
    _write(tmp_path, "c.json", "{partido")
    _write(tmp_path, "d.json", {"total": 3, "results": []})
    _write(tmp_path, ".hidden.json", [item("99")])
    return tmp_path


def test_statuses_and_documents(spark, dump):
    rows = corpus.classified(corpus.elements(spark, str(dump)), 50, 500)
    counts = {r.estado: r.n for r in corpus.reject_counts(rows).collect()}
    assert counts == {"vazio_ou_curto": 3, "aceite": 9, "guid_duplicado": 1, "erro_scraping": 1, "nao_dict": 4, "sem_guid": 3, "grande_demais": 1, "ficheiro_partido": 1}
    docs = {r.id: r for r in corpus.documents(rows).collect()}
    assert set(docs) == {"1", "3", "4", "None", "77", "6", "7", "8", "11"}
    assert docs["1"].pos == 1 and docs["7"].n_chars == 50 and docs["1"].tipo == "Aviso" and docs["1"].data_publicacao == "2026-03-03"
    assert docs["11"].ficheiro_origem == "b.json"


@pytest.mark.parametrize("read", [1, 2, 7, 100, 1 << 20])
def test_cut_like_a_parser(read):
    """Elements as a whole parser finds them, broken files told as it tells them, whatever is read at once."""
    import io
    import random

    from textquarry.sources import dumps

    rng = random.Random(read)
    value = lambda d=0: rng.choice([lambda: rng.randrange(99), lambda: rng.choice(['a"b', "x\\", "[,]}{", "é\n", ""]), lambda: None, lambda: [value(d + 1) for _ in range(rng.randrange(3))], lambda: {rng.choice('ab"c'): value(d + 1) for _ in range(rng.randrange(3))}][: 5 if d < 3 else 3])()
    texts = ["", " ", "[]", " [ ] ", "[1,]", "[,1]", "[1 2]", "[1],", "[1] x", "[", '["a', '["a\\"]', "[[1]", "[1]]", "[}", "5", '"x"', "{}", '{"a": [1, 2]}', '{"a"', "nul", '[{"a": "]"}]', '["\\\\", "\\""]']
    texts += [json.dumps([value() for _ in range(rng.randrange(5))], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for _ in range(60)]
    texts += [t[: rng.randrange(len(t) + 1)] for t in texts] + [t.replace(rng.choice(",[]{}"), rng.choice(",]}"), 1) for t in texts]
    for text in texts:
        try:
            want = json.loads(text)
            want = want if isinstance(want, list) else [want]
        except ValueError:
            want = None
        try:
            got = [json.loads(e) for e in dumps.cut(io.BytesIO(text.encode()), read)]
        except ValueError:  # of the list or of an element
            got = None
        assert got == want, text


def test_files_are_read_in_pieces(spark, dump, monkeypatch):
    from textquarry.sources import dumps

    _write(dump, "e.json", [])
    _write(dump, "f.json", '[{"guid": "f1", "article_text": "' + "y" * 90 + '"}, {"guid": f2}]')
    seen = lambda: sorted((r.ficheiro, r.pos, r.id or "", r.n_chars or 0, r.estado) for r in corpus.classified(corpus.elements(spark, str(dump)), 50, 500).collect())
    whole = seen()
    assert [x for x in whole if x[0] == "f.json"] == [("f.json", -1, "", 0, "ficheiro_partido")] and not [x for x in whole if x[0] == "e.json"]
    monkeypatch.setattr(dumps, "READ", 5)
    monkeypatch.setattr(dumps, "BATCH", 30)
    assert seen() == whole


def test_an_element_beyond_a_variant(spark, tmp_path):
    _write(tmp_path, "a.json", [{"guid": "1", "title": "t", "article_text": "x" * 70_000_000}, {"guid": "2", "title": "t", "article_text": LONG}])
    (tmp_path / "b.json").write_text('[{"guid": "3", "article_text": "' + "x" * 9_000_000 + '" nonsense}]')
    rows = corpus.classified(corpus.elements(spark, str(tmp_path))).select("id", "estado").collect()
    assert {(r.id, r.estado) for r in rows} == {("1", "grande_demais"), ("2", "aceite"), (None, "ficheiro_partido")}


def test_report_and_fingerprint(spark, dump, tmp_path):
    rows = corpus.classified(corpus.elements(spark, str(dump)), 50, 500)
    corpus.report(rows, f"{tmp_path}/report")
    told = spark.read.json(f"{tmp_path}/report").first()
    assert told.contagens.aceite == 9 and told.n == 9 and told.tipos.Aviso == 9 and told.grandes[0].id == "9"
    docs = corpus.documents(rows)
    one, two = corpus.corpus_fingerprint(docs).first()[0], corpus.corpus_fingerprint(docs.where("id <> '1'")).first()[0]
    assert len(one) == 16 and one != two and one == corpus.corpus_fingerprint(docs.orderBy("id")).first()[0]


def test_question_file(spark, tmp_path):
    _write(tmp_path, "q.json", [{"id": "a", "query": "?", "tipo": "semantica", "documentos_esperados": ["1", "2"], "para_geracao": True}])
    assert corpus.question_file(spark, f"{tmp_path}/q.json").first().documentos_esperados == ["1", "2"]
    _write(tmp_path, "e.json", [])
    with pytest.raises(ValueError, match="no questions"):
        corpus.question_file(spark, f"{tmp_path}/e.json")


def test_comparison_of_evaluations(spark, tmp_path):
    def one(cond, hit, tokens=None, ident=None):
        out = {"condicao": cond, "retrieval": {"hit_rate@5": hit, "precision@5": 0.2, "mrr": 0.5}, "tempos": {"total_medio_s": 0.1}, "orcamento_contexto": {"tokens_media": tokens} if tokens else {}}
        return out | ({"retrieval_estratificado": {"tipo=identificador": {"hit_rate@5": ident}}} if ident else {})

    _write(tmp_path, "x_r1_avaliacao.json", one("x", 0.8, 100.0, 0.7))
    _write(tmp_path, "x_r2_avaliacao.json", one("x", 0.6))
    _write(tmp_path, "y_r1_avaliacao.json", one("y", 0.9))
    _write(tmp_path, "y_r1.json", {"condicao": "y", "resultados": []})
    table = {r.condicao: r for r in runner.compare_folder(spark, str(tmp_path)).collect()}
    x = table["x"]
    assert (x.n_exec, x["hit@5"], x["hit@5_sd"], x.tokens_ctx, x.hit_ident, x.faithful) == (2, 0.7, 0.1, 100.0, 0.7, None)
    assert table["y"]["hit@5_sd"] == 0.0
    assert [r.ficheiro for r in runs.run_files(spark, str(tmp_path)).collect()] == ["y_r1.json"]
    runs.write_comparison(M.compare(runs.evaluations(spark, str(tmp_path)), ["hit@5"]), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_index_is_built_when_it_must(spark, tmp_path):
    from textquarry.plans.conditions import condition, family

    docs = spark.createDataFrame([(f"d{i}", f"Lei {i}/2020", f"palavra{i} comum " * 30) for i in range(4)], "doc_id string, titulo string, texto string")
    c = condition(" Hibrido-Esparso ")
    root = f"file://{tmp_path}"
    assert runner.ingest(spark, c, docs, root)[1]["reingerido"] == "no index"
    assert runner.ingest(spark, c, docs, root)[1]["reingerido"] is None
    assert runner.ingest(spark, c, docs.where("doc_id <> 'd1'"), root)[1]["reingerido"] == "other configuration"
    assert runner.ingest(spark, c, docs.where("doc_id <> 'd1'"), root, forced=True)[1] == {"reingerido": "forced", "n_chunks": 3, "n_documentos": 3, "segmentacao": {"bloco": 3}, "corpus": corpus.corpus_fingerprint(docs.where("doc_id <> 'd1'"), id_column="doc_id").first()[0]}
    assert [x.name for x in family("estrutural")] == ["estrutural-enriquecido", "estrutural-enriquecido_grafo"]
    for f, bad in ((condition, "nada"), (family, "nada")):
        with pytest.raises(ValueError):
            f(bad)
