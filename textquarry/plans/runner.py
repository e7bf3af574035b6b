"""Running conditions over questions, evaluating runs, comparing conditions."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import context as C
from textquarry.operators import metrics as M
from textquarry.operators import overlap as O
from textquarry.operators import questions as Q
from textquarry.operators.tokens import counter
from textquarry.plans.conditions import CONDITIONS, Condition, Index, condition, described, family
from textquarry.sources import corpus, runs
from textquarry.sources.scratch import remove, small, sweep, written

_HIT = "array<struct<doc_id:string,titulo:string,tipo:string,numero:string,nivel:string,score:double,method:string>>"


def run(
    cond: Condition, docs: DataFrame | None, questions: DataFrame, k: int = 5, retrieval_only: bool = True, budget: int = C.BUDGET, make=C.Extractive,
    index: Index | None = None, previous: DataFrame | None = None, embed=None, count=T.token_estimate,
) -> DataFrame:
    """A run's results, one row per question (runs.RESULT, with query_id, hits and targets).

    questions (query_id, query, targets, tipo, camada, ground_truth, para_geracao) are searched
    in the index, or in one made of docs. Seconds are those that the tables took to be made,
    hits for retrieval and answers for generation, shared evenly among the questions that each
    was for. Questions with a valid answer in previous (query_id, resposta) keep it.
    """
    index = index or cond.index(docs, embed, points=False)
    questions = written(questions, "questions")
    began = time.time()
    hits = written(cond.hits(index, questions.select("query_id", "query"), k, embed), "hits")
    searched = (time.time() - began) / max(1, questions.count())
    rows = written(index.segments.drop("doc_id", "point_id", "texto_embebido").join(small(hits), "chunk_id"), "blocks")  # read for contexts and for what is listed
    block = T.source_block(F.col("tipo"), F.col("numero"), F.col("texto"))
    blocks = rows.select("query_id", "rank", block.alias("texto"), count(block).alias("tokens"))
    packed = written(C.packed(blocks, budget), "contexts")
    meta = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "titulo", "tipo", "numero", F.col("nivel_segmentacao").alias("nivel"), "score", "method")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", meta.alias("m"), "texto"))).alias("h"))
    asked = questions.where("para_geracao") if not retrieval_only else questions.limit(0)
    old = runs.valid_answers(previous) if previous is not None else None
    prompts = asked if old is None else runs.to_generate(asked, old)
    prompts = prompts.join(packed.select("query_id", "context"), "query_id", "left").select("query_id", cond.prompt(F.coalesce("context", F.lit("")), F.col("query")).alias("prompt"))
    began = time.time()
    answers = written(C.answered(prompts, make), "answers")
    made = (time.time() - began) / max(1, answers.count())
    answers = answers.withColumn("tempo_geracao_s", F.lit(made))
    if old is not None:
        kept = old.join(asked.select("query_id"), "query_id", "left_semi").withColumn("tempo_geracao_s", F.lit(0.0))
        answers = answers.unionByName(kept)
    out = questions.join(listed, "query_id", "left").join(answers, "query_id", "left")
    out = out.join(packed.select("query_id", F.col("tokens").cast("int").alias("tokens_contexto"), F.col("n_used").alias("n_blocos_usados")), "query_id", "left")
    empty = lambda kind: F.array().cast(kind)
    generated = F.coalesce("tempo_geracao_s", F.lit(0.0))
    out = out.select(
        F.col("query_id").cast("string").alias("id"), "query", "tipo", _or_null(questions, "camada", "int"), "ground_truth", F.col("targets").cast("array<string>").alias("documentos_esperados"), "para_geracao", "resposta",
        F.coalesce(F.transform("h", lambda x: x["texto"]), empty("array<string>")).alias("contextos"), F.coalesce(F.transform("h", lambda x: x["m"]), empty(_HIT)).alias("metadados"),
        F.lit(searched).alias("tempo_retrieval_s"), generated.alias("tempo_geracao_s"), (searched + generated).alias("tempo_total_s"),
        F.coalesce(F.size("h"), F.lit(0)).alias("n_blocos_recuperados"), F.coalesce("n_blocos_usados", F.lit(0)).alias("n_blocos_usados"), F.coalesce("tokens_contexto", F.lit(0)).alias("tokens_contexto"),
    )
    return measured_as(written(out, "results"))


#: Partitions of questions in a journal.
JOURNAL_PARTS = 8


def journaled(cond: Condition, questions: DataFrame, journal: str, parts: int = JOURNAL_PARTS, **how) -> DataFrame:
    """The results of :func:`run`, partition by partition of the questions, each written when it is done.

    Partitions that an earlier try has finished are read, not asked again. One that fails
    keeps none of the others from being asked; in the end the failures are told together.
    Questions are dealt by the hash of their ids. how: of :func:`run`, with an index.
    """
    spark, failed = questions.sparkSession, []
    for p in range(parts):
        path = f"{journal.rstrip('/')}/part={p}-of-{parts}"
        if runs.exists(spark, f"{path}/_SUCCESS"):
            continue
        own = questions.where(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(parts)) == p)
        try:
            run(cond, None, own, **how).drop("query_id", "hits", "targets").write.mode("overwrite").parquet(path)
        except Exception as e:
            failed.append((p, e))
    if failed:
        told = "; ".join(f"{p}: {str(e).splitlines()[0] if str(e) else type(e).__name__}" for p, e in failed)
        raise RuntimeError(f"{len(failed)} of {parts} partitions failed, the others are kept in {journal}: {told}") from failed[0][1]
    return measured_as(spark.read.parquet(*(f"{journal.rstrip('/')}/part={p}-of-{parts}" for p in range(parts))))


def _or_null(df: DataFrame, name: str, kind: str):
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def measured_as(results: DataFrame) -> DataFrame:
    """Results of a run with query_id, hits and targets, as the measures take them."""
    return results.withColumns({"query_id": F.col("id"), "hits": F.transform("metadados", lambda m: m["doc_id"]), "targets": F.coalesce("documentos_esperados", F.array().cast("array<string>"))})


def evaluate(results: DataFrame, k: int = 5, retrieval_only: bool = False, judge=None) -> dict[str, DataFrame]:
    """Tables of one run: retrieval (total and by tipo), intervals, budget, seconds, counts; of answers judge and classic scores."""
    measured = written(M.per_query(results, k).select("query_id", "tipo", *M.METRICS), "measured")
    out = {"retrieval": M.aggregate(measured, "tipo"), "orcamento_contexto": M.budget_stats(results), "tempos": M.timing_means(results), "estatisticas": M.run_stats(results)}
    for name in ("recall", "hit_rate"):
        out[f"ic95_{name}"] = M.bootstrap_by(measured, None, name, "query_id").unionByName(M.bootstrap_by(measured, "tipo", name, "query_id").withColumn("grp", F.concat(F.lit("tipo="), "grp")))
    if not retrieval_only:
        able = answers_to_score(results)
        if judge is not None:
            out["juiz_llm"] = M.judge_summary(C.judged(able.withColumn("context", F.array_join("contextos", "\n\n")), judge))
        scores = written(O.overlap(able), "overlap")
        out |= {"classicas": O.overlap_means(scores), "ic95_rouge_l": M.bootstrap_by(scores, None, "rouge_l", "query_id")}
    return out


def answers_to_score(results: DataFrame) -> DataFrame:
    """Rows for generation with a reference and an answer that is no error, with referencia."""
    fine = F.coalesce("para_geracao", F.lit(False)) & (F.coalesce("ground_truth", F.lit("")) != "") & (F.coalesce("resposta", F.lit("")) != "") & ~F.col("resposta").startswith("ERRO")
    return results.where(fine).withColumn("referencia", F.col("ground_truth"))


def summary(results: DataFrame, k: int = 5, retrieval_only: bool = False, judge=None) -> dict:
    """The evaluation of one run as its file holds it. All tables have a few rows."""
    got = {name: [r.asDict() for r in df.collect()] for name, df in evaluate(results, k, retrieval_only, judge).items()}
    limits = {name: {r["grp"]: [r["low"], r["high"]] for r in got[f"ic95_{name}"]} for name in ("recall", "hit_rate")}

    def part(r: dict) -> dict:
        at = r["estrato"]
        names = {m: m if m == "mrr" else f"{m}@{k}" for m in M.METRICS}
        return {names[m]: r[m] for m in M.METRICS} | {"n_queries": r["n"], "ic95_recall": limits["recall"].get(at), "ic95_hit": limits["hit_rate"].get(at)}

    strata = {r["estrato"]: part(r) for r in got["retrieval"]}
    total = strata.pop("total", {})
    seconds = got["tempos"][0]
    out = {
        "n_queries": results.count(), "n_erros": got["estatisticas"][0]["n_erros"], "orcamento_contexto": {} if retrieval_only else got["orcamento_contexto"][0],
        "tempos": {"retrieval_medio_s": seconds["retrieval_medio_s"], "geracao_media_s": seconds["geracao_medio_s"], "total_medio_s": seconds["total_medio_s"]},
        "retrieval": total if total.get("n_queries") else {}, "retrieval_estratificado": strata if total.get("n_queries") else {},
    }
    if got.get("juiz_llm"):
        j = got["juiz_llm"][0]
        names = ("faithfulness", "answer_relevancy", "correctness")
        out["juiz_llm"] = {n: j[n] for n in names} | {"_detalhe": {n: {"media": j[n], "desvio": j[n + "_desvio"], "n": j["n"]} for n in names} | {"n_falhas_parse": j["falhas"]}}
    if got.get("classicas") and got["classicas"][0]["n"]:
        c = got["classicas"][0]
        out["classicas"] = {"bleu": c["bleu"], "rouge_l": c["rouge_l"], "rouge_l_ic95": [[r["low"], r["high"]] for r in got["ic95_rouge_l"]][0]}
    return out


def evaluate_files(spark: SparkSession, path: str, k: int = 5, retrieval_only: bool = False, judge=None) -> list[str]:
    """Evaluates a run file or all run files of a folder; paths of the evaluations, written beside them."""
    folder = path.rpartition("/")[0] if path.endswith(".json") else path.rstrip("/")
    files = runs.run_files(spark, path)
    out = []
    for f in files.select("ficheiro", "framework", "condicao", "repeticao", "config").collect():  # a row a run
        rows = runs.results(spark, f"{folder}/{f.ficheiro}")  # of this file alone
        told = {"condicao": f.condicao, "framework": f.framework, "repeticao": f.repeticao, "config": f.config}
        out.append(runs.write_evaluation(spark, f"{folder}/{f.ficheiro}", told | summary(rows, k, retrieval_only, judge)))
    return out


def console(told: dict) -> str:
    """An evaluation in a few lines."""
    lines = [f"{told.get('condicao', '?')} (run {told.get('repeticao', '?')}): {told['n_queries']} questions, {told['n_erros']} errors"]
    for at, r in [("total", told["retrieval"]), *sorted(told["retrieval_estratificado"].items())]:
        lines.append(f"  {at:<24}" + "  ".join(f"{m} {v:.4f}" for m, v in r.items() if isinstance(v, float)))
    lines += [f"  {name:<24}" + "  ".join(f"{m} {v}" for m, v in told[name].items() if not m.startswith("_")) for name in ("tempos", "orcamento_contexto", "juiz_llm", "classicas") if told.get(name)]
    return "\n".join(lines)


def compare_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison of all evaluation files of a folder."""
    return M.compare(runs.evaluations(spark, folder), list(M.COMPARED))


def ingest(spark: SparkSession, cond: Condition, docs: DataFrame, root: str, forced: bool = False, embed=None) -> tuple[Index, dict]:
    """A condition's index, built unless it is there for the same corpus and configuration; and the account of it.

    Conditions whose indexes are alike share one.
    """
    mark = corpus.corpus_fingerprint(docs, id_column="doc_id").first().fingerprint
    wanted = T.fingerprint(cond.config() | {"corpus": mark})
    name = f"{cond.family}-{cond.search}-{int(cond.enriched)}{int(cond.graph)}"
    at = f"{root.rstrip('/')}/index/{name}"
    why = runs.must_ingest(spark, at, f"{at}.json", wanted, forced)
    settings = T.fingerprint(cond.config())
    if why == "other configuration" and (old := Index.load(spark, at)).info.get("config") == settings:
        # Only the corpus differs: what has changed is put in.
        gone = old.store.read("marks").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
        index = cond.upsert(old, docs, gone, embed)
        index.store.vacuum()
        runs.store_fingerprint(spark, f"{at}.json", wanted)
    elif why:
        index = cond.index(docs, embed, at, config=settings)
        index.store.vacuum()
        runs.store_fingerprint(spark, f"{at}.json", wanted)
    else:
        index = Index.load(spark, at)
    levels = {r.nivel_segmentacao: r["count"] for r in index.segments.groupBy("nivel_segmentacao").count().collect()}
    told = {"reingerido": why, "n_chunks": sum(levels.values()), "n_documentos": index.segments.select("doc_id").distinct().count(), "segmentacao": levels, "corpus": mark}
    return index, told


def benchmark(spark: SparkSession, cond: Condition, docs: DataFrame, asked: DataFrame, out: str, k: int = 5, repetition: int = 1, retrieval_only: bool = False, forced: bool = False, resume: bool = False, make=C.Extractive, embed=None, ranks: str | None = None) -> str:
    """Ingests, runs and writes one repetition of a condition; the run file's path.

    resume: a run that died goes on with the questions that it had left, and valid answers of the last run are kept.
    """
    index, told = ingest(spark, cond, docs, out, forced, embed)
    before = None
    if resume and runs.exists(spark, f"{out.rstrip('/')}/runs/condicao={cond.name}"):
        earlier = runs.read_runs(spark, out).where((F.col("condicao") == cond.name) & (F.col("repeticao") == repetition))
        last = earlier.agg(F.max(F.col("quando").cast("string"))).first()[0]
        before = earlier.where(F.col("quando").cast("string") == last).select(F.col("id").alias("query_id"), "resposta") if last else None
    count, counted = counter(ranks)
    journal = f"{out.rstrip('/')}/journal/{cond.name}-r{repetition}-{T.fingerprint({'k': k, 'retrieval_only': retrieval_only, 'corpus': told['corpus']})}"
    if not resume:  # a run from the start; with resume one that died goes on
        remove(spark, journal)
    results = journaled(cond, asked, journal, k=k, retrieval_only=retrieval_only, make=make, index=index, previous=before, embed=embed, count=count)
    path = runs.write_run(results.drop("query_id", "hits", "targets"), out, cond.family, cond.name, repetition, cond.config() | {"top_k": k, "context_budget_tokens": C.BUDGET, "variante": cond.name, "tokenizer_orcamento": counted}, told)
    remove(spark, journal)
    return path


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Make questions, run conditions over a JSON corpus, evaluate runs, compare evaluations.")
    p.add_argument("--corpus")
    p.add_argument("--questions")
    p.add_argument("--make-questions", help="a file for questions made from the corpus")
    p.add_argument("--condition", choices=sorted(CONDITIONS))
    p.add_argument("--ablation", help="a family: all its variants")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--repetitions", type=int, default=1)
    p.add_argument("--reingest", action="store_true")
    p.add_argument("--retrieval-only", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--ranks", help="a byte-pair rank file for token counts")
    p.add_argument("--out", default="results")
    p.add_argument("--evaluate", help="a run file, or a folder of them")
    p.add_argument("--compare", help="a folder of evaluation files")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.make_questions:
        docs = corpus.load(spark, a.corpus).withColumnRenamed("id", "doc_id")
        runs.write_questions(Q.questions(described(docs)), a.make_questions)
    elif a.evaluate:
        for path in evaluate_files(spark, a.evaluate, a.top_k, a.retrieval_only, None if a.retrieval_only else C.OverlapJudge):
            print(path)
    elif a.compare:
        table = compare_folder(spark, a.compare)
        runs.write_comparison(table, f"{a.compare.rstrip('/')}/comparacao.csv")
        table.show(100, truncate=False)
    else:
        docs = corpus.load(spark, a.corpus).withColumnRenamed("id", "doc_id")
        asked = corpus.question_file(spark, a.questions).withColumnsRenamed({"id": "query_id", "documentos_esperados": "targets"})
        for cond in family(a.ablation) if a.ablation else [condition(a.condition)]:
            for r in range(1, a.repetitions + 1):
                print(benchmark(spark, cond, docs, asked, a.out, a.top_k, r, a.retrieval_only, a.reingest and r == 1, a.resume, ranks=a.ranks))
    sweep(spark)


if __name__ == "__main__":
    main()
