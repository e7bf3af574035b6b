"""Run files, evaluation files, the mark of an index, and answers of earlier runs."""

from __future__ import annotations

import csv
import datetime
import io
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import metrics as M
from textquarry.sources.parts import Store
from textquarry.sources.scratch import remove, scratch_path

#: A result of a run file.
RESULT = (
    "id string, query string, tipo string, camada int, ground_truth string, documentos_esperados array<string>, para_geracao boolean, resposta string, contextos array<string>, "
    "metadados array<struct<doc_id:string,titulo:string,tipo:string,numero:string,nivel:string,score:double,method:string>>, "
    "tempo_retrieval_s double, tempo_geracao_s double, tempo_total_s double, n_blocos_recuperados int, n_blocos_usados int, tokens_contexto int"
)
#: A run file; config and ingestao are kept as JSON text.
RUN = f"framework string, condicao string, repeticao int, timestamp string, config string, ingestao string, resultados array<struct<{RESULT.replace(' array', ':array').replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' double', ':double')}>>"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One file of this name, written part by part."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def put_rows(spark: SparkSession, path: str, head: str, rows: DataFrame, tail: str) -> None:
    """One file of this name: head, rows (one column of JSON texts, in their order) a line each with commas between, tail.

    Tasks write the lines; their files are then put together byte by byte, in the JVM.
    """
    at = scratch_path(spark, "lines")
    text = F.concat(F.col(rows.columns[0]), F.lit(","))
    try:
        rows.select(text.alias("value")).write.option("compression", "none").text(at)
        fs, folder = _path(spark, at)
        parts = sorted(((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(folder) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda x: x[0])
        to, p = _path(spark, path)
        out = to.create(p, True)
        try:
            out.write(bytearray((head + "\n" * bool(parts)).encode()))
            for i, (_, size, part) in enumerate(parts):
                own = fs.open(part)
                try:
                    spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(own, out, 0, size - 2 * (i + 1 == len(parts)))  # without the last comma and line end
                finally:
                    own.close()
            out.write(bytearray(("\n" + tail).encode()))
        finally:
            out.close()
    finally:
        remove(spark, at)


def stamp() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y%m%d_%H%M%S")


def write_run(results: DataFrame, folder: str, framework: str, condition: str, repetition: int, config: dict, ingest: dict, when: str | None = None) -> str:
    """Results of one repetition: Parquet under runs/, and one JSON file of the run; the file's path.

    The time is part of both names, so a rerun stands beside the earlier one.
    """
    when, folder, spark = when or stamp(), folder.rstrip("/"), results.sparkSession
    at = f"{folder}/runs/condicao={condition}/repeticao={repetition}/quando={when}"
    results.write.parquet(at)
    head = json.dumps({"framework": framework, "condicao": condition, "repeticao": repetition, "timestamp": when, "config": config, "ingestao": ingest}, ensure_ascii=False)

    path = f"{folder}/{condition}_r{repetition}_{when}.json"
    rows = spark.read.parquet(at).orderBy("id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    put_rows(spark, path, head[:-1] + ', "resultados": [', rows, "]}\n")
    return path


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all runs that were written there, with condicao, repeticao and quando."""
    return spark.read.option("basePath", f"{folder.rstrip('/')}/runs").parquet(f"{folder.rstrip('/')}/runs")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Run files of a folder, or one file, in order of name: ficheiro and RUN; evaluations and comparisons are passed over."""
    path = path if path.endswith(".json") else f"{path.rstrip('/')}/*.json"
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    raw = spark.read.text(path, wholetext=True).select(name.alias("ficheiro"), F.from_json("value", RUN).alias("r"))
    return raw.where(_no_account()).select("ficheiro", "r.*").orderBy("ficheiro")


def lined(spark: SparkSession, path: str, kind: str, first: Callable[[Column], Column], last: str) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """(elements (ficheiro, r), first lines (ficheiro, line), names of files that are laid out so, names of others).

    A file is laid out so where its first line opens a list, the last one closes it, and each
    line between holds a whole element of this kind: its lines can be read by many tasks.
    """
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    raw = spark.read.text(path).select(name.alias("ficheiro"), F.btrim("value", F.lit(" \t\r")).alias("line")).where("line <> ''")
    head, tail, comma = first(F.col("line")), F.col("line") == last, F.col("line").endswith(",")
    body = F.when(comma, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    broken = "_broken"
    r = F.from_json(body, f"{kind}, {broken} string", {"columnNameOfCorruptRecord": broken})
    # As a row of its own an element is parsed once, not again for each of its fields.
    rows = raw.where(~head & ~tail).select("ficheiro", "line", comma.alias("comma"), F.explode(F.array(r)).alias("r"))
    fine = F.col("line").startswith("{") & F.col("r").isNotNull() & F.col(f"r.{broken}").isNull()
    ends = raw.where(head | tail).groupBy("ficheiro").agg(F.count_if(head).alias("heads"), F.count_if(tail).alias("tails"))
    per = rows.groupBy("ficheiro").agg(F.count("*").alias("n"), F.count_if(fine).alias("good"), F.count_if("comma").alias("commas"))
    so, odd = [], []
    for x in ends.join(per, "ficheiro", "full").na.fill(0).collect():  # a row a file
        own = x.heads == x.tails == 1 and x.n == x.good and x.commas == max(0, x.n - 1)
        (so if own else odd).append(x.ficheiro)
    return rows.where(F.col("ficheiro").isin(so)).select("ficheiro", F.col("r").dropFields(broken).alias("r")), raw.where(head).where(F.col("ficheiro").isin(so)), so, odd


def results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`run_results` of a run file, or of those of a folder, line by line where a result has a line of its own."""
    folder = path.rpartition("/")[0] if path.endswith(".json") else path.rstrip("/")
    rows, heads, _, odd = lined(spark, path if path.endswith(".json") else f"{folder}/*.json", RESULT, lambda c: c.startswith("{") & c.rlike(r'"resultados":\s*\[$'), "]}")
    told = F.from_json(F.concat("line", F.lit("]}")), "framework string, condicao string, repeticao int")
    heads = heads.where(_no_account()).select("ficheiro", told.alias("t")).select("ficheiro", "t.*")
    out = _measured(rows.join(F.broadcast(heads), "ficheiro").select("ficheiro", "framework", "condicao", "repeticao", "r.*"))  # a row a file
    for name in odd:
        out = out.unionByName(run_results(run_files(spark, f"{folder}/{name}")))
    return out


def _no_account() -> Column:
    """Evaluations and comparisons are no run files."""
    return ~F.col("ficheiro").contains("_avaliacao") & ~F.col("ficheiro").contains("comparacao")


def run_results(files: DataFrame) -> DataFrame:
    """A row per result of run files, as the measures take them: query_id, hits and targets beside RESULT."""
    return _measured(files.select("ficheiro", "framework", "condicao", "repeticao", F.explode("resultados").alias("r")).select("ficheiro", "framework", "condicao", "repeticao", "r.*"))


def _measured(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"query_id": F.col("id"), "hits": F.coalesce(F.transform("metadados", lambda m: m["doc_id"]), F.array().cast("array<string>")), "targets": F.coalesce("documentos_esperados", F.array().cast("array<string>"))})


def by_query(results: DataFrame) -> DataFrame:
    """One result per query text: of several the last by id."""
    whole = F.struct(*results.columns)
    return results.groupBy(F.col("query").alias("asked")).agg(F.max_by(whole, F.col("query_id")).alias("r")).select("r.*")


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation files as rows (ficheiro, condicao, the compared columns)."""
    raw = spark.read.text(f"{folder.rstrip('/')}/*_avaliacao.json", wholetext=True)
    raw = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("ficheiro"), F.try_parse_json("value").alias("v"))
    values = [F.try_variant_get("v", place, "double").alias(name) for name, place in M.COMPARED.items()]
    return raw.select("ficheiro", F.try_variant_get("v", "$.condicao", "string").alias("condicao"), *values)


def write_evaluation(spark: SparkSession, run_file: str, summary: dict) -> str:
    """The summary beside its run file, as *_avaliacao.json; its path."""
    path = run_file.removesuffix(".json") + "_avaliacao.json"
    put_text(spark, path, [json.dumps(summary, ensure_ascii=False, indent=2)])
    return path


def write_comparison(table: DataFrame, path: str) -> None:
    """The table as one CSV file: a row per condition."""
    names = table.columns
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")  # cells with commas or quotes are quoted
    rows.writerow(names)
    rows.writerows(["" if x is None else x for x in r] for r in table.collect())
    put_text(table.sparkSession, path, [out.getvalue()])


def write_questions(rows: DataFrame, path: str) -> None:
    """Questions as one JSON array file, a line each."""
    put_rows(rows.sparkSession, path, "[", rows.orderBy("id").select(F.to_json(F.struct("*")).alias("j")), "]\n")


def store_fingerprint(spark: SparkSession, path: str, fingerprint: str) -> None:
    put_text(spark, path, [json.dumps({"fingerprint": fingerprint, "quando": stamp()})])


def stored_fingerprint(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    row = spark.read.schema("fingerprint string, quando string").json(path).first()
    return row.fingerprint if row else None


def must_ingest(spark: SparkSession, index: str, mark: str, wanted: str, forced: bool = False) -> str | None:
    """Why the index must be built, or None: forced, absent, empty, of unknown origin, or of another configuration."""
    if forced:
        return "forced"
    store = Store.open(spark, index)
    if "segments" not in store.tables:
        return "no index"
    if store.read("segments").isEmpty():
        return "empty index"
    stored = stored_fingerprint(spark, mark)
    if stored is None:
        return "unknown origin"
    return None if stored == wanted else "other configuration"


def valid_answers(previous: DataFrame) -> DataFrame:
    """(query_id, resposta) that a previous run answered without an error; of several answers the greatest, so that reruns agree."""
    return previous.where(~F.coalesce("resposta", F.lit("ERRO")).startswith("ERRO")).groupBy("query_id").agg(F.max("resposta").alias("resposta"))


def to_generate(questions: DataFrame, previous: DataFrame) -> DataFrame:
    """Questions for generation without a valid answer in a previous run (query_id, resposta)."""
    return questions.where("para_geracao").join(valid_answers(previous), "query_id", "left_anti")
