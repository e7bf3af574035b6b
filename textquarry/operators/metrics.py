"""Measures of runs: per query, per stratum, per condition, with intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.sparse import few
from textquarry.sources.scratch import numbered, small

# Fixed values of the interval.
RESAMPLES, ALPHA, SEED = 2000, 0.05, 42
METRICS = ["precision", "recall", "mrr", "ndcg", "hit_rate"]


def dcg(rel: Column) -> Column:
    gains = F.transform(rel, lambda x, i: x / F.log2(i + F.lit(2)))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def unique_first(ids: Column, k: int | None = None) -> Column:
    """Distinct non-empty ids in order of first place, the first k."""
    out = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x.cast("string") != "")))
    return out if k is None else F.slice(out, 1, k)


def per_query(results: DataFrame, k: int = 5) -> DataFrame:
    """The five measures of each row of results (query_id, hits, targets, ...) that has targets.

    hits are document ids by rank. nDCG is relative to the relevant documents that were found.
    """
    own = results.where(F.size(F.array_distinct("targets")) > 0).withColumn("u", unique_first(F.col("hits"), k)).withColumn("al", F.array_distinct("targets"))
    own = own.withColumn("rel", F.transform("u", lambda x: F.when(F.array_contains("al", x), 1.0).otherwise(0.0)))
    n = F.aggregate("rel", F.lit(0.0), lambda s, x: s + x)
    ideal = dcg(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda _: F.lit(1.0)))
    first = F.array_position("rel", F.lit(1.0))
    out = {
        "precision": n / F.greatest(F.lit(1), F.size("u")),
        "recall": F.size(F.array_intersect("al", "u")) / F.size("al"),
        "mrr": F.when(first > 0, 1.0 / first).otherwise(0.0),
        "ndcg": F.when(n > 0, dcg(F.col("rel")) / ideal).otherwise(0.0),
        "hit_rate": F.when(n > 0, 1.0).otherwise(0.0),
    }
    return own.withColumns(out).drop("u", "al", "rel")


def aggregate(measured: DataFrame, stratum: str | None = None, by: str | None = None) -> DataFrame:
    """Means over all queries, and by stratum ('tipo=...', missing '?') in the same pass; by: of each value of it."""
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    keys = [by] if by else []
    if stratum is None:
        return measured.groupBy(*keys).agg(F.count("*").alias("n"), *means)
    own = measured.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("?")))
    sets = [[*(F.col(k) for k in keys), F.col("__s")], [F.col(k) for k in keys]]
    rows = own.groupingSets(sets, *keys, "__s").agg(F.grouping("__s").alias("g"), F.count("*").alias("n"), *means)
    return rows.select(*keys, F.when(F.col("g") == 1, "total").otherwise(F.concat(F.lit(f"{stratum}="), "__s")).alias("estrato"), "n", *METRICS)


def evaluators(results: DataFrame) -> DataFrame:
    """Per query without a cut at k: hit_guid and recall_guid (null without targets), sem_erro."""
    u, al = unique_first(F.col("hits")), F.array_distinct("targets")
    shared = F.size(F.array_intersect(al, u))
    some = F.size(al) > 0
    return results.select(
        "query_id",
        F.when(some, (shared > 0).cast("double")).alias("hit_guid"),
        F.when(some, F.round(shared / F.size(al), 6)).alias("recall_guid"),
        F.when(F.coalesce("resposta", F.lit("")).startswith("ERRO"), 0.0).otherwise(1.0).alias("sem_erro"),
    )


def bootstrap(values: list[float], n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean; the places drawn are those of Python's seeded random module."""
    x = np.asarray(values, dtype=np.float64)
    if len(x) < 2:
        one = round(float(x[0]), 4) if len(x) else 0.0
        return one, one
    place = random.Random(seed).randrange
    drawn = np.fromiter((place(len(x)) for _ in range(n * len(x))), dtype=np.int64, count=n * len(x))
    # Summed one after another, as a plain sum does.
    means = np.sort(np.add.accumulate(x[drawn].reshape(n, -1), axis=1)[:, -1] / len(x))
    low, high = int(alpha / 2 * n), int((1 - alpha / 2) * n) - 1
    return round(float(means[low]), 4), round(float(means[high]), 4)


def bootstrap_by(measured: DataFrame, group: str | None, value: str, order: str) -> DataFrame:
    """(grp, n, low, high): the exact interval, values in the order given; a group is one evaluation's queries, None all of them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        low, high = bootstrap(part[value].astype(float).tolist())
        return pd.DataFrame({"grp": [str(part["grp"].iloc[0])], "n": [len(part)], "low": [low], "high": [high]})

    own = F.lit("total") if group is None else F.coalesce(F.col(group).cast("string"), F.lit("?"))
    rows = measured.select(own.alias("grp"), F.col(value).cast("double").alias(value), order)
    return rows.groupBy("grp").applyInPandas(run, "grp string, n long, low double, high double")


def hashed_bootstrap(measured: DataFrame, value: str, order: str, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(n, low, high) by resampling through hashes: distributed, and the same in any engine.

    Draw j of resample b takes the value at the place that the MD5 of (b, j, seed) gives,
    values being numbered by order. Not the same numbers as :func:`bootstrap`.
    """
    rows = numbered(measured.select(F.col(value).cast("double").alias("v"), order), order).select("v", "i")
    size = rows.agg(F.count("*").alias("m"))
    draws = rows.select(F.col("i").alias("j")).join(F.broadcast(size)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("j").cast("string"), F.lit(str(seed))).cast("binary"))
    draws = draws.select("b", F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), F.col("m")).alias("i"))
    means = draws.join(rows, "i").groupBy("b").agg(F.avg("v").alias("mean"))
    ordered = means.agg(F.array_sort(F.collect_list("mean")).alias("a"))  # n numbers
    lo, hi = int(alpha / 2 * n), int((1 - alpha / 2) * n) - 1
    return ordered.join(F.broadcast(size)).select(F.col("m").alias("n"), F.round(F.get("a", F.lit(lo)), 4).alias("low"), F.round(F.get("a", F.lit(hi)), 4).alias("high"))


#: A prime below 2^31 and multipliers that mix numbers modulo it; the cumulated Poisson(1) probabilities (fixed values).
PRIME, MIXERS = 2147483647, (48271, 69621, 16807)
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def poisson_weights(key: np.ndarray, n: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """(rows, n): how often each row counts in each resample, from its key (0 to PRIME - 1) alone."""
    b = np.arange(1, n + 1, dtype=np.int64)
    x = (key[:, None] * MIXERS[0] + b * MIXERS[1] + seed) % PRIME
    for m in MIXERS:  # all products stay below 2^63
        x = (x ^ (x >> 15)) % PRIME * m % PRIME
        x = (x * x + b) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, side="right")


def poisson_bootstrap(measured: DataFrame, value: str, key: str, group: str | None = None, n: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(grp, n, low, high): percentile intervals of means, each row counting Poisson(1) times in a resample.

    One pass: a task sums its rows' weights and weighted values of n resamples by group, and
    these sums are all that is shuffled. Weights follow from the MD5 of a row's key and the
    seed, the same in any engine and on any number of tasks. Without variance both ends are the mean.
    """
    own = F.lit("total") if group is None else F.coalesce(F.col(group).cast("string"), F.lit("?"))
    place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint") % PRIME
    rows = measured.where(F.col(value).isNotNull()).select(own.alias("grp"), F.col(value).cast("double").alias("v"), place.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            grp, v, at = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            for g in set(grp.tolist()):
                mine = np.flatnonzero(grp == g)
                total = sums.setdefault(g, [0, np.zeros(n, dtype=np.int64), np.zeros(n)])
                for lo in range(0, len(mine), 1024):
                    w = poisson_weights(at[mine[lo : lo + 1024]], n, seed)
                    total[0] += len(w)
                    total[1] += w.sum(axis=0)
                    total[2] += v[mine[lo : lo + 1024]] @ w
        for g, (count, w, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array(range(n), pa.int32()), pa.array([count] * n, pa.int64()), pa.array(w), pa.array(s)], names=["grp", "b", "n", "w", "s"])

    each = rows.mapInArrow(run, "grp string, b int, n long, w long, s double").groupBy("grp", "b").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    means = each.where("w > 0").groupBy("grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.round(F.col("s") / F.col("w"), 12))).alias("a"))  # n numbers a group
    at = lambda share: F.get("a", F.floor(F.lit(share) * (F.size("a") - 1)).cast("int"))
    return means.select("grp", "n", F.round(at(alpha / 2), 4).alias("low"), F.round(at(1 - alpha / 2), 4).alias("high"))


def held_by(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, texto) that hold a passage (query_id, query) as it is.

    What lies between a passage's first and last white space are whole words of such a
    document, so its longest one leads to the candidates; for passages without one (two words
    or fewer) their first three characters do.
    """
    words = F.split("query", r"\s+")
    inner = F.array_sort(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    keyed = passages.where("query <> ''").select("query_id", "query", F.nullif(F.get(inner, F.lit(0)), F.lit("")).alias("word"))
    whole = keyed.where("word is not null")
    # Of a document's words only asked ones leave its row.
    asked = few(whole.select(F.col("word").alias("term")).distinct(), 20_000)
    found = F.array_distinct(F.split("texto", r"\s+"))
    found = found if asked is None else F.array_intersect(found, F.lit(asked) if asked else F.array().cast("array<string>"))
    own = docs.select("doc_id", "texto", F.explode(found).alias("word"))
    found = own.join(small(whole), "word").select("query_id", "doc_id", "query", "texto")
    out = found.where(F.contains("texto", F.col("query"))).select("query_id", "doc_id")
    short = keyed.where("word is null").select("query_id", "query", F.substring("query", 1, 3).alias("gram"))
    sizes = [r.n for r in short.select(F.length("gram").alias("n")).distinct().collect()]  # 1, 2, 3
    if not sizes:
        return out
    # Of a short passage the first three characters lead to the candidates.
    keys = few(short.select(F.col("gram").alias("term")).distinct(), 20_000)
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("texto") - (n - 1)), lambda i: F.substring(F.col("texto"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(*(F.when(F.length("texto") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in sizes)))
    grams = grams if keys is None else F.array_intersect(grams, F.lit(keys))
    met = docs.select("doc_id", "texto", F.explode(grams).alias("gram")).join(small(short), "gram")
    return out.unionByName(met.where(F.contains("texto", F.col("query"))).select("query_id", "doc_id"))


def budget_stats(results: DataFrame) -> DataFrame:
    """Tokens (mean, population deviation, least, most) and blocks over rows where they aren't 0."""
    t, b = F.nullif(F.col("tokens_contexto"), F.lit(0)), F.nullif(F.col("n_blocos_usados"), F.lit(0))
    return results.agg(
        F.round(F.avg(t), 6).alias("tokens_media"), F.round(F.stddev_pop(t), 6).alias("tokens_desvio"), F.min(t).alias("tokens_min"), F.max(t).alias("tokens_max"), F.round(F.avg(b), 6).alias("blocos_media")
    )


def timing_means(results: DataFrame) -> DataFrame:
    """Mean seconds over rows without error; 0 where there are none."""
    ok = results.where(~F.coalesce("resposta", F.lit("")).startswith("ERRO"))
    return ok.agg(*[F.round(F.coalesce(F.avg(f"tempo_{x}_s"), F.lit(0.0)), 6).alias(f"{x}_medio_s") for x in ("retrieval", "geracao", "total")])


def run_stats(results: DataFrame) -> DataFrame:
    """Errors, and mean, least and most tokens, of a run."""
    return results.agg(
        F.count_if(F.coalesce("resposta", F.lit("")).startswith("ERRO")).alias("n_erros"), F.round(F.avg("tokens_contexto"), 6).alias("tokens_media"), F.min("tokens_contexto").alias("tokens_min"), F.max("tokens_contexto").alias("tokens_max")
    )


def judge_summary(scores: DataFrame) -> DataFrame:
    """Means, deviations, judged and failed of rows (faithfulness, answer_relevancy, correctness); null is a failure."""
    names = ["faithfulness", "answer_relevancy", "correctness"]
    cols = [F.round(f(n), 6).alias(n + s) for n in names for f, s in ((F.avg, ""), (F.stddev_pop, "_desvio"))]
    return scores.agg(F.count("faithfulness").alias("n"), F.count_if(F.col("faithfulness").isNull()).alias("falhas"), *cols)


#: Columns of the comparison: name, place in an evaluation summary.
COMPARED = {
    "precision@5": "$.retrieval['precision@5']", "hit@5": "$.retrieval['hit_rate@5']", "recall@5": "$.retrieval['recall@5']", "ndcg@5": "$.retrieval['ndcg@5']",
    "mrr": "$.retrieval.mrr", "hit_ident": "$.retrieval_estratificado['tipo=identificador']['hit_rate@5']", "hit_seman": "$.retrieval_estratificado['tipo=semantica']['hit_rate@5']",
    "faithful": "$.juiz_llm.faithfulness", "relevancy": "$.juiz_llm.answer_relevancy", "correctness": "$.juiz_llm.correctness",
    "tokens_ctx": "$.orcamento_contexto.tokens_media", "latencia_s": "$.tempos.total_medio_s",
}


def compare(runs: DataFrame, columns: list[str]) -> DataFrame:
    """A row per condition: runs, null-ignoring means, deviation of hit@5 (0 with one run), by name."""
    sd = F.when(F.count("hit@5") > 1, F.stddev_pop("hit@5")).otherwise(0.0)
    out = runs.groupBy("condicao").agg(F.count("*").alias("n_exec"), *[F.round(F.avg(F.col(f"`{c}`")), 6).alias(c) for c in columns], F.round(sd, 6).alias("hit@5_sd"))
    return out.orderBy("condicao")
