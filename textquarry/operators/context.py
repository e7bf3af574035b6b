"""Packing hits into a token budget, and answers from what was packed."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T

BUDGET = 6000


def kept_blocks(sizes: Column, budget: int = BUDGET) -> Column:
    """struct(t, k): tokens used and 0-based places of the blocks that fit, in order.

    A block that doesn't fit is skipped and later ones are still tried.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<int>").alias("k"), F.lit(0).alias("i"))

    def step(s, x):
        fits = s["t"] + x <= budget
        return F.struct(
            F.when(fits, s["t"] + x).otherwise(s["t"]).alias("t"), F.when(fits, F.array_append(s["k"], s["i"])).otherwise(s["k"]).alias("k"), (s["i"] + 1).alias("i")
        )

    out = F.aggregate(sizes, start, step)
    return F.struct(out["t"].alias("t"), out["k"].alias("k"))


def packed(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per query of blocks (query_id, rank, tokens, texto): tokens, n_used, used ranks, prefix ranks, context.

    prompt_ranks are the blocks in the context; reported_ranks the first n_used ones,
    which differ where a block in between was skipped.
    """
    rows = blocks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "tokens", "texto"))).alias("b"))
    rows = rows.withColumn("kept", kept_blocks(F.transform("b", lambda x: x["tokens"].cast("bigint")), budget))
    ranks = F.transform("b", lambda x: x["rank"])
    n = F.size("kept.k")
    texts = F.transform("kept.k", lambda i: F.get("b", i)["texto"])
    return rows.select(
        "query_id", F.col("kept.t").alias("tokens"), n.alias("n_used"), F.transform("kept.k", lambda i: F.get(ranks, i)).alias("prompt_ranks"),
        F.slice(ranks, F.lit(1), n).alias("reported_ranks"), F.array_join(texts, "\n\n").alias("context"),
    )


class Generator(Protocol):
    """Anything that answers prompts; made anew in each worker."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class Extractive:
    """Offline default: the first sentence of the top block."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            body = p.split("CONTEXTO LEGAL:\n", 1)[-1].split("\n\nPERGUNTA: ", 1)[0]
            lines = [x for x in body.split("\n") if x.strip("-") and not x.startswith("--- FONTE")]
            out.append((lines[0].split(". ")[0] if lines else "").strip())
        return out


class Chat:
    """A model that is asked by messages: the system's rules, if any, and the prompt."""

    def __init__(self, complete: Callable[[list[dict]], str], system: str | None = T.SYSTEM_PROMPT):
        self.complete, self.system = complete, system

    def __call__(self, prompts: list[str]) -> list[str]:
        rules = [{"role": "system", "content": self.system}] if self.system else []
        return [self.complete([*rules, {"role": "user", "content": p}]) for p in prompts]


class Patient:
    """A client that waits between calls and tries again when told that there were too many of them."""

    def __init__(self, call: Callable[[str], str], pause: float = 0.0, tries: int = 6, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep):
        self.call, self.pause, self.tries, self.wait, self.sleep = call, pause, tries, wait, sleep

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            for n in range(1, self.tries + 1):
                try:
                    out.append(self.call(p))
                    break
                except Exception as e:
                    if "429" not in str(e) or n == self.tries:
                        raise
                    self.sleep(self.wait * n)
            self.sleep(self.pause)
        return out


def answered(prompts: DataFrame, make=Extractive) -> DataFrame:
    """(query_id, resposta) of prompts (query_id, prompt).

    If a batch fails, its prompts are asked one by one; one that fails then becomes 'ERRO: ...'.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()

        def alone(prompt: str) -> str:
            try:
                return generate([prompt])[0]
            except Exception as e:  # a query that fails is a row, not a failed run
                return f"ERRO: {e}"

        for part in parts:
            asked = part["prompt"].fillna("").tolist()
            try:
                answers = generate(asked)
            except Exception:
                answers = [alone(p) for p in asked]
            yield pd.DataFrame({"query_id": part["query_id"], "resposta": answers})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, resposta string")


#: Characters of the context that a judge sees (a fixed value).
JUDGED_CHARS = 4000


def judge_prompt(question: Column, context: Column, reference: Column, answer: Column) -> Column:
    """What a judge is asked: three scores from 0 to 1 as one JSON object."""
    rules = (
        "Avalia a RESPOSTA de 0 a 1 em três pontos, usando só o que está abaixo. fidelidade: tudo o que diz está no CONTEXTO. "
        "relevancia: responde à PERGUNTA. correcao: concorda com a REFERÊNCIA. Devolve apenas um objeto JSON com estas três chaves.\n\n"
    )
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit(rules + "PERGUNTA:\n"), none(question), F.lit("\n\nCONTEXTO:\n"), F.substring(none(context), 1, JUDGED_CHARS),
        F.lit("\n\nREFERÊNCIA:\n"), none(reference), F.lit("\n\nRESPOSTA:\n"), none(answer),
    )


class OverlapJudge:
    """Offline default: shares of the answer's words that the context, the question and the reference have."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            parts = dict(zip(("q", "c", "r", "a"), re.split(r"\n\n(?:CONTEXTO|REFERÊNCIA|RESPOSTA):\n", p.split("PERGUNTA:\n", 1)[-1]), strict=False))
            words = {k: set(re.findall(r"\w+", v.lower())) for k, v in parts.items()}
            share = lambda x, y: round(len(x & y) / len(x), 4) if x else 0.0
            a = words.get("a", set())
            out.append(json.dumps({"fidelidade": share(a, words.get("c", set())), "relevancia": share(words.get("q", set()), a), "correcao": share(words.get("r", set()), a)}))
        return out


def judged(rows: DataFrame, make=OverlapJudge) -> DataFrame:
    """(query_id, faithfulness, answer_relevancy, correctness) of rows (query_id, query, context, referencia, resposta); null where the judge's answer can't be read."""
    asked = rows.select("query_id", judge_prompt(F.col("query"), F.col("context"), F.col("referencia"), F.col("resposta")).alias("prompt"))
    return answered(asked, make).select("query_id", T.judge_scores(F.col("resposta")).alias("s")).select("query_id", "s.*")
