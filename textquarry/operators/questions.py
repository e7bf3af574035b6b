"""Questions from documents' summaries, and the question file."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.sources.scratch import numbered, written

# Fixed values.
LEAST, MOST, FOR_GENERATION, SEED = 25, 160, 15, 42


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tipo, numero, texto) of the target types with a summary of a fitting length."""
    own = docs.where(F.col("tipo").isin(T.TARGET_TYPES)).withColumn("sumario", T.question_summary(F.col("texto")))
    return own.where(F.length("sumario").between(LEAST, MOST)).select("doc_id", "tipo", "numero", "sumario")


def unique_summaries(found: DataFrame) -> DataFrame:
    """Those candidates whose summary no other candidate has."""
    once = found.groupBy("sumario").agg(F.count("*").alias("n")).where("n = 1").select("sumario")
    return found.join(once, "sumario")


def questions(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One question per unique summary, in an order that the seed and the ids decide.

    The longest summaries (ties by order) are marked for generation.
    """
    # Texts are parsed once: the candidates are read for the counts, the join and the ranges.
    valid = unique_summaries(written(candidates(docs), "candidates"))
    rows = numbered(valid.withColumn("mix", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")).cast("binary"))), "mix", "doc_id")
    rich = rows.orderBy(F.desc(F.length("sumario")), "i").limit(FOR_GENERATION).select("i", F.lit(True).alias("rich"))
    return rows.join(F.broadcast(rich), "i", "left").select(  # FOR_GENERATION rows
        T.question_id(F.col("tipo"), F.col("i")).alias("id"),
        T.question_text(F.col("tipo"), F.col("sumario"), F.col("i")).alias("query"),
        F.lit("identificador").alias("tipo"),
        F.lit(1).alias("camada"),
        F.col("sumario").alias("ground_truth"),
        F.array("doc_id").alias("documentos_esperados"),
        F.concat_ws(" ", "tipo", "numero").alias("ancora"),
        F.coalesce("rich", F.lit(False)).alias("para_geracao"),
    )


def seeded_order(n: int, seed: int = SEED) -> list[int]:
    """The order in which Python's seeded shuffle leaves n rows."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def shuffled(rows: DataFrame, *order: str, seed: int = SEED) -> DataFrame:
    """rows (numbered by order) with place: where Python's seeded shuffle puts each.

    The permutation is made on the driver from the number of rows, 16 bytes a row.
    """
    own = numbered(rows, *order, name="at")
    places = list(enumerate(seeded_order(own.count(), seed)))
    return own.join(rows.sparkSession.createDataFrame([(at, place) for place, at in places], "at long, place long"), "at").drop("at")


def merged(generated: DataFrame, manual: DataFrame) -> DataFrame:
    """Generated and manual questions as one table."""
    return generated.unionByName(manual, allowMissingColumns=True)
