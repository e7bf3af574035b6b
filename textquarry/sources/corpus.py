"""JSON corpus dumps: loading with an account of every rejected element.

A root may be a list or one object, and a list may hold anything; one odd element never
spoils its file. Files are cut into elements by :mod:`dumps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.sources import dumps, runs
from textquarry.sources.scratch import small, written

# Bounds that are themselves accepted.
LEAST_CHARS, MOST_CHARS = 50, 500_000
STATUSES = ["nao_dict", "erro_scraping", "sem_guid", "guid_duplicado", "vazio_ou_curto", "grande_demais", "aceite"]


def elements(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Array elements of the folder's files: ficheiro, pos, item (variant); broken files have one row, item null and pos -1.

    A root that is no list is one element. A file's name has as many parts as the pattern. Files of
    any size are read in pieces; a file breaks as a whole, by its structure or by any element.
    """
    rows = written(dumps.parsed(dumps.raw_elements(spark, folder, pattern)).select("ficheiro", "pos", "item"), "elements")
    broken = rows.where("item is null").select("ficheiro").distinct()
    whole = rows.join(small(broken), "ficheiro", "left_anti")
    return whole.unionByName(broken.select("ficheiro", F.lit(-1).alias("pos"), F.lit(None).cast("variant").alias("item")))


def _truthy(item: Column, path: str) -> Column:
    kind = F.coalesce(F.try_variant_get(item, path, "string"), F.lit(""))
    return ~kind.isin("", "false", "0", "0.0", "-0.0", "[]", "{}")


def classified(items: DataFrame, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """Elements with ord (file order, then place) and estado, the first rule that rejects them or 'aceite'."""
    shape = F.schema_of_variant("item")
    # Of the object itself: a guid in an object that it holds is none of its own. A null one counts.
    has_id = F.array_contains(F.json_object_keys(F.to_json("item")), "guid")
    guid = F.when(has_id, T.strip(F.coalesce(F.try_variant_get("item", "$.guid", "string"), F.lit("None"))))
    rows = items.select(
        "ficheiro", "pos", shape.alias("shape"), F.col("item").isNull().alias("broken"), guid.alias("id"),
        _truthy(F.col("item"), "$.error").alias("error"),
        F.coalesce(F.try_variant_get("item", "$.title", "string"), F.lit("")).alias("titulo"),
        F.coalesce(F.try_variant_get("item", "$.url", "string"), F.lit("")).alias("url"),
        T.strip(F.coalesce(F.try_variant_get("item", "$.article_text", "string"), F.lit(""))).alias("texto"),
    )
    rows = rows.withColumn("n_chars", F.length("texto")).withColumn("at", F.struct("ficheiro", "pos"))
    early = (
        F.when(F.col("broken"), "ficheiro_partido")
        .when(~F.col("shape").startswith("OBJECT"), "nao_dict")
        .when(F.col("error"), "erro_scraping")
        .when(F.coalesce("id", F.lit("")) == "", "sem_guid")
    )
    rows = rows.withColumn("early", early)
    fits = F.col("early").isNull() & F.col("n_chars").between(least, most)
    # A guid is taken from its first accepted element on. What is rejected before has a window of its own.
    alone = F.when(F.col("early").isNotNull(), F.concat_ws("\x00", "ficheiro", F.col("pos").cast("string")))
    first = F.min(F.when(fits, F.col("at"))).over(Window.partitionBy(F.when(F.col("early").isNull(), F.col("id")), alone))
    late = (
        F.when(F.col("at") > F.col("first"), "guid_duplicado").when(F.col("n_chars") < least, "vazio_ou_curto").when(F.col("n_chars") > most, "grande_demais").otherwise("aceite")
    )
    return rows.withColumn("first", first).withColumn("estado", F.coalesce("early", late)).drop("first", "early", "shape", "broken", "error")


def documents(rows: DataFrame) -> DataFrame:
    """Accepted elements as documents: id, titulo, tipo, numero, data_publicacao, texto, url, n_chars, ficheiro_origem, pos."""
    own = rows.where("estado = 'aceite'").withColumn("t", T.parse_title(F.col("titulo")))
    return own.select("id", "titulo", "t.tipo", "t.numero", "t.data_publicacao", "texto", "url", "n_chars", F.col("ficheiro").alias("ficheiro_origem"), "pos")


def load(spark: SparkSession, folder: str, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> DataFrame:
    return documents(classified(elements(spark, folder), least, most))


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("estado").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values by falling count, ties by first appearance."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def length_stats(rows: DataFrame, n: str = "n_chars") -> DataFrame:
    """Least, most, median, mean and three length bands; zeros for an empty table."""
    zero = F.lit(0)
    c = F.col(n)
    return rows.agg(
        F.count("*").alias("n"), F.coalesce(F.min(c), zero).cast("bigint").alias("minimo"), F.coalesce(F.max(c), zero).cast("bigint").alias("maximo"),
        F.round(F.coalesce(F.median(c), F.lit(0.0)), 6).alias("mediana"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("media"),
        F.count_if(c < 2000).alias("ate_2000"), F.count_if(c.between(2000, 8000)).alias("de_2000_a_8000"), F.count_if(c > 8000).alias("acima_8000"),
    )


def corpus_fingerprint(docs: DataFrame, least: int = LEAST_CHARS, most: int = MOST_CHARS, id_column: str = "id") -> DataFrame:
    """One row: 16 hex digits of the bounds and the ids, whatever their order.

    Ids go in as their number and two sums of 60 bits of their MD5 each, so no row holds them all.
    """
    h = F.md5(F.col(id_column).cast("string").cast("binary"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string"), F.lit("0"))
    one = docs.agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return one.select(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{least}:{most}"), "n", "a", "b").cast("binary"), 256), 1, 16).alias("fingerprint"))


def report(rows: DataFrame, path: str, least: int = LEAST_CHARS, most: int = MOST_CHARS, oversized: int = 20) -> None:
    """Writes the account of a load as one JSON row."""
    counts = reject_counts(rows).agg(F.map_from_entries(F.collect_list(F.struct("estado", "n"))).alias("contagens"))
    kept = documents(rows)
    types = kept.groupBy("tipo").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("tipo", "n"))).alias("tipos"))
    large = rows.where("estado = 'grande_demais'").orderBy("ficheiro", "pos").limit(oversized).agg(F.collect_list(F.struct("id", "n_chars")).alias("grandes"))
    out = counts.join(types).join(length_stats(kept)).join(large).withColumns({"min_chars": F.lit(least), "max_chars": F.lit(most)})
    out.coalesce(1).write.mode("overwrite").json(path)


def question_file(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array file; an empty one is an error."""
    schema = "id string, query string, tipo string, camada int, ground_truth string, documentos_esperados array<string>, ancora string, para_geracao boolean"
    rows, _, so, _ = runs.lined(spark, path, schema, lambda c: c == "[", "]")
    # A question a line is read by many tasks, any other layout as a whole.
    rows = rows.select("r.*") if so else spark.read.schema(schema).json(path, multiLine=True)
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows
