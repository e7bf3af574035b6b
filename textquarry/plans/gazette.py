"""A gazette-like corpus from the star schema: one act per order, one article per line.

It gives titles, numbers, summaries, articles and citations that resolve, so that the
document operators have something of their kind to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONTH_NAMES = ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gazette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id bigint, titulo, texto."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), "l_partkey", "l_suppkey")
    own = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "l_suppkey", "l_partkey"))).alias("lines"))  # a handful a order
    year = F.year("o_orderdate").cast("string")

    def article(x):
        return F.concat(
            F.lit("Artigo "), x["n"].cast("string"), F.lit(".º\n"), x["n"].cast("string"), F.lit(" - FORNECEDOR "), x["l_suppkey"].cast("string"),
            F.lit(", nos termos do Despacho n.º "), x["l_partkey"].cast("string"), F.lit("/"), year, F.lit("."),
        )

    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("o_orderdate"))
    title = F.concat(F.lit("Despacho "), F.col("o_orderkey").cast("string"), F.lit("/"), year, F.lit(", de "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), month)
    head = F.concat(
        F.lit("Sumário: "), "o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" do cliente "), F.col("o_custkey").cast("string"),
        F.lit(".\nEntidade adjudicante: Cliente "), F.col("o_custkey").cast("string"), F.lit("\n"),
    )
    body = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<n:int,l_suppkey:bigint,l_partkey:bigint>>")), article), "\n")
    return orders.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), title.alias("titulo"), F.concat(head, body).alias("texto"))


#: The same corpus in DuckDB's SQL, as the CTE g(doc_id, titulo, texto).
GAZETTE_SQL = """
gl AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS n FROM lineitem),
gb AS (SELECT o_orderkey, string_agg('Artigo ' || n || '.º' || chr(10) || n || ' - FORNECEDOR ' || l_suppkey ||
  ', nos termos do Despacho n.º ' || l_partkey || '/' || year(o_orderdate) || '.', chr(10) ORDER BY n) AS body
  FROM gl JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey),
g AS (SELECT o.o_orderkey AS doc_id, 'Despacho ' || o.o_orderkey || '/' || year(o_orderdate) || ', de ' || day(o_orderdate) || ' de ' ||
  (['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', 'Setembro', 'Outubro', 'Novembro', 'Dezembro'])[month(o_orderdate)] AS titulo,
  'Sumário: ' || o_orderpriority || ' ' || o_orderstatus || ' do cliente ' || o_custkey || '.' || chr(10) ||
  'Entidade adjudicante: Cliente ' || o_custkey || chr(10) || coalesce(body, '') AS texto
  FROM orders o LEFT JOIN gb USING (o_orderkey))
"""
