"""Segmentation: articles, sliding windows, one block; and what it is diagnosed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T

# Fixed values of segmentation.
SINGLE_BLOCK, WINDOW, OVERLAP, LEAST, LEAST_RATIO = 8000, 4000, 400, 40, 0.6
#: What stands before an article while a text is cut, and what a U+0001 of the text becomes meanwhile.
_MARK, _OWN = "\u0001\u0002", "\u0001\u0003"
#: What stands between an article's number and its text meanwhile.
_NUMBER = "\u0001\u0004"
SEGMENT = "array<struct<texto:string,rotulo:string,nivel:string>>"


def is_articulated(text: Column) -> Column:
    """Whether headings form a real sequence of articles: two at least, the first 1 or 2
    at most, and of the steps between them a share of LEAST_RATIO 0 or 1."""
    return T.let(T.article_numbers(text), _real)


def _real(nums: Column) -> Column:
    n = F.size(nums)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get(nums, i) - F.get(nums, i - 1)).isin(0, 1))
    good = F.size(F.filter(steps, lambda x: F.coalesce(x, F.lit(False))))
    return F.coalesce((n >= 2) & (F.get(nums, F.lit(0)) <= 2) & (good / F.nullif(n - 1, F.lit(0)) >= LEAST_RATIO), F.lit(False))


def _segment(texto: Column, rotulo: Column, nivel: str) -> Column:
    return F.struct(texto.alias("texto"), rotulo.alias("rotulo"), F.lit(nivel).alias("nivel"))


def _cut(text: Column) -> Column:
    """The text before its first article heading, then for each heading its number, _NUMBER and the text from it on."""
    own = F.replace(text, F.lit("\u0001"), F.lit(_OWN))
    return F.split(F.regexp_replace(own, T.ANY_CASE + T.RE_ARTICLE, f"{_MARK}$1{_NUMBER}$0"), _MARK, -1)


def _number(part: Column) -> Column:
    return F.substring_index(part, _NUMBER, 1)


def _articles(parts: Column) -> Column:
    def named(p: Column, i: Column) -> Column:
        title = F.when(i == 0, F.lit("preambulo")).otherwise(F.concat(F.lit("Artigo "), _number(p)))
        body = F.when(i == 0, p).otherwise(F.substring_index(p, _NUMBER, -1))
        return _segment(T.strip(F.replace(body, F.lit(_OWN), F.lit("\u0001"))), title, "artigo")

    return F.filter(F.transform(parts, named), lambda s: F.length(s["texto"]) >= LEAST)


def by_article(text: Column) -> Column:
    """Preamble and articles; segments under LEAST stripped characters are left out."""
    return T.let(_cut(text), _articles)


def by_window(text: Column, width: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of width characters, each starting width - overlap after the one before."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(width - overlap))
    rows = F.transform(starts, lambda o: _segment(T.strip(F.substring(text, o + 1, F.lit(width))), F.concat(F.lit("janela@"), o.cast("string")), "janela"))
    return F.when(F.length(text) > 0, F.filter(rows, lambda s: s["texto"] != "")).otherwise(F.array().cast(SEGMENT))


def segments(text: Column) -> Column:
    """Articles where the text has them, else one block up to SINGLE_BLOCK, else windows."""
    block = F.array(_segment(text, F.lit("documento"), "bloco"))

    def articles(parts: Column) -> Column:
        # Headings are looked for once, for their numbers and for where the text is cut.
        nums = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _number(p).try_cast("decimal(38,0)"))
        return F.when(T.let(nums, _real), _articles(parts))

    cut = T.let(_cut(text), articles)
    return F.coalesce(cut, F.when(F.length(text) <= SINGLE_BLOCK, block).otherwise(by_window(text)))


def segment_corpus(docs: DataFrame) -> DataFrame:
    """One row per segment of docs (doc_id, texto, ...): chunk_id, chunk_ix, texto, rotulo, nivel_segmentacao."""
    rest = [c for c in docs.columns if c not in ("texto",)]
    out = docs.select(*rest, F.posexplode(segments(F.col("texto"))).alias("chunk_ix", "s"))
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("chunk_ix").cast("string"))
    return out.select(*rest, chunk.alias("chunk_id"), "chunk_ix", "s.texto", "s.rotulo", F.col("s.nivel").alias("nivel_segmentacao"))


def segment_report(segs: DataFrame) -> DataFrame:
    """One row: numbers of segments and documents; mean, median, most a document; documents by level."""
    level = F.coalesce(F.min_by(F.when(F.col("rotulo") != "preambulo", F.col("nivel_segmentacao")), F.when(F.col("rotulo") != "preambulo", F.col("chunk_ix"))), F.lit("bloco"))
    per = segs.groupBy("doc_id").agg(F.count("*").alias("n"), level.alias("nivel"))
    counts = [F.count_if(F.col("nivel") == x).alias(f"docs_{x}") for x in ("artigo", "bloco", "janela")]
    return per.agg(F.sum("n").alias("n_segmentos"), F.count("*").alias("n_documentos"), F.round(F.avg("n"), 6).alias("media"), F.round(F.median("n"), 6).alias("mediana"), F.max("n").alias("maximo"), *counts)


def firing_types(docs: DataFrame, most: int = 10) -> DataFrame:
    """(tipo, n): the types of docs (doc_id, tipo, texto) in which most texts have an article heading."""
    fires = docs.where(F.col("texto").rlike(T.ANY_CASE + T.RE_ARTICLE))
    return fires.groupBy("tipo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tipo").limit(most)


def firing_samples(docs: DataFrame, types: list[str], n_docs: int = 5, n_headings: int = 3) -> DataFrame:
    """(tipo, doc_id, amostras): of each of these types the first documents with article headings, with their first headings."""
    found = F.regexp_extract_all("texto", F.lit(T.ANY_CASE + T.RE_ARTICLE), F.lit(0))
    fires = docs.where(F.col("tipo").isin(types) & F.col("texto").rlike(T.ANY_CASE + T.RE_ARTICLE))
    placed = fires.withColumn("place", F.row_number().over(Window.partitionBy("tipo").orderBy("doc_id"))).where(F.col("place") <= n_docs)
    return placed.select("tipo", "doc_id", F.slice(found, 1, n_headings).alias("amostras"))


def most_sections(docs: DataFrame, most: int = 15) -> DataFrame:
    """(doc_id, tipo, n, n_chars): of docs (doc_id, tipo, texto) with two level-1 section headings at least those with most, ties by doc_id."""
    n = F.size(T.section_headings(F.col("texto")))
    return docs.select("doc_id", "tipo", n.alias("n"), F.length("texto").alias("n_chars")).where("n >= 2").orderBy(F.desc("n"), "doc_id").limit(most)
