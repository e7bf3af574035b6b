"""Conditions of the benchmark: how a corpus is cut, indexed and searched.

A condition turns documents (doc_id, titulo, texto) into an index of tables, and an index
and questions (query_id, query) into hits (query_id, doc_id, chunk_id, score, rank,
method) for all questions at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import cells as cells_
from textquarry.operators import retrieve as R
from textquarry.operators import segment as S
from textquarry.operators import sparse, splitters
from textquarry.sources.parts import Staged, Store
from textquarry.sources.scratch import freed, shared, small, swept, written


def described(docs: DataFrame) -> DataFrame:
    """Documents with title parts, frontmatter and citations."""
    own = docs.withColumn("t", T.parse_title(F.col("titulo")))
    own = own.select("doc_id", "titulo", "texto", "t.tipo", "t.numero", "t.data_publicacao")
    fm = T.frontmatter(F.col("tipo"), F.col("numero"), F.col("data_publicacao"), F.col("texto"))
    return own.withColumn("fm", fm).withColumn("citacoes", T.citations(F.col("texto"), F.col("numero")))


@dataclass(frozen=True)
class Condition:
    """family-variant, with what decides its index and its search."""

    name: str
    family: str
    search: str  # dense, sparse or hybrid
    chunk: Callable[[DataFrame], DataFrame] = field(compare=False)
    enriched: bool = False
    graph: bool = False

    def config(self) -> dict:
        return {"family": self.family, "search": self.search, "enriched": self.enriched, "graph": self.graph, "k1": R.K1, "b": R.B, "rrf_k0": R.RRF_K0, "prefetch": R.PREFETCH}

    def segments(self, docs: DataFrame) -> DataFrame:
        """PAYLOAD columns of docs (doc_id, titulo, texto), one row a segment."""
        own = described(docs)
        out = self.chunk(own)
        text = T.enriched(F.col("fm"), F.col("texto")) if self.enriched else F.col("texto")
        return out.withColumns({"texto_embebido": text, "point_id": T.point_id(F.col("chunk_id"))}).select(*PAYLOAD)

    def index(self, docs: DataFrame, embed: Callable | None = None, root: str | None = None, buckets: int | None = None, cells: bool = False, config: str | None = None, points: bool = True) -> Index:
        """All that a search needs of docs (doc_id, titulo, texto), as tables under root (else in the shared folder), which replace those of before.

        Documents lie in buckets by the hash of their ids, about BUCKET each; vectors as well, or in cells.
        Beside the index the disk holds documents twice for a while, and a part of what dealing them takes.
        points: whether it can be scanned by pages; a search doesn't read these.
        """
        spark = docs.sparkSession
        store = Store.open(spark, (root or shared(spark, "index")).rstrip("/"))
        with freed(spark):
            with swept(spark):
                docs = written(docs.select("doc_id", "titulo", "texto"), "documents")  # read again in each pass
                n = buckets or max(1, -(-docs.count() // BUCKET))
                dealt = store.stage("documents", marked(docs, n), "bucket", ["doc_id"], passes=min(n, PASSES))
            info = {"buckets": n, "search": self.search, "cells": cells, "config": config, "points": points}
            return Index(store.commit(*self._staged(store, dealt, embed, info)), info)

    def prompt(self, context: Column, question: Column) -> Column:
        """What a model is asked; the sentence family's template names the system's rules itself."""
        return T.qa_prompt(context, question) if self.family == "llamaindex" else T.prompt(context, question)

    def _vectors(self, segs: DataFrame, embed: Callable | None, n: int) -> DataFrame:
        """(doc_id, vector, bucket) of segments; doc_id is the segment's."""
        text = F.col("texto_embebido")
        texts = segs.select(F.col("chunk_id").alias("doc_id"), (T.passage_prefixed(text) if embed else text).alias("texto"))
        return R.embedded(texts, embed).withColumn("bucket", bucket_of(document_of(F.col("doc_id")), n))

    def _staged(
        self, store: Store, docs: DataFrame | Staged, embed: Callable | None, info: dict, kept: dict[str, DataFrame] | None = None, parts: dict[str, list] | None = None, segs: DataFrame | None = None, vectors: DataFrame | None = None
    ) -> tuple[dict[str, Staged], dict | None, dict]:
        """(staged tables, their parts that are replaced, info) of marked documents, beside what is kept of the tables; segs, vectors: where they are made already.

        Without segs docs are staged, in their buckets; they go when nothing more is made of them.
        """
        kept, out, n = kept or {}, {}, info["buckets"]

        def put(name: str, df: DataFrame, part: str = "bucket", **how) -> DataFrame:
            df = df.unionByName(kept[name]) if name in kept else df
            out[name] = store.stage(name, df, part, **how)
            return store.staged(out[name])

        dealt, first = docs, segs is None
        if first:
            # Documents lie in their buckets whole, so that what is made of them is where it belongs.
            docs = store.staged(dealt)
            own = self.segments(docs).withColumn("bucket", bucket_of(F.col("doc_id"), n))
            segs = _whole(put("segments", _kept(own), order=["doc_id"], stay=True))
        put("marks", docs.select("doc_id", "bucket", "mark"), order=["doc_id"], stay=first)
        if self.graph:
            cited = described(docs).select("doc_id", "numero", "citacoes").withColumn("bucket", bucket_of(F.col("doc_id"), n))
            put("cited", cited, stay=first)
        if first:
            store.drop(dealt)
        if info.get("points", True):
            points = segs.select(range_of(F.col("point_id")).alias("range"), *POINT)
            if first:
                # A task writes a file of each range, so it takes enough points to fill these.
                points = points.coalesce(max(store.spark.sparkContext.defaultParallelism, segs.count() // (RANGE_ROWS << RANGE_BITS)))
            put("points", points, "range", order=["doc_id"], stay=first)
        whole = segs if "segments" in out else _whole(put("segments", _kept(segs), order=["doc_id"]))
        if self.search != "dense":
            # The bucket's lists are made anew, of all its segments, by the tasks that read these.
            if "shard" not in info:
                info["shard"] = max(1, min(sparse.SHARD, -(-whole.count() // store.spark.sparkContext.defaultParallelism)))
            texts = whole.select(F.col("chunk_id").alias("doc_id"), F.col("texto_embebido").alias("texto"), "bucket")
            out["lists"] = store.stage("lists", sparse.shards_of_texts(texts, info["shard"]), "bucket", ["sub"], stay=True)
        if self.search != "sparse":
            vectors = self._vectors(segs, embed, n) if vectors is None else vectors
            if not info["cells"]:
                put("vectors", vectors, stay=first)
            elif "vectors" in kept:
                put("vectors", vectors, "cell")
            else:
                _, out["vectors"], told, _ = cells_.laid(store, vectors)
                info |= told
        return out, parts, info

    def upsert(self, index: Index, docs: DataFrame, deleted: DataFrame | None = None, embed: Callable | None = None) -> Index:
        """The index with docs (doc_id, titulo, texto) put in or replaced, and deleted ones (doc_id) gone.

        Documents whose content is as stored change nothing. Only buckets (and cells, ranges of
        points) that a changed document is or was in are written anew, and one manifest switches
        them all; a search then finds what a whole rebuild would.
        """
        store, info = index.store, dict(index.info)
        spark, n = store.spark, info["buckets"]
        new = written(marked(docs, n), "new")
        old = store.read("marks")
        changed = new.join(old.select("doc_id", F.col("mark").alias("known")), "doc_id", "left").where(~F.col("mark").eqNullSafe(F.col("known"))).drop("known")
        gone = changed.select("doc_id", "bucket")
        if deleted is not None:
            lost = deleted.select("doc_id").distinct().join(new.select("doc_id"), "doc_id", "left_anti")
            gone = gone.unionByName(old.join(lost, "doc_id", "left_semi").select("doc_id", "bucket"))
        gone = written(gone, "touched")
        buckets = [r.bucket for r in gone.select("bucket").distinct().collect()]  # of a fixed number
        if not buckets:
            return index
        changed = written(changed, "changed")
        stays = lambda df: df.join(gone.select("doc_id"), "doc_id", "left_anti")
        names = [t for t in ("marks", "segments", "cited") if t in store.tables]
        held = lambda t: store.read(t, buckets).drop("ranges")  # noqa: E731  (marks of older indexes have them)
        kept, parts = {t: stays(held(t)) for t in names}, {t: buckets for t in (*names, "lists") if t in store.tables}
        segs, vectors = written(self.segments(changed).withColumn("bucket", bucket_of(F.col("doc_id"), n)), "segments"), None
        if "points" in store.tables:
            ranges = store.read("segments", buckets).join(gone.select("doc_id"), "doc_id", "left_semi").unionByName(segs, allowMissingColumns=True).select(range_of(F.col("point_id")).alias("range"))
            parts["points"] = [r.range for r in ranges.distinct().collect()]
            kept["points"] = stays(store.read("points", parts["points"]))
        if "vectors" in store.tables:
            vectors = self._vectors(segs, embed, n)
            dead = written(store.read("segments", buckets).join(gone.select("doc_id"), "doc_id", "left_semi").select(F.col("chunk_id").alias("doc_id")), "dead")
            parts["vectors"] = buckets
            if info["cells"]:
                # Old cells by where the old vectors lie; new ones after the centres, which stay.
                vectors = written(cells_.assigned(vectors, np.array(info["centres"]).reshape(-1, info["dims"])), "new-vectors")
                was = store.read("vectors").select("doc_id", "cell", "bucket").where(F.col("bucket").isin(buckets)).join(dead, "doc_id", "left_semi").select("cell")
                parts["vectors"] = [r.cell for r in was.unionByName(vectors.select("cell")).distinct().collect()]
                info["farthest"] = np.minimum(info["farthest"], cells_.farthest(vectors, len(info["farthest"]))).tolist()
            kept["vectors"] = store.read("vectors", parts["vectors"]).join(dead, "doc_id", "left_anti")
        return Index(store.commit(*self._staged(store, changed, embed, info, kept, parts, segs, vectors)), info)

    def hits(self, index: Index, queries: DataFrame, k: int = 5, embed: Callable | None = None, recall: float | None = None) -> DataFrame:
        """k best chunks of each query (query_id, query), and documents that they cite, with graph.

        The dense side is exact; in an index with cells, recall asks for so many near cells as that takes.
        """
        n = R.PREFETCH if self.search == "hybrid" else k
        ranked = []
        if self.search != "dense":
            ranked.append(sparse.search(index.lists, sparse.query_terms(queries), n))
        if self.search != "sparse":
            asked = queries.select(F.col("query_id").alias("doc_id"), (T.query_prefixed(F.col("query")) if embed else F.col("query")).alias("texto"))
            asked = R.embedded(asked, embed).withColumnRenamed("doc_id", "query_id")
            ranked.append(cells_.Cells.of(index.store).search(asked, n, recall=recall) if index.info["cells"] else R.dense_topk(index.vectors, asked, n, alike=embed is None))
        best = R.rrf(ranked, k) if self.search == "hybrid" else ranked[0]
        doc_id = document_of(F.col("doc_id")).cast(index.segments.schema["doc_id"].dataType)
        hits = best.select("query_id", doc_id.alias("doc_id"), F.col("doc_id").alias("chunk_id"), "score", "rank", F.lit(self.search).alias("method"))
        if not self.graph:
            return hits
        hits = written(hits, "hits")
        extra = written(R.expand(hits, index.edges, index.numbers), "expansion")
        first = R.first_segment(index.segments.join(small(extra.select(F.col("target").alias("doc_id")).distinct()), "doc_id", "left_semi"))
        tail = R.with_expansion(hits.select("query_id", "doc_id", "score", "rank"), extra).where("method = 'grafo_expansao'")
        return hits.unionByName(tail.join(first, "doc_id").select(*hits.columns))


#: What an index stores of a segment, and what a page of its points shows.
PAYLOAD = ["doc_id", "chunk_id", "point_id", "titulo", "tipo", "numero", "data_publicacao", "nivel_segmentacao", "texto", "texto_embebido"]
POINT = ["doc_id", "chunk_id", "point_id", "titulo", "tipo", "numero", "data_publicacao", "nivel_segmentacao"]
#: Documents of a bucket, about; points lie in ranges by so many leading bits of their 60; points of a page.
BUCKET, RANGE_BITS, PAGE = 20_000, 6, 256
#: Documents are dealt to their buckets in so many passes; points of a range that a task writes, about, where there are many.
PASSES, RANGE_ROWS = 4, 20_000


def bucket_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(n)).cast("int")


def document_of(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, "::[0-9]+$", "")


def range_of(point_id: Column) -> Column:
    return F.shiftright(point_id, 60 - RANGE_BITS).cast("int")


def marked(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, titulo, texto) with bucket, and mark, a hash of the content."""
    mark = F.sha2(F.concat_ws("\x00", F.coalesce("titulo", F.lit("\x01")), F.coalesce("texto", F.lit("\x01"))).cast("binary"), 256)
    return docs.select("doc_id", "titulo", "texto", bucket_of(F.col("doc_id"), buckets).alias("bucket"), mark.alias("mark"))


def _kept(segs: DataFrame) -> DataFrame:
    """Segments as they are stored: what is embedded is null where it is the text."""
    return segs.withColumn("texto_embebido", F.when(~F.col("texto_embebido").eqNullSafe(F.col("texto")), F.col("texto_embebido")))


def _whole(segs: DataFrame) -> DataFrame:
    return segs.withColumn("texto_embebido", F.coalesce("texto_embebido", "texto"))


@dataclass
class Index:
    """A version of a condition's stored tables: segments, points, and as the search needs them lists, vectors, citations."""

    store: Store
    info: dict

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Index:
        store = Store.open(spark, root)
        return cls(store, store.info)

    @property
    def segments(self) -> DataFrame:
        return _whole(self.store.read("segments")).drop("bucket")

    @property
    def vectors(self) -> DataFrame:
        return self.store.read("vectors")

    @property
    def lists(self) -> DataFrame:
        return self.store.read("lists")

    @property
    def edges(self) -> DataFrame:
        return R.citation_edges(self.store.read("cited"))

    @property
    def numbers(self) -> DataFrame:
        return R.number_index(self.store.read("cited"))

    def page(self, token: tuple[int, int, str] | None = None, n: int = PAGE) -> tuple[list, tuple[int, int, str] | None]:
        """(n points in order of point_id, the token to go on with; None at the end).

        A token names the version that the scan began with, so that what is put in meanwhile
        neither repeats nor hides a point. Only ranges from the last point on are read.
        """
        if not self.info.get("points", True):
            raise ValueError(f"the index in {self.store.root} was made without points, which pages are made of")
        version, last, chunk = token or (self.store.version, -1, "")
        store = self.store if version == self.store.version else Store.open(self.store.spark, self.store.root, version)
        rows: list = []
        after = (F.col("point_id") > last) | (F.col("point_id") == last) & (F.col("chunk_id") > chunk)
        for part in sorted(int(p) for p in store.tables.get("points", {})):
            if part < last >> (60 - RANGE_BITS):
                continue
            rows += store.read("points", [part]).where((F.col("point_id") >= last) & after).orderBy("point_id", "chunk_id").limit(n + 1 - len(rows)).select(*POINT).collect()
            if len(rows) > n:
                return rows[:n], (version, rows[n - 1].point_id, rows[n - 1].chunk_id)
        return rows, None

    def pages(self, n: int = PAGE) -> Iterator[list]:
        """All points, a page at a time."""
        token = None
        while True:
            rows, token = self.page(token, n)
            if rows:
                yield rows
            if token is None:
                return


def _plain(docs: DataFrame) -> DataFrame:
    return S.segment_corpus(docs)


def _recursive(docs: DataFrame) -> DataFrame:
    return splitters.split_with(docs, splitters.recursive_pieces, "recursivo").join(docs.drop("texto"), "doc_id")


def _sentences(docs: DataFrame) -> DataFrame:
    """Pieces leave room for what stands before each: id, title, type and number."""
    told = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("doc_id", "titulo", "tipo", "numero")))
    return splitters.split_with(docs, splitters.sentence_pieces, "frase", T.token_estimate(told)).join(docs.drop("texto"), "doc_id")


CONDITIONS = {
    c.name: c
    for c in (
        Condition("langchain", "langchain", "dense", _recursive),
        Condition("llamaindex", "llamaindex", "dense", _sentences),
        Condition("hibrido-denso", "hibrido", "dense", _plain),
        Condition("hibrido-esparso", "hibrido", "sparse", _plain),
        Condition("hibrido-hibrido", "hibrido", "hybrid", _plain),
        Condition("estrutural-enriquecido", "estrutural", "hybrid", _plain, enriched=True),
        Condition("estrutural-enriquecido_grafo", "estrutural", "hybrid", _plain, enriched=True, graph=True),
    )
}


def condition(name: str) -> Condition:
    key = name.strip().lower()
    if key not in CONDITIONS:
        raise ValueError(f"unknown condition {name!r}; known: {', '.join(CONDITIONS)}")
    return CONDITIONS[key]


def family(name: str) -> list[Condition]:
    """All variants of a family, for ablation."""
    found = [c for c in CONDITIONS.values() if c.family == name.strip().lower()]
    if not found:
        raise ValueError(f"unknown family {name!r}")
    return found
