"""Incremental ingestion (an extension): new dump files become segments, or go into an index, as they arrive.

Files already seen are remembered by the stream's checkpoint, so a run that stops
goes on where it was; each batch of segments is written once under its own folder, and a
batch that an index has taken already changes nothing when it comes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators import segment as S
from textquarry.plans.conditions import Condition, Index
from textquarry.sources.scratch import swept, written


def stream_segments(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes all files that wait in folder (JSON lines of doc_id, texto) and stops."""
    lines = spark.readStream.schema("doc_id string, texto string").json(folder)

    def one(batch: DataFrame, number: int) -> None:
        segs = S.segment_corpus(batch.where("texto is not null"))
        segs.withColumn("lote", F.lit(number)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark: SparkSession, folder: str, cond: Condition, root: str, checkpoint: str, embed=None) -> StreamingQuery:
    """Puts all documents that wait in folder into the condition's index under root, and stops.

    Lines are JSON (doc_id, titulo, texto, apagado); apagado true takes a document out. Of several
    lines of a document in a batch a living one counts before a deletion, and the greatest of those.
    """
    lines = spark.readStream.schema("doc_id string, titulo string, texto string, apagado boolean").json(folder)

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        with swept(session):
            rows = written(batch.where("doc_id is not null"), "batch")
            alive = rows.where(~F.coalesce("apagado", F.lit(False)) & F.col("texto").isNotNull())
            docs = written(alive.groupBy("doc_id").agg(F.max(F.struct("titulo", "texto")).alias("d")).select("doc_id", "d.*"), "batch-documents")
            gone = rows.where("apagado").select("doc_id").distinct()
            index = Index.load(session, root)
            index = cond.upsert(index, docs, gone, embed) if index.store.tables else cond.index(docs, embed, root)
            index.store.vacuum()

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
