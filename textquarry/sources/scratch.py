"""Tables that cut a lineage, in the folder that driver and executors share; and row numbers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Made(threading.local):
    """Paths that this thread has made."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session leaves it unset, a folder of this machine does for a session that
    runs in one process (as in tests); on a cluster executors couldn't see it, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path that its user deletes."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path that :func:`swept` or :func:`sweep` deletes."""
    _made.paths.append(scratch_path(spark, name))
    return _made.paths[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system of its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Deletes what this thread made inside, when its readers are done or have failed."""
    mark = len(_made.paths)
    try:
        yield
    finally:
        while len(_made.paths) > mark:
            remove(spark, _made.paths.pop())


def sweep(spark: SparkSession) -> None:
    """Deletes all that this thread made, for when nothing reads it any more."""
    while _made.paths:
        remove(spark, _made.paths.pop())


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Shuffle files of what is run inside go when it is done, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again.

    The table is complete before anything reads it, so a lost executor costs no
    recomputation of what came before.
    """
    path = shared(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that are broadcast; beyond this a join shuffles.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if all its rows together are few bytes: strings and lists by their JSON text, others as 16."""
    wide = [f.name for f in df.schema if f.dataType.typeName() not in ("long", "integer", "double", "boolean", "date", "timestamp", "float", "short", "byte")]
    size = F.lit(16 * len(df.columns))
    for c in wide:
        text = F.col(f"`{c}`") if df.schema[c].dataType.typeName() == "string" else F.to_json(F.struct(f"`{c}`"))
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def numbered(df: DataFrame, *order: Column | str, name: str = "i") -> DataFrame:
    """df with gapless numbers from 0 in this order, without bringing all rows to one task.

    Rows are dealt by ranges and numbered within them; one count a range reaches the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part = F.shiftright("__at", 33)
    before, run = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):
        before += [F.lit(r.part), F.lit(run)]
        run += r["count"]
    base = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return placed.withColumn(name, (base + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")
