"""Tables in parts that are replaced as a whole, and switched together by one manifest.

A part's rows lie in a folder of their own. A commit writes new folders beside the old
ones, then one small manifest that names the current folder of every part of every table;
until it is there readers see the tables as before, and a writer that dies leaves nothing
but folders without a name. Commits of two writers at once: the second one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textquarry.sources.scratch import freed, remove

#: How parts are stored: lists of ids and sorted texts take less room by their differences.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.writer.version": "PARQUET_2_0"}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


@dataclass
class Staged:
    """Folders of new parts, not yet named by a manifest."""

    folders: dict[str, str]
    schema: str


@dataclass
class Store:
    """Version `version` of the tables under root: tables[name][part] is a folder under root."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> Store:
        """The latest whole version, or the one asked for; version 0 without tables where there is none."""
        root = root.rstrip("/")
        known = sorted((int(n[9:-5]) for n in _names(spark, root) if n.startswith("manifest-") and n.endswith(".json")), reverse=True)
        for v in known if version is None else [version]:
            fs, p = _fs(spark, f"{root}/manifest-{v:010d}.json")
            stream = fs.open(p)
            try:
                told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # its writer died; the version before holds
                continue
            finally:
                stream.close()
            return cls(spark, root, v, told["tables"], told["schemas"], told["info"])
        return cls(spark, root, known[0] if known and version is None else 0)

    def read(self, name: str, parts: list | None = None) -> DataFrame:
        """A table, or of it only these parts."""
        own = self.tables[name]
        folders = [own[p] for p in (own if parts is None else map(str, parts)) if p in own]
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def stage(self, name: str, df: DataFrame, part: str, order: list[str] | None = None, stay: bool = False, passes: int = 1) -> Staged:
        """Writes df in new folders, by its column `part`; a large part takes several files.

        order: what rows are sorted by in a file; stay: rows stay with the tasks that have them,
        where a task has few parts. What is shuffled for it goes when it is written; passes: df is
        read so many times, and each time some of the parts are shuffled and written.
        """
        at = f"{name}-{uuid.uuid4().hex[:12]}"
        for i in range(passes):
            df_ = df.where(F.pmod(F.xxhash64(part), F.lit(passes)) == i) if passes > 1 else df
            df_ = df_.withColumn("__part", F.col(part))
            df_ = df_ if stay else df_.hint("rebalance", F.col("__part"))
            df_ = df_.sortWithinPartitions("__part", *order) if order else df_
            with freed(self.spark):
                df_.write.mode("append").options(**STORED).partitionBy("__part").parquet(f"{self.root}/{at}")
        found = [n for n in _names(self.spark, f"{self.root}/{at}") if n.startswith("__part=")]
        return Staged({n.removeprefix("__part="): f"{at}/{n}" for n in found}, df.schema.json())

    def staged(self, new: Staged) -> DataFrame:
        """Staged rows, before a manifest names them."""
        schema = StructType.fromJson(json.loads(new.schema))
        folders = {f.split("/")[0] for f in new.folders.values()}
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)).select(*schema.names)

    def drop(self, new: Staged) -> None:
        """Deletes what is staged and will not be named."""
        for f in {f.split("/")[0] for f in new.folders.values()}:
            remove(self.spark, f"{self.root}/{f}")

    def commit(self, staged: dict[str, Staged], replaced: dict[str, list] | None = None, info: dict | None = None) -> Store:
        """The next version: of each staged table its parts in `replaced` (all, if not named) give way to the staged ones."""
        replaced = replaced or {}
        tables, schemas = dict(self.tables), dict(self.schemas)
        for name, new in staged.items():
            gone = set(map(str, replaced[name])) if name in replaced else None
            kept = {} if gone is None else {p: f for p, f in self.tables.get(name, {}).items() if p not in gone}
            if gone is not None and set(new.folders) - gone:
                raise ValueError(f"{name}: staged parts that aren't replaced: {sorted(set(new.folders) - gone)[:5]}")
            tables[name], schemas[name] = kept | new.folders, new.schema
        out = Store(self.spark, self.root, self.version + 1, tables, schemas, self.info | (info or {}))
        fs, p = _fs(self.spark, f"{self.root}/manifest-{out.version:010d}.json")
        if fs.exists(p):
            raise RuntimeError(f"{self.root} has changed meanwhile")
        stream = fs.create(p, False)  # fails if another writer was first
        try:
            stream.write(bytearray(json.dumps({"tables": tables, "schemas": schemas, "info": out.info}).encode()))
        finally:
            stream.close()
        return out

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes folders that the last `keep` versions don't name, and older manifests; what it deleted. Not for while a commit is under way."""
        versions = [self] + [Store.open(self.spark, self.root, v) for v in range(max(1, self.version - keep + 1), self.version)]
        named = {f.split("/")[0] for s in versions for t in s.tables.values() for f in t.values()}
        oldest, gone = min(s.version for s in versions), []
        for n in _names(self.spark, self.root):
            old = n.startswith("manifest-") and int(n[9:-5]) < oldest
            if old or not n.startswith("manifest-") and n not in named:
                gone.append(n)
                remove(self.spark, f"{self.root}/{n}")
        live = {f for s in versions for t in s.tables.values() for f in t.values()}
        for top in named:
            for n in _names(self.spark, f"{self.root}/{top}"):
                if n.startswith("__part=") and f"{top}/{n}" not in live:
                    gone.append(f"{top}/{n}")
                    remove(self.spark, f"{self.root}/{top}/{n}")
        return gone
