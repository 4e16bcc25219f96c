"""Tables made of folders, with a manifest for every version.

A version lists the folders that make up the table, so a writer adds folders and then commits them by one small file; readers
see the old version or the new one. A version that is written again (a replayed batch) replaces itself. Folders that neither
the newest version nor the one before it names are removed on request.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "version bigint, kind string, part bigint, path string, seq bigint"


@dataclass(frozen=True)
class Entry:
    """A folder of a version: what it holds (``kind``), of which ``part`` (bucket) of the table, and when it was added."""

    kind: str
    part: int
    path: str
    seq: int


@dataclass(frozen=True)
class Versions:
    root: str

    def _folder(self) -> str:
        return os.path.join(self.root, "manifest")

    def _list(self, spark: SparkSession) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self._folder())
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder()}/{n}/_SUCCESS"))
        return sorted(int(n.removeprefix("n=")) for n in names if n.startswith("n=") and done(n))

    def newest(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The newest committed version, or the newest before a given one."""
        found = [n for n in self._list(spark) if before is None or n < before]
        return found[-1] if found else None

    def entries(self, spark: SparkSession, version: int | None) -> list[Entry]:
        if version is None:
            return []
        rows = spark.read.schema(SCHEMA).parquet(f"{self._folder()}/n={version}").collect()
        return sorted((Entry(r["kind"], r["part"], r["path"], r["seq"]) for r in rows), key=lambda e: (e.seq, e.kind, e.part))

    def commit(self, spark: SparkSession, version: int, entries: list[Entry]) -> None:
        rows = [(version, e.kind, e.part, e.path, e.seq) for e in entries]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self._folder()}/n={version}")

    def clean(self, spark: SparkSession, since: int | None = None) -> list[str]:
        """Removes the folders that only versions older than ``since`` name (the newest but one if not given), and their manifests."""
        found = self._list(spark)
        since = since if since is not None else (found[-2:] or [0])[0]
        old, kept = [n for n in found if n < since], [n for n in found if n >= since]
        named = {e.path for n in kept for e in self.entries(spark, n)}
        gone = sorted({e.path for n in old for e in self.entries(spark, n)} - named)
        for place in [*gone, *(f"{self._folder()}/n={n}" for n in old)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone


def write_parts(rows: DataFrame, by: str, path: str, kind: str, version: int) -> list[Entry]:
    """Writes ``rows`` with a folder for each value of the bucket column ``by``; an entry for every folder that has rows."""
    rows.repartition(by).withColumn("b", F.col(by)).write.partitionBy("b").mode("overwrite").parquet(path)
    held = rows.sparkSession.read.schema(rows.schema).parquet(path).select(by).distinct().collect()
    return [Entry(kind, r[by], f"{path}/b={r[by]}", version) for r in sorted(held)]


def read_entries(spark: SparkSession, entries: list[Entry], schema: str) -> DataFrame:
    """Rows of all folders with their ``seq``; without folders an empty table."""
    full = T.StructType.fromDDL(schema).add("seq", T.LongType())
    out = spark.createDataFrame([], full)
    by_seq: dict[int, list[str]] = {}
    for e in entries:
        by_seq.setdefault(e.seq, []).append(e.path)
    for seq, paths in by_seq.items():
        out = out.unionByName(spark.read.schema(schema).parquet(*paths).withColumn("seq", F.lit(seq).cast("bigint")))
    return out
