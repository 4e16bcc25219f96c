"""A stored token index that imports keep up to date.

Postings (token, id) lie in buckets of a token hash, so a search reads the buckets of its words alone. An update adds a delta:
the postings of rows that are new or whose words changed, and the ids whose earlier postings no longer count. A posting is
live if its id has no such mark of a later update. A merge writes the live postings of the buckets as a new base.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.sources.versions import Entry, Versions, read_entries, write_parts

POSTINGS, STATES, MARKS = "bucket int, token string, id string", "id string, words bigint", "id string"


@dataclass(frozen=True)
class PostingIndex:
    """The index below ``root``. Rows are (id, tokens); an id must not be null, null tokens are none."""

    root: str
    buckets: int = 32

    @property
    def versions(self) -> Versions:
        return Versions(self.root)

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, version: int) -> list[Entry]:
        """Writes one folder; postings lie in a folder for each bucket, all of which the version names."""
        path = f"{self.root}/{kind}-{version}"
        if kind != "postings":
            rows.write.mode("overwrite").parquet(path)
            return [Entry(kind, -1, path, version)]
        return write_parts(rows.select("bucket", "token", "id"), "bucket", path, kind, version)

    def _posted(self, rows: DataFrame) -> DataFrame:
        token = rows.select(F.col("id").cast("string").alias("id"), F.explode(F.array_distinct("tokens")).alias("token")).where("token is not null")
        return token.select(self.bucket(F.col("token")).alias("bucket"), "token", "id")

    @staticmethod
    def _state(rows: DataFrame) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))
        return rows.select(F.col("id").cast("string").alias("id"), F.xxhash64(words).alias("words"))

    def build(self, rows: DataFrame) -> None:
        """A new base from all rows."""
        spark = rows.sparkSession
        version = (self.versions.newest(spark) or 0) + 1
        entries = self._write(self._posted(rows), "postings", version) + self._write(self._state(rows), "states", version)
        self.versions.commit(spark, version, entries)

    def update(self, rows: DataFrame, removed: DataFrame) -> None:
        """Adds new and changed ``rows`` (id, tokens) and takes out ``removed`` (id). Rows with the same words change nothing."""
        spark = rows.sparkSession
        before = self.versions.newest(spark)
        version = (before or 0) + 1
        entries = self.versions.entries(spark, before)
        now = self._state(rows)
        known = self._states(spark, entries)
        changed = now.join(known.withColumnRenamed("words", "old"), "id", "left").where("old is null or old <> words").select("id", "words")
        added = self._write(changed, "states", version)
        fresh = spark.read.schema(STATES).parquet(added[0].path).select("id")
        gone = removed.select(F.col("id").cast("string").alias("id")).distinct()
        added += self._write(fresh.unionByName(gone).distinct(), "marks", version) + self._write(gone, "gone", version)
        posted = rows.withColumn("id", F.col("id").cast("string")).join(fresh, "id", "left_semi")
        self.versions.commit(spark, version, entries + added + self._write(self._posted(posted), "postings", version))

    def _states(self, spark: SparkSession, entries: list[Entry]) -> DataFrame:
        """Live ids with the hash of their words: the newest state unless a later or the same update took the id out."""
        states = read_entries(spark, [e for e in entries if e.kind == "states"], STATES)
        gone = read_entries(spark, [e for e in entries if e.kind == "gone"], MARKS).groupBy("id").agg(F.max("seq").alias("gone"))
        newest = states.groupBy("id").agg(F.max_by("words", "seq").alias("words"), F.max("seq").alias("seq"))
        return newest.join(gone, "id", "left").where("gone is null or gone < seq").select("id", "words")

    def read(self, spark: SparkSession, tokens: list[str] | None = None) -> DataFrame:
        """Live postings (token, id): all, or those of a query's ``tokens`` from their buckets alone."""
        entries = self.versions.entries(spark, self.versions.newest(spark))
        if tokens is not None:
            asked = spark.createDataFrame([(t,) for t in tokens], "token string")
            wanted = {r["b"] for r in asked.select(self.bucket(F.col("token")).alias("b")).distinct().collect()}
            entries = [e for e in entries if e.kind != "postings" or e.part in wanted]
        return self._live(spark, entries).where(F.col("token").isin(tokens) if tokens is not None else F.lit(True)).select("token", "id")

    def _live(self, spark: SparkSession, entries: list[Entry]) -> DataFrame:
        rows = read_entries(spark, [e for e in entries if e.kind == "postings"], POSTINGS)
        marks = read_entries(spark, [e for e in entries if e.kind == "marks"], MARKS).groupBy("id").agg(F.max("seq").alias("dead"))
        gone = read_entries(spark, [e for e in entries if e.kind == "gone"], MARKS).groupBy("id").agg(F.max("seq").alias("gone"))
        rows = rows.join(marks, "id", "left").join(gone, "id", "left")
        return rows.where("(dead is null or dead <= seq) and (gone is null or gone < seq)").drop("dead", "gone")

    def merge(self, spark: SparkSession) -> None:
        """Writes the live postings as a new base, and removes folders that no version in use names."""
        before = self.versions.newest(spark)
        version = (before or 0) + 1
        entries = self.versions.entries(spark, before)
        new = self._write(self._live(spark, entries).select("bucket", "token", "id"), "postings", version) + self._write(self._states(spark, entries), "states", version)
        self.versions.commit(spark, version, new)
        self.versions.clean(spark)
