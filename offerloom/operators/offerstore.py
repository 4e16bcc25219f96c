"""The offers of all price lists, kept as added rows.

An import adds its rows and nothing else: the newest row of a key is the one of the supplier's newest list, and in it the last
one. Whether an offer is active follows on reading, from the supplier's newest list: rows of older lists are not. So a list may
come in any number of parts and batches, and a new list takes the old one out without a rewrite. Rows lie in buckets of their
key's hash; a bucket with many added folders is rewritten alone, with one row a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.merge import TABLE
from offerloom.sources.versions import Entry, Versions, read_entries, write_parts

ROWS = (
    "bucket int, unique_key string, supplier_id bigint, article string, name_raw string, unit_type string, price double,"
    " price_list_id string, active boolean, list_no bigint, row_no bigint"
)
LISTS = "supplier_id bigint, list_no bigint"


@dataclass(frozen=True)
class OfferStore:
    root: str
    buckets: int = 32
    #: Added folders of a bucket from which it is rewritten.
    most: int = 3

    @property
    def versions(self) -> Versions:
        return Versions(self.root)

    def _put(self, rows: DataFrame, version: int, base: list[Entry]) -> list[Entry]:
        bucket = F.pmod(F.xxhash64("unique_key"), F.lit(self.buckets)).cast("int").alias("bucket")
        typed = [F.col(f.name).cast(f.dataType) for f in rows.sparkSession.createDataFrame([], ROWS).schema if f.name != "bucket"]
        stored = rows.select(bucket, *typed)
        lists = rows.groupBy(F.col("supplier_id").cast("bigint").alias("supplier_id")).agg(F.max("list_no").cast("bigint").alias("list_no"))
        lists.write.mode("overwrite").parquet(f"{self.root}/lists-{version}")
        return base + [Entry("lists", -1, f"{self.root}/lists-{version}", version)] + write_parts(stored, "bucket", f"{self.root}/rows-{version}", "rows", version)

    def create(self, rows: DataFrame) -> None:
        """Version 1 from TABLE rows with list_no and row_no; their ``active`` holds while their list is the newest."""
        self.versions.commit(rows.sparkSession, 1, self._put(rows, 1, []))

    def add(self, rows: DataFrame, version: int) -> None:
        """A version with the cleaned rows of a batch added; they are active as far as their list is the newest."""
        spark = rows.sparkSession
        before = self.versions.newest(spark, version)
        self.versions.commit(spark, version, self._put(rows.withColumn("active", F.lit(True)), version, self.versions.entries(spark, before)))
        self.versions.clean(spark, before)

    def _rows(self, spark: SparkSession, entries: list[Entry]) -> DataFrame:
        """The row of every key that counts."""
        rows = read_entries(spark, [e for e in entries if e.kind == "rows"], ROWS)
        payload = [c for c in (*TABLE, "list_no", "row_no") if c != "unique_key"]
        newest = rows.groupBy("bucket", "unique_key").agg(F.max_by(F.struct(*payload), F.struct("list_no", "row_no", "seq")).alias("r"))
        return newest.select("bucket", "unique_key", "r.*")

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The offers of the newest version (or of a given one), as TABLE rows with list_no."""
        entries = self.versions.entries(spark, version or self.versions.newest(spark))
        lists = read_entries(spark, [e for e in entries if e.kind == "lists"], LISTS).groupBy("supplier_id").agg(F.max("list_no").alias("newest"))
        rows = self._rows(spark, entries).join(lists, "supplier_id", "left")
        return rows.withColumn("active", F.col("active") & (F.col("list_no") >= F.col("newest"))).select(*TABLE, "list_no")

    def compact(self, spark: SparkSession, version: int) -> None:
        """Rewrites the buckets that have ``most`` folders or more, each key once; the other buckets stay as they are."""
        before = self.versions.newest(spark, version)
        entries = self.versions.entries(spark, before)
        folders: dict[int, int] = {}
        for e in entries:
            if e.kind == "rows":
                folders[e.part] = folders.get(e.part, 0) + 1
        full = {b for b, n in folders.items() if n >= self.most}
        if not full:
            return
        old = [e for e in entries if e.kind == "rows" and e.part in full]
        new = write_parts(self._rows(spark, old), "bucket", f"{self.root}/rows-{version}", "rows", version)
        self.versions.commit(spark, version, [e for e in entries if e not in old] + new)
