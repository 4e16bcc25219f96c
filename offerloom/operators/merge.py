"""Keyed upsert and snapshot replacement for price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.amounts import unit_type
from offerloom.functions.text import clean_code, parse_price, squash

TABLE = ["unique_key", "supplier_id", "article", "name_raw", "unit_type", "price", "price_list_id", "active"]


def unique_key(supplier: Column, article: Column, name: Column, unit: Column) -> Column:
    """supplier:article, or supplier:name:unit where there is no article."""
    return F.when(article.isNotNull(), F.concat_ws(":", supplier.cast("string"), article)).otherwise(
        F.concat_ws(":", supplier.cast("string"), squash(F.lower(name)), unit)
    )


def clean_batch(raw: DataFrame, price_list_id: Column) -> DataFrame:
    """Typed rows with the reason a row is refused, if any."""
    name = squash(F.regexp_replace("name", " ", " "))
    rows = raw.withColumns(
        {
            "name_raw": name,
            "article": clean_code(F.col("article")),
            "price": parse_price(F.col("price")),
            "unit_type": unit_type(F.coalesce("unit", F.lit(""))),
            "price_list_id": price_list_id,
        }
    )
    refused = F.when(F.coalesce("name_raw", F.lit("")) == "", "EMPTY_NAME").when(F.col("price").isNull(), "BAD_PRICE")
    return rows.withColumns(
        {"refused": refused, "unique_key": unique_key(F.col("supplier_id"), F.col("article"), F.col("name_raw"), F.col("unit_type"))}
    )


def last_per_key(rows: DataFrame) -> DataFrame:
    """The last row of a batch wins its key; a partial aggregate, so a key with very many rows is no trouble."""
    payload = [c for c in TABLE if c not in ("unique_key", "active")]
    return rows.groupBy("unique_key").agg(F.max_by(F.struct(*payload), "row_no").alias("r")).select("unique_key", "r.*")


def merge_snapshot(target: DataFrame, batch: DataFrame, replace: bool = True) -> DataFrame:
    """New state of the table with the ``change`` of every row.

    One full outer join on the key. With ``replace`` the suppliers of the batch keep only its offers active.
    """
    old = target.select("unique_key", F.struct(*[c for c in TABLE if c != "unique_key"]).alias("o"))
    new = batch.select("unique_key", F.struct(*[c for c in TABLE if c not in ("unique_key", "active")]).alias("n"))
    suppliers = batch.select("supplier_id").distinct().withColumn("listed", F.lit(True))
    both = old.join(new, "unique_key", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    out = both.select("unique_key", *[pick(c) for c in TABLE if c not in ("unique_key", "active")], F.col("o").isNotNull().alias("was"), F.col("n").isNotNull().alias("now"), F.col("o.active").alias("was_active"))
    out = out.join(suppliers, "supplier_id", "left")
    gone = ~F.col("now") & F.coalesce("listed", F.lit(False)) & F.lit(replace)
    change = (
        F.when(F.col("now") & ~F.col("was"), "created")
        .when(F.col("now"), "updated")
        .when(gone & F.col("was_active"), "deactivated")
        .otherwise("kept")
    )
    active = F.when(F.col("now"), True).when(gone, False).otherwise(F.col("was_active"))
    return out.withColumns({"change": change, "active": active}).drop("was", "now", "was_active", "listed")


def purge_inactive(table: DataFrame) -> DataFrame:
    return table.filter("active")


def import_stats(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows read, refused by reason, and offers created, updated and deactivated per supplier."""
    read = rows.groupBy("supplier_id").agg(
        F.count("*").alias("n_rows"),
        *[F.sum(F.when(F.col("refused") == r, 1).otherwise(0)).alias(f"n_{r.lower()}") for r in ("EMPTY_NAME", "BAD_PRICE")],
    )
    done = merged.groupBy("supplier_id").agg(
        *[F.sum(F.when(F.col("change") == c, 1).otherwise(0)).alias(f"n_{c}") for c in ("created", "updated", "deactivated", "kept")]
    )
    return done.join(read, "supplier_id", "full_outer").na.fill(0)
