"""Domain tables (offers, references, intents, vendors, companies) from the star-schema inputs.

The item columns are written as SQL text that Spark and DuckDB read alike, so the oracle starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
CLASS_OF_TYPE = {
    "ECONOMY": "seafood",
    "STANDARD": "meat",
    "MEDIUM": "dairy",
    "LARGE": "sauce",
    "SMALL": "packaging",
    "PROMO": "spice",
}
TAGS = [
    "frozen", "chilled", "smoked sliced", "headless", "breaded", "vanilla", "mango", "fillet",
    "steak", "skinless", "skin on", "whole", "soy", "condensed", "sauce", "",
]
N_VENDORS = 8
ORDER_CHUNK = 1024

_CLASS = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF_TYPE.items()) + " ELSE 'other' END"
_TAG = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAGS)) + " END"
_TAG2 = "CASE CAST(floor(p_partkey / 16) AS BIGINT) % 5 WHEN 0 THEN 'chilled' WHEN 1 THEN 'lemon' ELSE '' END"
_PACK_TEXT = (
    "CASE p_size % 3"
    " WHEN 0 THEN CASE p_partkey % 4"
    "   WHEN 0 THEN CAST(p_size AS STRING) || 'kg'"
    "   WHEN 1 THEN CAST(p_size * 50 AS STRING) || 'g'"
    "   WHEN 2 THEN CAST(p_size AS STRING) || 'x200 г'"
    "   ELSE CAST(p_size AS STRING) || '-' || CAST(p_size + 2 AS STRING) || 'kg' END"
    " WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN CAST(p_size AS STRING) || 'l'"
    "   ELSE CAST(p_size * 100 AS STRING) || 'ml' END"
    " ELSE CAST(p_size AS STRING) || 'pcs' END"
)
_CALIBER = (
    "CASE WHEN p_partkey % 7 = 0 THEN CASE CAST(floor(p_partkey / 7) AS BIGINT) % 2"
    " WHEN 0 THEN ' 16/20' ELSE ' 21/25' END ELSE '' END"
)
_FAT = "CASE WHEN p_partkey % 5 = 0 THEN ' ' || CAST(1 + p_size % 20 AS STRING) || '%' ELSE '' END"

ITEM_COLUMNS = {
    "super_class": _CLASS,
    "product_core_id": f"{_CLASS} || '.' || replace(p_name, ' ', '_')",
    "name_raw": (
        f"trim(regexp_replace(p_name || ' ' || p_brand || ' ' || {_PACK_TEXT} || ' ' || {_TAG} || ' ' || {_TAG2}"
        f" || {_CALIBER} || {_FAT}, ' +', ' '{{G}}))"
    ),
    "brand_id": "CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE lower(p_brand) END",
    "unit_type": "CASE p_size % 3 WHEN 0 THEN 'WEIGHT' WHEN 1 THEN 'VOLUME' ELSE 'PIECE' END",
    "unit_supplier": (
        "CASE p_size % 3 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'kg' ELSE 'pcs' END"
        " WHEN 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'l' ELSE 'box' END ELSE 'шт' END"
    ),
    "pack_value": "CAST(p_size AS DOUBLE)",
    "fat_pct": "CASE WHEN p_partkey % 5 = 0 THEN CAST(1 + p_size % 20 AS DOUBLE) END",
    "cut": "CASE p_partkey % 6 WHEN 0 THEN 'fillet' WHEN 1 THEN 'whole' END",
}

OFFER_COLUMNS = {
    "offer_id": "l_partkey * 1000000 + l_suppkey",
    "price": "CAST(floor(unit_price * 100 + 0.5) AS DOUBLE) / 100.0",
    "min_order_qty": "CAST(1 + (l_partkey + l_suppkey) % 5 AS INT)",
    "step_qty": "CAST(1 + l_suppkey % 3 AS INT)",
    "active": "(l_partkey * 7 + l_suppkey) % 10 <> 0",
    "vendor_id": f"CAST(l_suppkey % {N_VENDORS} AS INT)",
}

VENDOR_MINIMUM = "200000.0 + 10000.0 * vendor_id"
BRAND_CRITICAL = "l_partkey % 3 = 0"
ORIGIN_CITY = "CASE WHEN l_suppkey % 4 = 0 THEN 'CITY_' || CAST(l_suppkey % 12 AS STRING) END"
ORIGIN_REGION = "CASE WHEN l_suppkey % 4 = 1 THEN r_name END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item_exprs(engine: str) -> list[str]:
    flag = "" if engine == "spark" else ", 'g'"
    return [f"{sql.replace('{G}', flag)} AS {name}" for name, sql in ITEM_COLUMNS.items()]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: the text and the features every offer of the part shares."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *_item_exprs("spark"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows with nation and region."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .selectExpr("s_suppkey AS supplier_id", "s_name AS supplier_name", "n_name AS origin_country", "r_name")
    )


def offer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price facts per (part, supplier), without the item text."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    # Dealt by part once, rows neither move for the grouping nor for the join with the items.
    return (
        li.repartition("l_partkey").groupBy("l_partkey", "l_suppkey")
        .agg(F.min("unit_price").alias("unit_price"))
        .selectExpr("l_partkey", "l_suppkey", *[f"{sql} AS {name}" for name, sql in OFFER_COLUMNS.items()])
    )


def offers(spark: SparkSession, sf_dir: str, geo: bool = False, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The offers table; ``geo`` adds supplier name and origin, ``more`` columns that follow from the item, once an item."""
    # Spark sizes the items by the part file, which holds none of their texts, and would send them all through the driver.
    out = offer_facts(spark, sf_dir).join((more or (lambda i: i))(items(spark, sf_dir)).hint("merge"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    if geo:
        out = (
            out.join(companies(spark, sf_dir), F.col("l_suppkey") == F.col("supplier_id"))
            .withColumn("origin_region", F.expr(ORIGIN_REGION))
            .withColumn("origin_city", F.expr(ORIGIN_CITY))
            .drop("supplier_id", "r_name")
        )
    return out.withColumnRenamed("l_suppkey", "supplier_id").withColumn("brand_critical", F.expr(BRAND_CRITICAL))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart lines: cart_id, order of the line, wanted quantity, anchor offer and lock flag."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Dealt by order once, lines neither move for the join nor for the grouping.
    return (
        li.repartition("l_orderkey").join(o, li.l_orderkey == o.o_orderkey)
        .groupBy("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("qty"))
        .selectExpr(
            "o_custkey AS cart_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty",
            "l_partkey * 1000000 + l_suppkey AS anchor_offer_id",
            "l_linenumber % 4 = 0 AS locked",
            f"CAST(floor(l_orderkey / {ORDER_CHUNK}) AS BIGINT) AS chunk",
        )
    )


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# ---------------------------------------------------------------------------------------------
# The same tables as DuckDB common table expressions.

def _duck(exprs: dict[str, str], flag: str = ", 'g'") -> str:
    return ", ".join(f"{sql.replace('{G}', flag)} AS {name}" for name, sql in exprs.items())


CTE_ITEMS = f"items AS (SELECT p_partkey, {_duck(ITEM_COLUMNS)} FROM part)"
CTE_OFFERS = (
    CTE_ITEMS
    + ", facts AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS unit_price"
    " FROM lineitem GROUP BY 1, 2)"
    f", offers AS (SELECT l_partkey, l_suppkey, l_suppkey AS supplier_id, {_duck(OFFER_COLUMNS)},"
    f" {BRAND_CRITICAL} AS brand_critical, {', '.join(ITEM_COLUMNS)},"
    f" s_name AS supplier_name, n_name AS origin_country, {ORIGIN_REGION} AS origin_region,"
    f" {ORIGIN_CITY} AS origin_city"
    " FROM facts JOIN items ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
CTE_INTENTS = (
    "intents AS (SELECT o_custkey AS cart_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " sum(l_quantity) AS qty, l_partkey * 1000000 + l_suppkey AS anchor_offer_id,"
    " l_linenumber % 4 = 0 AS locked"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5)"
)
