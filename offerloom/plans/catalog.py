"""Catalogue cards, best prices and baseline prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.amounts import effective_qty
from offerloom.operators.cells import band_join, top_k
from offerloom.plans import derive as d

CORE_KEY = ["product_core_id", "unit_type"]
STRICT_PACK = 0.01


def sellable(offers: DataFrame) -> DataFrame:
    """Active offers with a price and a unit."""
    return offers.filter(F.col("active") & (F.col("price") > 0) & F.col("unit_type").isNotNull())


def cards(offers: DataFrame, limit: int | None = None) -> DataFrame:
    """One card per (core, unit): the cheapest offer is the anchor. ``limit`` keeps the largest groups."""
    out = (
        sellable(offers)
        .groupBy(*CORE_KEY)
        .agg(
            F.count("*").alias("n_offers"),
            F.min_by(
                F.struct("offer_id", "price", "pack_value", "name_raw", "supplier_id", "brand_id"),
                F.struct("price", "offer_id"),
            ).alias("a"),
        )
        .select(
            *CORE_KEY,
            "n_offers",
            F.col("a.offer_id").alias("anchor_offer_id"),
            F.col("a.price").alias("best_price"),
            F.col("a.pack_value").alias("pack_value"),
            F.col("a.name_raw").alias("name_raw"),
            F.col("a.supplier_id").alias("supplier_id"),
        )
    )
    if limit is not None:
        out = out.orderBy(F.desc("n_offers"), *CORE_KEY).limit(limit)
    return out


def lot_prices(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest offer per ``keys`` and minimum lot: only these can have the lowest line total."""
    return (
        sellable(offers)
        .groupBy(*keys, "min_order_qty")
        .agg(F.min(F.struct("price", "offer_id")).alias("lot"), F.count("*").alias("n_cell"))
        .select(*keys, "min_order_qty", "n_cell", F.col("lot.price").alias("lot_price"), F.col("lot.offer_id").alias("lot_offer"))
    )


def refresh(card_rows: DataFrame, offers: DataFrame, user_qty: float = 1.0) -> DataFrame:
    """Lowest line total of each card among offers of the card's own pack (1 % tolerance)."""
    lots = lot_prices(offers, [*CORE_KEY, "pack_value"]).withColumnRenamed("pack_value", "lot_pack")
    near = band_join(card_rows, lots, CORE_KEY, "pack_value", "lot_pack", 1 - 2 * STRICT_PACK, 1 + 2 * STRICT_PACK)
    same = F.abs(F.col("lot_pack") - F.col("pack_value")) / F.col("pack_value") <= STRICT_PACK
    total = effective_qty(F.lit(user_qty), F.col("min_order_qty")) * F.col("lot_price")
    best = (
        near.filter(same)
        .withColumn("total", total)
        .groupBy(*CORE_KEY)
        .agg(
            F.sum("n_cell").alias("n_same_pack"),
            F.min(F.struct("total", "lot_offer", "lot_price")).alias("b"),
        )
    )
    return card_rows.join(best, CORE_KEY, "left").select(
        *CORE_KEY,
        "anchor_offer_id",
        F.coalesce("n_same_pack", F.lit(0)).alias("n_same_pack"),
        F.col("b.lot_offer").alias("best_offer_id"),
        F.col("b.lot_price").alias("best_price"),
        F.round("b.total", 2).alias("best_line_total"),
    )


def cheapest_line(references: DataFrame, offers: DataFrame) -> DataFrame:
    """Lowest line total per reference and wanted quantity among offers of the same core and unit."""
    lots = lot_prices(offers, CORE_KEY)
    wanted = references.groupBy(*CORE_KEY, "qty").agg(F.count("*").alias("n_refs"))
    total = effective_qty(F.col("qty"), F.col("min_order_qty")) * F.col("lot_price")
    best = (
        wanted.join(lots, CORE_KEY)
        .withColumn("line_total", total)
        .groupBy(*CORE_KEY, "qty")
        .agg(F.min(F.struct("line_total", "lot_offer")).alias("b"))
    )
    return references.join(best, [*CORE_KEY, "qty"]).select(
        "ref_id", "qty", F.col("b.lot_offer").alias("best_offer_id"), F.round("b.line_total", 2).alias("line_total")
    )


def baseline(offers: DataFrame) -> DataFrame:
    """Price to compare savings with: half of the lowest plus half of the third lowest price."""
    three = top_k(sellable(offers), CORE_KEY, [F.col("price"), F.col("offer_id")], 3)
    p = {i: F.max(F.when(F.col("rank") == i, F.col("price"))) for i in (1, 2, 3)}
    return (
        three.groupBy(*CORE_KEY)
        .agg(F.count("*").alias("n_prices"), p[1].alias("p1"), p[2].alias("p2"), p[3].alias("p3"))
        .withColumn(
            "baseline_price",
            F.when(F.col("n_prices") == 1, F.col("p1"))
            .when(F.col("n_prices") == 2, (F.col("p1") + F.col("p2")) / 2)
            .otherwise(F.col("p1") * 0.5 + F.col("p3") * 0.5),
        )
    )


def listing(card_rows: DataFrame, companies: DataFrame, super_class: str, skip: int, limit: int) -> DataFrame:
    """A page of cards of one class, cheapest first, with supplier names."""
    prefix = super_class.lower()
    named = card_rows.filter(F.lower("product_core_id").startswith(prefix)).join(companies, "supplier_id", "left")
    return (
        named.select(
            *CORE_KEY, "best_price", "n_offers", F.coalesce("supplier_name", F.lit("Unknown")).alias("supplier_name")
        )
        .orderBy("best_price", *CORE_KEY)
        .offset(skip)
        .limit(limit)
    )


# ---------------------------------------------------------------------------------------------

def asked_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """(offer_id, qty): the total quantity ever asked of an offer."""
    q = d.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    return q.selectExpr("l_partkey * 1000000 + l_suppkey AS offer_id", "qty")


def reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    """References with the total quantity ever asked of their anchor."""
    return d.offers(spark, sf).join(asked_quantities(spark, sf), "offer_id").withColumnRenamed("offer_id", "ref_id")


def q_cards(spark: SparkSession, sf: str) -> DataFrame:
    return cards(d.offers(spark, sf))


def q_refresh(spark: SparkSession, sf: str) -> DataFrame:
    o = d.offers(spark, sf)
    return refresh(cards(o), o, 7.0)


def q_cheapest_line(spark: SparkSession, sf: str) -> DataFrame:
    return cheapest_line(reference_rows(spark, sf), d.offers(spark, sf))


def q_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return baseline(d.offers(spark, sf)).select(*CORE_KEY, "n_prices", F.round("baseline_price", 4).alias("baseline_price"))


def q_listing(spark: SparkSession, sf: str) -> DataFrame:
    return listing(cards(d.offers(spark, sf)), d.companies(spark, sf), "SeaFood", 5, 40)


QUERIES = {
    "catalog_best_price": q_cards,
    "catalog_refresh": q_refresh,
    "best_offer_per_reference": q_cheapest_line,
    "baseline_price": q_baseline,
    "catalog_listing": q_listing,
}

_CARDS = (
    ", live AS (SELECT * FROM offers WHERE active AND price > 0)"
    ", cards AS (SELECT * FROM (SELECT product_core_id, unit_type, offer_id AS anchor_offer_id, price AS best_price,"
    " pack_value, name_raw, supplier_id, count(*) OVER (PARTITION BY product_core_id, unit_type) AS n_offers,"
    " row_number() OVER (PARTITION BY product_core_id, unit_type ORDER BY price, offer_id) AS rn FROM live) WHERE rn = 1)"
)
_EFF = "CASE WHEN {m} <= 1 THEN {q} ELSE ceil({q} / {m}) * {m} END"

ORACLE = {
    "catalog_best_price": f"WITH {d.CTE_OFFERS}{_CARDS} SELECT product_core_id, unit_type, n_offers, anchor_offer_id,"
    " best_price, pack_value, name_raw, supplier_id FROM cards",
    "catalog_refresh": f"""WITH {d.CTE_OFFERS}{_CARDS}
        , t AS (SELECT c.product_core_id, c.unit_type, c.anchor_offer_id, o.offer_id, o.price,
              {_EFF.format(m='o.min_order_qty', q='7.0')} * o.price AS total
           FROM cards c JOIN live o USING (product_core_id, unit_type)
           WHERE abs(o.pack_value - c.pack_value) / c.pack_value <= 0.01)
        , b AS (SELECT *, count(*) OVER (PARTITION BY product_core_id, unit_type) AS n_same_pack,
              row_number() OVER (PARTITION BY product_core_id, unit_type ORDER BY total, offer_id) AS rn FROM t)
        SELECT product_core_id, unit_type, anchor_offer_id, n_same_pack, offer_id AS best_offer_id,
              price AS best_price, round(total, 2) AS best_line_total FROM b WHERE rn = 1""",
    "best_offer_per_reference": f"""WITH {d.CTE_OFFERS}{_CARDS}
        , refs AS (SELECT offer_id AS ref_id, product_core_id, unit_type, q.qty FROM offers JOIN
             (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) q USING (l_partkey, l_suppkey))
        , t AS (SELECT ref_id, qty, o.offer_id, {_EFF.format(m='o.min_order_qty', q='qty')} * o.price AS total
             FROM refs JOIN live o USING (product_core_id, unit_type))
        , b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY total, offer_id) AS rn FROM t)
        SELECT ref_id, qty, offer_id AS best_offer_id, round(total, 2) AS line_total FROM b WHERE rn = 1""",
    "baseline_price": f"""WITH {d.CTE_OFFERS}{_CARDS}
        , r AS (SELECT product_core_id, unit_type, price, row_number() OVER (PARTITION BY product_core_id, unit_type
             ORDER BY price, offer_id) AS rn FROM live)
        , p AS (SELECT product_core_id, unit_type, count(*) AS n_prices, max(CASE WHEN rn = 1 THEN price END) AS p1,
             max(CASE WHEN rn = 2 THEN price END) AS p2, max(CASE WHEN rn = 3 THEN price END) AS p3
             FROM r WHERE rn <= 3 GROUP BY 1, 2)
        SELECT product_core_id, unit_type, n_prices, round(CASE n_prices WHEN 1 THEN p1 WHEN 2 THEN (p1 + p2) / 2
             ELSE p1 * 0.5 + p3 * 0.5 END, 4) AS baseline_price FROM p""",
    "catalog_listing": f"""WITH {d.CTE_OFFERS}{_CARDS}
        SELECT product_core_id, unit_type, best_price, n_offers, s_name AS supplier_name
        FROM cards JOIN supplier ON supplier_id = s_suppkey WHERE product_core_id LIKE 'seafood%'
        ORDER BY best_price, product_core_id, unit_type LIMIT 40 OFFSET 5""",
}
