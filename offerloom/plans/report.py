"""Reports: savings, orders, data quality, coverage and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.amounts import parse_pack
from offerloom.operators.cells import top_k
from offerloom.plans import derive as d
from offerloom.plans.catalog import CORE_KEY, baseline, sellable
from offerloom.session import cut_lineage

# Fixed values.
FOOD_CLASSES = [
    "seafood", "meat", "dairy", "vegetables", "fruits", "bakery", "beverages", "condiments", "grains", "canned",
    "frozen", "oils", "pasta", "spices", "sauces", "snacks", "confectionery", "nuts", "dried", "alcohol",
]
REJECTION_LIMIT = 0.10
OUTLIER_QTY = 50
OUTLIER_PACKS = 20


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)), digits)


def savings(lines: DataFrame, base: DataFrame) -> DataFrame:
    """Paid amount against the baseline price of each line's core, per customer."""
    priced = lines.join(base.select(*CORE_KEY, "baseline_price"), CORE_KEY, "left")
    paid = F.col("qty") * F.col("price")
    expected = F.coalesce(F.col("qty") * F.col("baseline_price"), paid)
    return (
        priced.groupBy("cart_id")
        .agg(F.count("*").alias("n_lines"), F.sum(paid).alias("actual"), F.sum(expected).alias("baseline"))
        .withColumn("savings", F.col("baseline") - F.col("actual"))
        .withColumn("savings_pct", F.when(F.col("baseline") > 0, 100.0 * F.col("savings") / F.col("baseline")).otherwise(0.0))
    )


def validation(offers: DataFrame) -> DataFrame:
    """Error and warning codes of every offer."""
    food = F.exists(F.array(*[F.lit(c) for c in FOOD_CLASSES]), lambda c: F.lower(F.coalesce("super_class", F.lit(""))).startswith(c))
    sized = F.coalesce(F.col("pack_value") > 0, F.lit(False))
    bulk = F.col("unit_type").isin("WEIGHT", "VOLUME")
    errors = [
        F.when(F.col("offer_id").isNull(), "MISSING_ID"),
        F.when(F.col("supplier_id").isNull(), "MISSING_SUPPLIER"),
        F.when(F.col("price").isNull(), "MISSING_PRICE"),
        F.when(F.col("price") <= 0, "INVALID_PRICE"),
        F.when(F.coalesce("unit_type", F.lit("")) == "", "MISSING_UNIT_TYPE"),
        F.when(F.coalesce(bulk, F.lit(False)) & ~sized, "MISSING_PACK_SIZE"),
    ]
    warning = F.when(food & F.coalesce(F.col("unit_type") == "PIECE", F.lit(False)) & ~sized, "PIECE_FOOD_WITHOUT_PACK")
    return offers.withColumns(
        {"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(warning))}
    )


def publishable(offers: DataFrame) -> Column:
    sized = (F.col("unit_type") == "PIECE") | (F.col("pack_value") > 0)
    return F.coalesce(
        F.col("active") & (F.col("price") > 0) & (F.coalesce("unit_type", F.lit("")) != "") & F.col("supplier_id").isNotNull() & sized,
        F.lit(False),
    )


def damaged(offers: DataFrame) -> DataFrame:
    """Derived offers with the defects that real feeds have: lost pack, unit, supplier or price on fixed keys."""
    def lose(name: str, mod: int, rest: int) -> Column:
        return F.when((F.col("l_partkey") + F.col("supplier_id")) % mod != rest, F.col(name))

    price = F.when((F.col("l_partkey") + F.col("supplier_id")) % 29 == 3, F.lit(0.0)).otherwise(F.col("price"))
    return offers.withColumns(
        {
            "pack_value": lose("pack_value", 11, 1),
            "unit_type": lose("unit_type", 23, 5),
            "price": F.when((F.col("l_partkey") + F.col("supplier_id")) % 31 != 7, price),
        }
    )


def quality(offers: DataFrame) -> DataFrame:
    """One row: active, publishable and hidden offers, what is missing, and the quality score."""
    bulk = F.col("unit_type").isin("WEIGHT", "VOLUME")
    live = F.col("active")
    out = offers.agg(
        count_if(live).alias("n_active"),
        count_if(publishable(offers)).alias("n_publishable"),
        count_if(live & (F.coalesce("price", F.lit(0.0)) <= 0)).alias("n_bad_price"),
        count_if(live & (F.coalesce("unit_type", F.lit("")) == "")).alias("n_no_unit"),
        count_if(live & F.coalesce(bulk, F.lit(False)) & F.coalesce(F.col("pack_value") <= 0, F.lit(True))).alias("n_no_pack"),
    )
    return out.withColumn("n_hidden", F.col("n_active") - F.col("n_publishable")).withColumn(
        "quality_score", share(F.col("n_publishable"), F.col("n_active"))
    )


def coverage(offers: DataFrame, by: list[str]) -> DataFrame:
    """How many offers have a parsed pack, brand, fat and origin, in one pass."""
    n = F.count("*")
    return offers.groupBy(*by).agg(
        n.alias("n_items"),
        share(count_if(F.col("pack.unit_type") != "UNKNOWN"), n).alias("pack_pct"),
        share(F.count("brand_id"), n).alias("brand_pct"),
        share(F.count("fat_pct"), n).alias("fat_pct"),
        share(F.count("origin_region"), n).alias("region_pct"),
        share(count_if(F.col("product_core_id").contains(".")), n).alias("core_pct"),
    )


def brand_coverage(offers: DataFrame) -> DataFrame:
    """Branded share per supplier and overall (null supplier)."""
    return offers.rollup("supplier_id").agg(
        F.count("*").alias("n_items"), F.count("brand_id").alias("n_branded"), share(F.count("brand_id"), F.count("*")).alias("brand_pct")
    )


def audit(offers: DataFrame) -> DataFrame:
    """Issue codes and a confidence band per offer."""
    pack = F.col("pack")
    issues = [
        F.when(F.coalesce("super_class", F.lit("other")) == "other", "NO_CLASS"),
        F.when(~F.col("product_core_id").contains("."), "NO_CORE"),
        F.when(F.col("brand_id").isNull(), "NO_BRAND"),
        F.when(pack.unit_type == "UNKNOWN", "NO_PACK"),
        F.when((pack.unit_type != "UNKNOWN") & (pack.unit_type != F.col("unit_type")), "UNIT_CONFLICT"),
        F.when((pack.confidence > 0) & (pack.confidence < 0.5), "PACK_GUESSED"),
    ]
    issues = F.array_compact(F.array(*issues))
    band = F.when(pack.confidence >= 0.8, "high").when(pack.confidence >= 0.5, "mid").otherwise("low")
    return offers.withColumns({"issues": issues, "band": band})


# ---------------------------------------------------------------------------------------------

def parsed_offers(spark: SparkSession, sf: str, geo: bool = False) -> DataFrame:
    """Offers with the parsed ``pack``. Names are parsed once per item and stored, not once per offer and filter."""
    packs = d.items(spark, sf).select(F.col("p_partkey").alias("l_partkey"), parse_pack(F.col("name_raw")).alias("pack"))
    return d.offers(spark, sf, geo).join(cut_lineage(packs, "item-packs"), "l_partkey")


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered lines with the unit price paid and the item's core."""
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    it = d.items(spark, sf).select("p_partkey", *CORE_KEY)
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(it, li.l_partkey == it.p_partkey)
        .select(F.col("o_custkey").alias("cart_id"), *CORE_KEY, F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    )


def q_savings(spark: SparkSession, sf: str) -> DataFrame:
    s = savings(_order_lines(spark, sf), baseline(d.offers(spark, sf)))
    return s.select("cart_id", "n_lines", F.round("actual", 2).alias("actual"), *[F.round(c, 3).alias(c) for c in ("baseline", "savings", "savings_pct")])


def q_orders_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cart_id")).agg(
        F.count("*").alias("n_orders"),
        *[count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in ("O", "F", "P")],
        F.round(F.sum("o_totalprice"), 2).alias("amount"),
    )


def q_newest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Five newest orders of every customer."""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return top_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5)


def q_order_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two order stores united, one row per id with the newest state, and the number of lines."""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    old = o.filter("o_orderstatus <> 'O'").withColumn("store", F.lit("old"))
    new = o.filter("o_orderstatus <> 'F'").withColumn("store", F.lit("new")).withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 1 DAY"))
    merged = old.unionByName(new).groupBy("o_orderkey").agg(
        F.max_by(F.struct("o_custkey", "o_orderdate", "o_totalprice", "store"), F.struct("o_orderdate", "store")).alias("r")
    )
    lines = d.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"))
    return merged.join(lines, merged.o_orderkey == lines.l_orderkey, "left").select(
        "o_orderkey", "r.o_custkey", "r.o_orderdate", "r.o_totalprice", "r.store", F.coalesce("n_items", F.lit(0)).alias("n_items")
    )


def q_orders_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = d.table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def q_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Invalid offers and rejection rate per supplier."""
    v = validation(damaged(d.offers(spark, sf)))
    bad = count_if(F.size("errors") > 0)
    return v.groupBy("supplier_id").agg(
        F.count("*").alias("n_total"), bad.alias("n_invalid"), count_if(F.size("warnings") > 0).alias("n_warned"),
        F.round(bad / F.count("*"), 6).alias("rejection_rate"), (bad / F.count("*") > REJECTION_LIMIT).alias("over_limit"),
    )


def q_validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    v = validation(damaged(d.offers(spark, sf)))
    return v.select("super_class", F.explode("errors").alias("error")).groupBy("super_class", "error").agg(F.count("*").alias("n"))


def q_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(damaged(d.offers(spark, sf)))


def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(parsed_offers(spark, sf, geo=True), [])


def q_category_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(parsed_offers(spark, sf, geo=True), ["super_class"]).filter("n_items >= 10")


def q_brand_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return brand_coverage(d.offers(spark, sf))


def q_top_brands(spark: SparkSession, sf: str) -> DataFrame:
    o = sellable(d.offers(spark, sf)).filter(F.col("brand_id").isNotNull())
    return o.groupBy("brand_id").agg(F.count("*").alias("n"), F.round(F.avg("price"), 2).alias("avg_price")).orderBy(F.desc("n"), "brand_id").limit(10)


def q_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(parsed_offers(spark, sf))
    return a.select("super_class", "band", F.explode_outer("issues").alias("issue")).groupBy("super_class", "band", "issue").agg(F.count("*").alias("n"))


def q_pack_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest packs: under 50 g or ml, and more than 20 of them in a kilogram; the first 500."""
    o = parsed_offers(spark, sf)
    packs = F.floor(1000 / F.col("pack.base_qty"))
    small = F.col("pack.unit_type").isin("WEIGHT", "VOLUME") & (F.col("pack.base_qty") < OUTLIER_QTY) & (packs > OUTLIER_PACKS)
    return (
        o.filter(small).withColumn("packs_per_kg", packs)
        .select("offer_id", F.col("pack.base_qty").alias("base_qty"), "packs_per_kg")
        .orderBy("base_qty", "offer_id").limit(500)
    )


def q_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """Ten most frequent fat, cut and origin values."""
    o = d.offers(spark, sf, geo=True)
    kinds = F.array(
        F.struct(F.lit("fat").alias("kind"), F.col("fat_pct").cast("int").cast("string").alias("value")),
        F.struct(F.lit("cut").alias("kind"), F.col("cut").alias("value")),
        F.struct(F.lit("country").alias("kind"), F.col("origin_country").alias("value")),
    )
    n = o.select(F.explode(kinds).alias("k")).filter("k.value IS NOT NULL").groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    return top_k(n, ["kind"], [F.desc("n"), F.col("value")], 10)


def q_origin_share(spark: SparkSession, sf: str) -> DataFrame:
    o = d.offers(spark, sf, geo=True).filter(F.col("super_class").isin("seafood", "meat"))
    return o.groupBy("super_class").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("origin_region").isNotNull().cast("double")), 6).alias("region_share"),
        F.round(F.avg(F.col("origin_city").isNotNull().cast("double")), 6).alias("city_share"),
    )


def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the stores and ids that one store has and the other lacks."""
    li = d.table(spark, sf, "lineitem")
    pairs = [
        ("part_without_offer", d.table(spark, sf, "part").select("p_partkey"), li.select("l_partkey")),
        ("supplier_without_offer", d.table(spark, sf, "supplier").select("s_suppkey"), li.select("l_suppkey")),
        ("customer_without_order", d.table(spark, sf, "customer").select("c_custkey"), d.table(spark, sf, "orders").select("o_custkey")),
        ("order_without_line", d.table(spark, sf, "orders").select("o_orderkey"), li.select("l_orderkey")),
    ]
    out = None
    for name, left, right in pairs:
        rows = left.select(F.lit(1).alias("t"), F.lit(0).alias("m")).unionByName(
            left.subtract(right).select(F.lit(0).alias("t"), F.lit(1).alias("m"))
        )
        row = rows.agg(F.sum("t").alias("n_total"), F.sum("m").alias("n_missing")).withColumn("check", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def q_brand_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families with their sorted member brands."""
    from offerloom.plans.funnel import families

    f = families(d.offers(spark, sf))
    return f.groupBy("family_id").agg(
        F.count("*").alias("n_brands"), F.array_join(F.array_sort(F.collect_set("brand_id")), ",").alias("members")
    )


QUERIES = {
    "customer_savings": q_savings,
    "orders_by_status": q_orders_by_status,
    "newest_orders": q_newest_orders,
    "order_history": q_order_history,
    "orders_per_customer": q_orders_per_customer,
    "offer_validation": q_validation,
    "validation_errors": q_validation_errors,
    "data_quality": q_quality,
    "coverage": q_coverage,
    "category_coverage": q_category_coverage,
    "brand_coverage": q_brand_coverage,
    "top_brands": q_top_brands,
    "audit_issues": q_audit,
    "pack_outliers": q_pack_outliers,
    "distributions": q_distributions,
    "origin_share": q_origin_share,
    "reconcile_ids": q_reconcile,
    "brand_families": q_brand_families,
}

from offerloom.plans.enrich import _PACK  # noqa: E402

_DAMAGED = f"""WITH {d.CTE_OFFERS}
 , dam AS (SELECT offer_id, supplier_id, super_class, active, CASE WHEN (l_partkey + l_suppkey) % 11 <> 1 THEN pack_value END AS pack_value,
     CASE WHEN (l_partkey + l_suppkey) % 23 <> 5 THEN unit_type END AS unit_type,
     CASE WHEN (l_partkey + l_suppkey) % 31 <> 7 THEN CASE WHEN (l_partkey + l_suppkey) % 29 = 3 THEN 0.0 ELSE price END END AS price FROM offers)
 , v AS (SELECT *, list_filter([CASE WHEN price IS NULL THEN 'MISSING_PRICE' END, CASE WHEN price <= 0 THEN 'INVALID_PRICE' END,
     CASE WHEN unit_type IS NULL THEN 'MISSING_UNIT_TYPE' END,
     CASE WHEN unit_type IN ('WEIGHT', 'VOLUME') AND pack_value IS NULL THEN 'MISSING_PACK_SIZE' END], lambda x: x IS NOT NULL) AS errors,
     super_class IN ('seafood', 'meat', 'dairy') AND unit_type = 'PIECE' AND pack_value IS NULL AS warned FROM dam)"""
_PACKED = f"WITH {d.CTE_OFFERS}, src AS (SELECT * FROM offers), {_PACK}"
_COVER = """count(*) AS n_items, round(100.0 * count(*) FILTER (WHERE pack_type <> 'UNKNOWN') / count(*), 1) AS pack_pct,
  round(100.0 * count(brand_id) / count(*), 1) AS brand_pct, round(100.0 * count(fat_pct) / count(*), 1) AS fat_pct,
  round(100.0 * count(origin_region) / count(*), 1) AS region_pct, round(100.0 * count(*) FILTER (WHERE contains(product_core_id, '.')) / count(*), 1) AS core_pct"""

ORACLE = {
    "customer_savings": f"""WITH {d.CTE_OFFERS}
      , r AS (SELECT product_core_id, unit_type, price, row_number() OVER (PARTITION BY product_core_id, unit_type ORDER BY price, offer_id) AS rn FROM offers WHERE active)
      , p AS (SELECT product_core_id, unit_type, count(*) AS n, max(CASE WHEN rn = 1 THEN price END) AS p1, max(CASE WHEN rn = 2 THEN price END) AS p2,
           max(CASE WHEN rn = 3 THEN price END) AS p3 FROM r WHERE rn <= 3 GROUP BY 1, 2)
      , b AS (SELECT product_core_id, unit_type, CASE n WHEN 1 THEN p1 WHEN 2 THEN (p1 + p2) / 2 ELSE p1 * 0.5 + p3 * 0.5 END AS bp FROM p)
      , l AS (SELECT o_custkey AS cart_id, l_quantity AS qty, l_extendedprice / l_quantity AS price, bp FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN items ON l_partkey = p_partkey LEFT JOIN b USING (product_core_id, unit_type))
      , s AS (SELECT cart_id, count(*) AS n_lines, sum(qty * price) AS actual, sum(coalesce(qty * bp, qty * price)) AS baseline FROM l GROUP BY 1)
      SELECT cart_id, n_lines, round(actual, 2) AS actual, round(baseline, 3) AS baseline, round(baseline - actual, 3) AS savings,
        round(CASE WHEN baseline > 0 THEN 100.0 * (baseline - actual) / baseline ELSE 0 END, 3) AS savings_pct FROM s""",
    "orders_by_status": """SELECT o_custkey AS cart_id, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1""",
    "newest_orders": """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
    "order_history": """WITH u AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, 'old' AS store FROM orders WHERE o_orderstatus <> 'O'
        UNION ALL SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 1 DAY, o_totalprice, 'new' FROM orders WHERE o_orderstatus <> 'F')
      , m AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, store DESC) AS rn FROM u)
      , n AS (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1)
      SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, store, coalesce(n_items, 0) AS n_items FROM m LEFT JOIN n ON l_orderkey = o_orderkey WHERE rn = 1""",
    "orders_per_customer": """SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
    "offer_validation": _DAMAGED + """ SELECT supplier_id, count(*) AS n_total, count(*) FILTER (WHERE len(errors) > 0) AS n_invalid,
      count(*) FILTER (WHERE warned) AS n_warned, round(count(*) FILTER (WHERE len(errors) > 0) / count(*), 6) AS rejection_rate,
      count(*) FILTER (WHERE len(errors) > 0) / count(*) > 0.1 AS over_limit FROM v GROUP BY 1""",
    "validation_errors": _DAMAGED + " SELECT super_class, error, count(*) AS n FROM (SELECT super_class, unnest(errors) AS error FROM v) GROUP BY 1, 2",
    "data_quality": _DAMAGED + """ , q AS (SELECT count(*) FILTER (WHERE active) AS n_active,
        count(*) FILTER (WHERE active AND price > 0 AND unit_type IS NOT NULL AND (unit_type = 'PIECE' OR pack_value > 0)) AS n_publishable,
        count(*) FILTER (WHERE active AND coalesce(price, 0) <= 0) AS n_bad_price, count(*) FILTER (WHERE active AND unit_type IS NULL) AS n_no_unit,
        count(*) FILTER (WHERE active AND unit_type IN ('WEIGHT', 'VOLUME') AND pack_value IS NULL) AS n_no_pack FROM v)
      SELECT *, n_active - n_publishable AS n_hidden, round(100.0 * n_publishable / n_active, 1) AS quality_score FROM q""",
    "coverage": _PACKED + f" SELECT {_COVER} FROM packs",
    "category_coverage": _PACKED + f" SELECT super_class, {_COVER} FROM packs GROUP BY 1 HAVING count(*) >= 10",
    "brand_coverage": f"""WITH {d.CTE_OFFERS} SELECT supplier_id, count(*) AS n_items, count(brand_id) AS n_branded,
      round(100.0 * count(brand_id) / count(*), 1) AS brand_pct FROM offers GROUP BY ROLLUP (supplier_id)""",
    "top_brands": f"""WITH {d.CTE_OFFERS} SELECT brand_id, count(*) AS n, round(avg(price), 2) AS avg_price FROM offers
      WHERE active AND brand_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand_id LIMIT 10""",
    "audit_issues": _PACKED + """ , i AS (SELECT super_class, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'mid' ELSE 'low' END AS band,
        list_filter([CASE WHEN brand_id IS NULL THEN 'NO_BRAND' END, CASE WHEN pack_type = 'UNKNOWN' THEN 'NO_PACK' END,
          CASE WHEN pack_type <> 'UNKNOWN' AND pack_type <> unit_type THEN 'UNIT_CONFLICT' END], lambda x: x IS NOT NULL) AS issues FROM packs)
      SELECT super_class, band, issue, count(*) AS n FROM (SELECT super_class, band, unnest(CASE WHEN len(issues) = 0 THEN [NULL] ELSE issues END) AS issue FROM i) GROUP BY 1, 2, 3""",
    "pack_outliers": _PACKED + """ SELECT offer_id, base_qty, CAST(floor(1000 / base_qty) AS BIGINT) AS packs_per_kg FROM packs
      WHERE pack_type IN ('WEIGHT', 'VOLUME') AND base_qty < 50 AND floor(1000 / base_qty) > 20 ORDER BY base_qty, offer_id LIMIT 500""",
    "distributions": f"""WITH {d.CTE_OFFERS}, k AS (SELECT 'fat' AS kind, CAST(CAST(fat_pct AS INT) AS VARCHAR) AS value FROM offers
        UNION ALL SELECT 'cut', cut FROM offers UNION ALL SELECT 'country', origin_country FROM offers)
      , n AS (SELECT kind, value, count(*) AS n FROM k WHERE value IS NOT NULL GROUP BY 1, 2)
      SELECT kind, value, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rank FROM n) WHERE rank <= 10""",
    "origin_share": f"""WITH {d.CTE_OFFERS} SELECT super_class, count(*) AS n, round(count(origin_region) / count(*), 6) AS region_share,
      round(count(origin_city) / count(*), 6) AS city_share FROM offers WHERE super_class IN ('seafood', 'meat') GROUP BY 1""",
    "reconcile_ids": """SELECT 'part_without_offer' AS check, count(*) AS n_total, count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS n_missing FROM part
      UNION ALL SELECT 'supplier_without_offer', count(*), count(*) FILTER (WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) FROM supplier
      UNION ALL SELECT 'customer_without_order', count(*), count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) FROM customer
      UNION ALL SELECT 'order_without_line', count(*), count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) FROM orders""",
    "brand_families": f"""WITH {d.CTE_OFFERS}, b AS (SELECT DISTINCT brand_id, 'family_' || CAST(CAST(regexp_extract(brand_id, '(\\d+)$', 1) AS INT) % 5 AS VARCHAR) AS family_id
        FROM offers WHERE brand_id IS NOT NULL) SELECT family_id, count(*) AS n_brands, string_agg(brand_id, ',' ORDER BY brand_id) AS members FROM b GROUP BY 1""",
}
