"""Offer enrichment from the free-text name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import amounts as A
from offerloom.functions import attributes as T
from offerloom.functions import text as X
from offerloom.plans import derive as d


def enrich_offers(offers: DataFrame) -> DataFrame:
    """All name-derived columns of an offer. Narrow: no shuffle, every row on its own."""
    name = F.col("name_raw")
    out = A.with_weights(offers, name).withColumns(
        {
            "name_norm": X.normalize_name(name),
            "item_code": X.item_code(name),
            "unit_norm": A.unit_norm(F.col("unit_supplier")),
            "pack_qty": A.pack_quantity(name),
            "net_volume_l": A.net_volume(name),
            "caliber": T.caliber(name),
            "fat_pct_name": T.fat_percent(name),
            "head_status": T.head_status(name),
            "cooking_state": T.cooking_state(name),
            "trim_grade": T.trim_grade(name),
            "processing_flags": T.processing_flags(X.normalize_name(name)),
            "pack": A.parse_pack(name),
        }
    )
    out = out.withColumn("base_unit", A.base_unit(F.col("net_weight_kg"), F.col("net_volume_l")))
    ppu = A.unit_price(
        F.col("price"), F.col("unit_norm"), F.col("base_unit"), F.col("net_weight_kg"), F.col("net_volume_l"),
        F.col("piece_weight_kg"), F.col("pack_qty"),
    )
    out = out.withColumn("_p", ppu)
    return out.withColumns(
        {
            "price_per_base_unit": F.col("_p.ppu"),
            "calc_route": F.col("_p.route"),
            "base_price_unknown": F.col("_p.unknown"),
            "calc_confidence": A.route_confidence(F.col("_p.route"), F.col("variable_weight")),
        }
    ).drop("_p")


def q_units(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_weights(d.items(spark, sf), F.col("name_raw")).select(
        "p_partkey",
        A.unit_type(F.col("unit_supplier")).alias("unit_type"),
        A.unit_norm(F.col("unit_supplier")).alias("unit_norm"),
        F.round("net_weight_kg", 6).alias("net_weight_kg"),
        F.round("package_weight_kg", 6).alias("package_weight_kg"),
        F.round("piece_weight_kg", 6).alias("piece_weight_kg"),
        "variable_weight",
        "bulk_package",
        F.round(A.net_volume(F.col("name_raw")), 6).alias("net_volume_l"),
    )


def q_pack(spark: SparkSession, sf: str) -> DataFrame:
    return d.items(spark, sf).select("p_partkey", A.parse_pack(F.col("name_raw")).alias("p")).select(
        "p_partkey", F.col("p.unit_type").alias("pack_type"), F.round("p.base_qty", 4).alias("base_qty"),
        F.col("p.confidence").alias("confidence"),
    )


def q_packs_needed(spark: SparkSession, sf: str) -> DataFrame:
    """Each item asked for 2.5 kg, l or 2500 pieces by unit, covered by its own pack."""
    it = d.items(spark, sf).withColumn("p", A.parse_pack(F.col("name_raw")))
    n = A.packs_needed(F.col("unit_type"), F.lit(2500.0), F.col("p.unit_type"), F.col("p.base_qty"))
    it = it.withColumns(n)
    return it.select(
        "p_partkey",
        "packs_needed",
        "pack_reason",
        A.pack_penalty(F.col("packs_needed")).alias("penalty"),
        A.pack_explanation(F.col("unit_type"), F.lit(2500.0), F.col("p.base_qty"), F.col("packs_needed")).alias("explanation"),
    )


def q_ppu(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_offers(d.offers(spark, sf)).select(
        "offer_id", "base_unit", "calc_route", "base_price_unknown", "calc_confidence",
        F.round("price_per_base_unit", 7).alias("ppu"),
        F.round(A.ranking_price(F.col("price"), F.col("unit_type"), F.col("pack_value")), 8).alias("ranking_price"),
        F.round(A.min_line_total(F.col("price"), F.col("min_order_qty")), 2).alias("min_line_total"),
    )


def q_ppu_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return (
        enrich_offers(d.offers(spark, sf))
        .groupBy("calc_route", "calc_confidence")
        .agg(F.count("*").alias("n"), F.count("price_per_base_unit").alias("n_known"))
    )


def q_attributes(spark: SparkSession, sf: str) -> DataFrame:
    e = enrich_offers(d.items(spark, sf).withColumn("price", F.lit(1.0)))
    return e.select(
        "p_partkey", "caliber", "fat_pct_name", "head_status", "cooking_state", "trim_grade",
        F.array_join("processing_flags", ",").alias("processing_flags"),
    )


def q_names(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name_raw")
    return d.items(spark, sf).select(
        "p_partkey",
        X.normalize_name(n).alias("name_norm"),
        X.normalize_search(n).alias("search_form"),
        X.normalize_alias(n).alias("alias_form"),
        F.array_join(X.semantic_tokens(n, ["frozen", "chilled"]), " ").alias("semantic"),
        X.item_code(F.concat(F.col("p_partkey") + 1000000, F.lit(" "), n)).alias("item_code"),
    )


QUERIES = {
    "enrich_units": q_units,
    "enrich_pack": q_pack,
    "packs_needed": q_packs_needed,
    "ppu_routes": q_ppu,
    "ppu_confidence": q_ppu_confidence,
    "attributes": q_attributes,
    "name_forms": q_names,
}

_B = "(?:[^0-9a-zа-яё_]|$)"
_W = rf"(\d+(?:[.,]\d+)?)\s*[-~]?\s*(\d+(?:[.,]\d+)?)?\s*(кг|kg|гр|г|g){_B}"
_V = rf"(\d+(?:[.,]\d+)?)\s*(ml|мл|л|l){_B}"
_NUM = "CAST(replace({0}, ',', '.') AS DOUBLE)"
_AMOUNTS = rf"""
 w1 AS (SELECT *, lower(name_raw) AS low, regexp_extract_all(lower(name_raw), '{_W}', 1) AS a1,
    regexp_extract_all(lower(name_raw), '{_W}', 2) AS a2, regexp_extract_all(lower(name_raw), '{_W}', 3) AS a3,
    regexp_extract_all(lower(name_raw), '{_V}', 1) AS v1, regexp_extract_all(lower(name_raw), '{_V}', 2) AS v2 FROM src)
, w2 AS (SELECT *, list_transform(range(1, len(a1) + 1), lambda i: (CASE WHEN a2[i] <> '' THEN ({_NUM.format('a1[i]')} +
      {_NUM.format("CASE WHEN a2[i] = '' THEN '0' ELSE a2[i] END")}) / 2 ELSE {_NUM.format('a1[i]')} END)
      / (CASE WHEN a3[i] IN ('г', 'гр', 'g') THEN 1000 ELSE 1 END)) AS kg,
    list_transform(range(1, len(v1) + 1), lambda i: {_NUM.format('v1[i]')} / (CASE WHEN v2[i] IN ('ml', 'мл') THEN 1000 ELSE 1 END)) AS lit,
    len(list_filter(a2, lambda x: x <> '')) > 0 AS variable_weight FROM w1)
, w3 AS (SELECT *, len(kg) > 1 AND list_max(kg) >= 2 AND list_max(kg) / list_min(kg) >= 5 AS bulk FROM w2)
, w4 AS (SELECT *, CASE WHEN bulk THEN list_min(kg) ELSE list_max(kg) END AS net_weight_kg,
    CASE WHEN bulk THEN list_max(kg) END AS package_weight_kg,
    CASE WHEN len(kg) > 1 THEN list_min(kg) END AS piece_weight_kg, list_max(lit) AS net_volume_l FROM w3)
"""
_UNIT = "CASE unit_supplier WHEN 'шт' THEN 'pcs' ELSE unit_supplier END"
# The test names hold kg, g, г, l, ml and pcs amounts only, so the oracle states just those rules.
_PACK = rf"""
 p AS (SELECT *, lower(name_raw) AS low FROM src)
, q AS (SELECT *, regexp_extract(low, '(\d+)\s*x\s*(\d+[.,]?\d*)\s*(кг|г|л|мл)', 1) AS mx,
   regexp_extract(low, '(\d+)\s*x\s*(\d+[.,]?\d*)\s*(кг|г|л|мл)', 2) AS my,
   regexp_extract(low, '(\d+[.,]?\d*)\s*kg', 1) AS k, regexp_extract(low, '(\d+[.,]?\d*)\s*gr?{_B}', 1) AS g,
   regexp_extract(low, '(\d+[.,]?\d*)\s*l{_B}', 1) AS l, regexp_extract(low, '(\d+[.,]?\d*)\s*ml', 1) AS ml,
   regexp_extract(low, '(\d+)\s*pcs', 1) AS n FROM p)
, packs AS (SELECT *, CASE WHEN mx <> '' OR k <> '' OR g <> '' THEN 'WEIGHT' WHEN l <> '' OR ml <> '' THEN 'VOLUME'
     WHEN n <> '' THEN 'PIECE' ELSE 'UNKNOWN' END AS pack_type,
   CASE WHEN mx <> '' THEN CAST(mx AS DOUBLE) * CAST(my AS DOUBLE) WHEN k <> '' THEN CAST(k AS DOUBLE) * 1000
     WHEN g <> '' THEN CAST(g AS DOUBLE) WHEN l <> '' THEN CAST(l AS DOUBLE) * 1000 WHEN ml <> '' THEN CAST(ml AS DOUBLE)
     WHEN n <> '' THEN CAST(n AS DOUBLE) END AS base_qty,
   CASE WHEN mx <> '' THEN 0.9 WHEN coalesce(nullif(k, ''), nullif(g, ''), nullif(l, ''), nullif(ml, ''), nullif(n, '')) IS NULL
     THEN 0.0 ELSE 1.0 END AS confidence FROM q)
"""
_FLAG = "CASE WHEN {} THEN '{}' END"
_ROUTED = f"""WITH {d.CTE_OFFERS}, src AS (SELECT * FROM offers), {_AMOUNTS}
 , u AS (SELECT *, {_UNIT} AS unit_norm, CASE WHEN net_weight_kg > 0 THEN 'kg' WHEN net_volume_l > 0 THEN 'l' ELSE 'pcs' END AS base_unit FROM w4)
 , routed AS (SELECT *, CASE WHEN unit_norm = 'kg' THEN 'A' WHEN unit_norm = 'l' THEN 'B' WHEN net_weight_kg > 0 THEN 'C'
      WHEN net_volume_l > 0 THEN 'D' ELSE '0_pcs' END AS calc_route FROM u)
 , priced AS (SELECT *, CASE calc_route WHEN 'C' THEN price / net_weight_kg WHEN 'D' THEN price / net_volume_l ELSE price END AS ppu,
      CASE WHEN calc_route IN ('A', 'B') THEN 1.0 WHEN calc_route = 'C' THEN CASE WHEN variable_weight THEN 0.7 ELSE 0.9 END
      WHEN calc_route = 'D' THEN 0.85 ELSE 0.8 END AS calc_confidence FROM routed)"""

ORACLE = {
    "enrich_units": f"""WITH {d.CTE_ITEMS}, src AS (SELECT * FROM items), {_AMOUNTS}
        SELECT p_partkey, CASE unit_supplier WHEN 'kg' THEN 'WEIGHT' WHEN 'l' THEN 'VOLUME' ELSE 'PIECE' END AS unit_type,
          {_UNIT} AS unit_norm, round(net_weight_kg, 6) AS net_weight_kg, round(package_weight_kg, 6) AS package_weight_kg,
          round(piece_weight_kg, 6) AS piece_weight_kg, variable_weight, bulk AS bulk_package,
          round(net_volume_l, 6) AS net_volume_l FROM w4""",
    "enrich_pack": f"""WITH {d.CTE_ITEMS}, src AS (SELECT * FROM items), {_PACK}
        SELECT p_partkey, pack_type, round(base_qty, 4) AS base_qty, CAST(confidence AS DOUBLE) AS confidence FROM packs""",
    "packs_needed": f"""WITH {d.CTE_ITEMS}, src AS (SELECT * FROM items), {_PACK}
        , n AS (SELECT *, CASE WHEN pack_type = 'UNKNOWN' THEN 'OFFER_UNIT_UNKNOWN' WHEN unit_type <> pack_type
             THEN 'UNIT_MISMATCH_' || unit_type || '_vs_' || pack_type ELSE 'OK' END AS pack_reason FROM packs)
        , m AS (SELECT *, CAST(CASE pack_reason WHEN 'OK' THEN ceil(2500.0 / base_qty) WHEN 'OFFER_UNIT_UNKNOWN' THEN 1 END AS BIGINT) AS packs_needed FROM n)
        , t AS (SELECT *, CASE unit_type WHEN 'WEIGHT' THEN CASE WHEN base_qty >= 1000 THEN format('{{:.1f}} кг', round_even(base_qty / 1000, 1)) ELSE format('{{:.0f}} г', base_qty) END
              WHEN 'VOLUME' THEN CASE WHEN base_qty >= 1000 THEN format('{{:.1f}} л', round_even(base_qty / 1000, 1)) ELSE format('{{:.0f}} мл', base_qty) END
              ELSE format('{{:.0f}} шт', base_qty) END AS each,
              CASE unit_type WHEN 'WEIGHT' THEN '2.5 кг' WHEN 'VOLUME' THEN '2.5 л' ELSE '2500 шт' END AS need FROM m)
        SELECT p_partkey, packs_needed, pack_reason, CASE WHEN packs_needed IS NULL THEN 20 WHEN packs_needed <= 1 THEN 0
             WHEN packs_needed <= 2 THEN 5 WHEN packs_needed <= 5 THEN 10 WHEN packs_needed <= 10 THEN 15
             WHEN packs_needed <= 20 THEN 25 WHEN packs_needed <= 50 THEN 30 ELSE 40 END AS penalty,
             coalesce(CASE WHEN packs_needed > 0 AND base_qty > 0 THEN CAST(packs_needed AS STRING) || ' × ' || each || ' = ' || need END, '') AS explanation FROM t""",
    "ppu_routes": _ROUTED + """ SELECT offer_id, base_unit, calc_route, false AS base_price_unknown,
        CAST(calc_confidence AS DOUBLE) AS calc_confidence, round(ppu, 7) AS ppu,
        round(CASE WHEN unit_type <> 'PIECE' THEN price / pack_value END, 8) AS ranking_price,
        round(price * greatest(min_order_qty, 1), 2) AS min_line_total FROM priced""",
    "ppu_confidence": _ROUTED + """ SELECT calc_route, CAST(calc_confidence AS DOUBLE) AS calc_confidence, count(*) AS n,
        count(ppu) AS n_known FROM priced GROUP BY 1, 2""",
    "attributes": rf"""WITH {d.CTE_ITEMS} , p AS (SELECT *, lower(name_raw) AS low FROM items)
        SELECT p_partkey, nullif(regexp_extract(low, '(\d\d/\d\d)', 1), '') AS caliber,
          CAST(nullif(regexp_extract(low, '(\d+)%', 1), '') AS INT) AS fat_pct_name,
          CASE WHEN contains(low, 'headless') THEN 'без_головы' END AS head_status,
          CASE WHEN contains(low, 'chilled') THEN 'охлажден' END AS cooking_state, CAST(NULL AS VARCHAR) AS trim_grade,
          concat_ws(',', {_FLAG.format("contains(low, 'bread')", 'breaded')}, {_FLAG.format("contains(low, 'sliced')", 'sliced')},
            {_FLAG.format("contains(low, 'smoked')", 'smoked')}, {_FLAG.format("contains(low, 'whole')", 'whole')}) AS processing_flags FROM p""",
    "name_forms": rf"""WITH {d.CTE_ITEMS}
        , p AS (SELECT *, regexp_replace(regexp_replace(lower(name_raw), '\d+-?\d*\s*(kg|г|g|ml|l){_B}', ' ', 'g'), '\d\d/\d\d', '', 'g') AS s FROM items)
        SELECT p_partkey,
          array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(s, '[^0-9a-zа-я_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
             lambda w: len(w) > 1 AND w <> 'frozen'), ' ') AS name_norm,
          trim(regexp_replace(regexp_replace(lower(name_raw), '[^0-9a-zа-я_/\s]', ' ', 'g'), '\s+', ' ', 'g')) AS search_form,
          trim(regexp_replace(regexp_replace(regexp_replace(lower(name_raw), '[/\-]', ' ', 'g'), '[^0-9a-zа-я_\s]', '', 'g'), '\s+', ' ', 'g')) AS alias_form,
          array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(name_raw), '\d+\s*(kg|г|g|ml|l|pcs){_B}', ' ', 'g'), '[а-яёa-z]+'),
             lambda w: len(w) >= 2 AND w NOT IN ('frozen', 'chilled')))), ' ') AS semantic,
          CAST(p_partkey + 1000000 AS VARCHAR) AS item_code FROM p""",
}
