"""The audit suite: every coverage and consistency figure from one pass, held against thresholds, as JSON and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.text import any_contains
from offerloom.plans import derive as d
from offerloom.plans.report import damaged, publishable
from offerloom.session import fresh_dir

# Goods whose words must not stand in a class that contains the text.
CROSS_CHECKS = [
    ("lamb_as_pork", ["баранин", "ягнятин"], "pork"),
    ("pork_as_lamb", ["свинин"], "lamb"),
    ("meat_as_vegetables", ["говядин", "свинин", "баранин", "курин"], "vegetables"),
    ("meat_as_seafood", ["говядин", "свинин", "баранин", "курин"], "seafood"),
]
# Metric, kinds of groups that it is checked for, least group, bounds and severity.
THRESHOLDS = [
    ("core_pct", ["all"], 1, 90.0, None, "WARNING"),
    ("other_pct", ["all"], 1, None, 5.0, "WARNING"),
    ("pack_pct", ["super_class"], 10, 50.0, None, "WARNING"),
    *((f"{name}_errors", ["all"], 1, None, 0.0, "CRITICAL") for name, _, _ in CROSS_CHECKS),
]
GROUPS = ["super_class", "supplier_id", "origin_country"]
THRESHOLD_SCHEMA = "metric string, kinds array<string>, least bigint, low double, high double, severity string"


def flags(offers: DataFrame, checks: Sequence[tuple[str, Sequence[str], str]]) -> dict[str, Column]:
    """What is counted of every live offer; ``_pct`` are shares of live offers, ``_errors`` are counts."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    out = {
        "core_pct": filled("product_core_id"),
        "class_pct": filled("super_class"),
        "other_pct": low("super_class").startswith("other"),
        "brand_pct": filled("brand_id"),
        "country_pct": filled("origin_country"),
        "pack_pct": F.coalesce(F.col("pack_value") > 0, F.lit(False)),
        "price_pct": F.coalesce(F.col("price") > 0, F.lit(False)),
        "publishable_pct": publishable(offers),
    }
    return out | {f"{name}_errors": any_contains(low("name_raw"), list(words)) & F.contains(low("super_class"), F.lit(text)) for name, words, text in checks}


def audit_metrics(offers: DataFrame, checks: Sequence[tuple[str, Sequence[str], str]] = CROSS_CHECKS) -> DataFrame:
    """kind, key, metric, value and n_active: for all live offers and for each value of ``GROUPS``, from one aggregation.

    Groups of a null value have a null key. A table without live offers has n_active 0 for ``all`` and no shares.
    """
    counted = flags(offers, checks)
    live = offers.where(F.coalesce(F.col("active"), F.lit(False))).select(*GROUPS, *(c.cast("int").alias(n) for n, c in counted.items()))
    sets = live.groupingSets([[], *([g] for g in GROUPS)], *GROUPS)
    sums = sets.agg(F.grouping_id().alias("_id"), F.count("*").alias("n_active"), *(F.sum(n).alias(n) for n in counted))
    # A bit of the id is 0 for the column that the group is of, the first column's being the highest.
    marks = {(1 << len(GROUPS)) - 1 - (1 << (len(GROUPS) - 1 - k)): g for k, g in enumerate(GROUPS)}
    kind = F.coalesce(*(F.when(F.col("_id") == i, g) for i, g in marks.items()), F.lit("all"))
    key = F.coalesce(*(F.when(F.col("_id") == i, F.col(g).cast("string")) for i, g in marks.items()))
    n = F.col("n_active")
    value = lambda name: F.when(n > 0, F.round(100.0 * F.col(name) / n, 1)) if name.endswith("_pct") else F.coalesce(F.col(name), F.lit(0)).cast("double")
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), value(name).alias("value")) for name in counted))
    return sums.select(kind.alias("kind"), key.alias("key"), "n_active", F.explode(rows).alias("m")).select("kind", "key", "n_active", "m.metric", "m.value")


def with_severity(metrics: DataFrame, thresholds: Sequence[tuple] = THRESHOLDS) -> DataFrame:
    """The metrics with the severity of the threshold that they miss, null if none; no live offers at all are critical."""
    table = metrics.sparkSession.createDataFrame(list(thresholds), THRESHOLD_SCHEMA)
    rows = metrics.join(table, "metric", "left")
    checked = F.array_contains("kinds", F.col("kind")) & (F.col("n_active") >= F.col("least"))
    missed = F.coalesce(checked & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))), F.lit(False))
    empty = (F.col("kind") == "all") & (F.col("n_active") == 0)
    return rows.select("kind", "key", "n_active", "metric", "value", F.when(empty, "CRITICAL").when(missed, F.col("severity")).alias("severity"))


def write_audit(offers: DataFrame, path: str, checks=CROSS_CHECKS, thresholds=THRESHOLDS) -> DataFrame:
    """Writes all figures as JSON and those that miss a threshold as CSV below ``path``; returns the figures, read back."""
    spark = offers.sparkSession
    found = with_severity(audit_metrics(offers, checks), thresholds)
    found.write.json(f"{path}/figures")
    back = spark.read.schema(found.schema).json(f"{path}/figures")
    back.where("severity is not null").coalesce(1).write.option("header", True).csv(f"{path}/issues")
    return back


# ---------------------------------------------------------------------------------------------
# Stand-ins for the derived names, whose classes are one word.

TEST_CHECKS = [*CROSS_CHECKS, ("soy_as_meat", ["soy"], "meat"), ("steak_as_packaging", ["steak", "fillet"], "pack")]
TEST_THRESHOLDS = [
    *THRESHOLDS, ("soy_as_meat_errors", ["all", "origin_country"], 1, None, 0.0, "CRITICAL"), ("brand_pct", ["supplier_id"], 50, 76.0, None, "WARNING"),
    ("publishable_pct", ["all", "super_class", "origin_country"], 1, 85.0, None, "WARNING"),
]


def q_audit_suite(spark: SparkSession, sf: str) -> DataFrame:
    offers = damaged(d.offers(spark, sf, geo=True))
    return write_audit(offers, fresh_dir(spark, "audit"), TEST_CHECKS, TEST_THRESHOLDS)


def q_audit_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The issues as a reader of the CSV file gets them."""
    path = fresh_dir(spark, "audit")
    found = write_audit(damaged(d.offers(spark, sf, geo=True)), path, TEST_CHECKS, TEST_THRESHOLDS)
    return spark.read.schema(found.schema).option("header", True).csv(f"{path}/issues")


QUERIES = {"audit_suite": q_audit_suite, "audit_alerts": q_audit_alerts}


def _contains(words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_K = "(l_partkey + supplier_id)"
_COUNTS = {
    "core_pct": "coalesce(product_core_id, '') <> ''", "class_pct": "coalesce(super_class, '') <> ''", "other_pct": "super_class LIKE 'other%'", "brand_pct": "coalesce(brand_id, '') <> ''",
    "country_pct": "coalesce(origin_country, '') <> ''", "pack_pct": "coalesce(pv > 0, false)", "price_pct": "coalesce(pr > 0, false)",
    "publishable_pct": "coalesce(pr > 0 AND coalesce(ut, '') <> '' AND (ut = 'PIECE' OR pv > 0), false)",
} | {f"{name}_errors": f"{_contains(words)} AND contains(super_class, '{text}')" for name, words, text in TEST_CHECKS}
_VALUES = " UNION ALL ".join(
    f"SELECT kind, key, n_active, '{m}' AS metric, " + (f"round(100.0 * {m} / n_active, 1)" if m.endswith("_pct") else f"CAST({m} AS DOUBLE)") + " AS value FROM g" for m in _COUNTS
)
_MISSED = " ".join(
    f"WHEN metric = '{m}' AND kind IN ({', '.join(repr(k) for k in kinds)}) AND n_active >= {least} AND {f'value < {low}' if low is not None else f'value > {high}'} THEN '{severity}'"
    for m, kinds, least, low, high, severity in TEST_THRESHOLDS
)
_AUDIT = f"""WITH {d.CTE_OFFERS}
  , dam AS (SELECT *, lower(name_raw) AS low, CASE WHEN {_K} % 11 <> 1 THEN pack_value END AS pv, CASE WHEN {_K} % 23 <> 5 THEN unit_type END AS ut,
      CASE WHEN {_K} % 31 <> 7 THEN CASE WHEN {_K} % 29 = 3 THEN 0.0 ELSE price END END AS pr FROM offers)
  , g AS (SELECT CASE WHEN grouping(super_class) = 0 THEN 'super_class' WHEN grouping(supplier_id) = 0 THEN 'supplier_id' WHEN grouping(origin_country) = 0 THEN 'origin_country' ELSE 'all' END AS kind,
      CASE WHEN grouping(super_class) = 0 THEN super_class WHEN grouping(supplier_id) = 0 THEN CAST(supplier_id AS VARCHAR) WHEN grouping(origin_country) = 0 THEN origin_country END AS key,
      count(*) AS n_active, {', '.join(f"count(*) FILTER (WHERE {test}) AS {m}" for m, test in _COUNTS.items())}
      FROM dam WHERE active GROUP BY GROUPING SETS ((), (super_class), (supplier_id), (origin_country)))
  , v AS ({_VALUES}), s AS (SELECT *, CASE {_MISSED} END AS severity FROM v)"""
ORACLE = {"audit_suite": _AUDIT + " SELECT * FROM s", "audit_alerts": _AUDIT + " SELECT * FROM s WHERE severity IS NOT NULL"}
