"""Name parsing and signatures on hand-made names."""

import pytest
from pyspark.sql import functions as F

from offerloom.functions import amounts as A
from offerloom.functions import attributes as T
from offerloom.functions import text as X
from offerloom.functions.domain import DOMAIN_COLUMNS, domain_gates, with_domain
from offerloom.functions.signature import with_signature
from offerloom.operators.cells import first_reason


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name,kind,qty,confidence",
    [
        ("Мука 2 кг", "WEIGHT", 2000.0, 1.0), ("Соус 500г", "WEIGHT", 500.0, 1.0), ("Сок 0,5 л", "VOLUME", 500.0, 1.0),
        ("Сахар 10x200г", "WEIGHT", 2000.0, 0.9), ("Стакан 50 шт", "PIECE", 50.0, 1.0), ("Говядина вырезка", "WEIGHT", 1000.0, 0.3),
        ("Базилик сушеный", "WEIGHT", 100.0, 0.3), ("Хлеб ржаной", "WEIGHT", 400.0, 0.3), ("Томаты вес", "WEIGHT", 1000.0, 0.5),
        ("Чай 25п", "PIECE", 25.0, 0.7), ("Нечто", "UNKNOWN", None, 0.0), ("Молоко 1л, 3.2%", "VOLUME", 1000.0, 1.0),
    ],
)
def test_parse_pack(spark, name, kind, qty, confidence):
    p = one(spark, name, A.parse_pack)
    assert (p["unit_type"], p["base_qty"], p["confidence"]) == (kind, qty, confidence)


def test_weights(spark):
    rows = spark.createDataFrame([("Филе 0,35кг кор 5 кг",), ("Тушка 300-400г",), ("Соль",)], "t string")
    got = A.with_weights(rows, F.col("t")).orderBy("t").collect()
    by = {r.t: r for r in got}
    bulk = by["Филе 0,35кг кор 5 кг"]
    assert bulk.bulk_package and bulk.net_weight_kg == 0.35 and bulk.package_weight_kg == 5.0
    assert by["Тушка 300-400г"].net_weight_kg == pytest.approx(0.35) and by["Тушка 300-400г"].variable_weight
    assert by["Соль"].net_weight_kg is None and not by["Соль"].bulk_package


@pytest.mark.parametrize("raw,price", [("1 234,50 ₽", 1234.5), ("1 000", 1000.0), ("0", None), ("нет", None), ("-5", 5.0), (None, None)])
def test_parse_price(spark, raw, price):
    assert one(spark, raw, X.parse_price) == price


@pytest.mark.parametrize(
    "fn,raw,want",
    [
        (X.normalize_name, "Креветки С/М 16/20 1кг Ваннамей 123456", "креветки ваннамей"),
        (X.normalize_search, "Ёрш, 31/40!", "ерш 31/40"),
        (X.clean_code, "2001.0", "2001"),
        (X.short_stem, "креветками", "креветк"),
        (X.short_stem, "сыр", "сыр"),
        (X.item_code, "1234567 Соль", "1234567"),
        (T.caliber, "Креветки 16 / 20 с/м", "16/20"),
        (T.fat_percent, "Сливки 33,5%", 33),
        (T.head_status, "Креветка б/г", "без_головы"),
        (T.trim_grade, "Лосось филе трим D", "trim_d"),
        (A.unit_type, "Кг.", "WEIGHT"),
        (A.unit_norm, "короб", "box"),
    ],
)
def test_text(spark, fn, raw, want):
    assert one(spark, raw, fn) == want


def test_query_words_keep_calibers(spark):
    assert one(spark, "Креветки и 31/40 с хвостом", X.query_words) == ["креветки", "хвостом", "31/40"]


def test_packs_and_penalty(spark):
    row = spark.sql("SELECT 'WEIGHT' a, 1000.0D q, 'WEIGHT' b, 300.0D r").select(
        *[c.alias(n) for n, c in A.packs_needed(F.col("a"), F.col("q"), F.col("b"), F.col("r")).items()]
    ).first()
    assert row.packs_needed == 4 and row.pack_reason == "OK"
    penalties = spark.createDataFrame([(None,), (1,), (2,), (5,), (10,), (20,), (50,), (200,)], "p int").select(A.pack_penalty(F.col("p")).alias("v"))
    assert [r.v for r in penalties.collect()] == [20, 0, 5, 10, 15, 25, 30, 40]


def test_quantities(spark):
    c = {k: v for k, v in A.constrained_qty(F.lit(5.0), F.lit(2), F.lit(3)).items()}
    row = spark.range(1).select(A.effective_qty(F.lit(5.0), F.lit(4)).alias("e"), *[v.alias(k) for k, v in c.items()]).first()
    assert row.e == 8.0 and row.final_qty == 6.0 and row.step_applied and not row.min_rounded


PAIRS = [
    # reference, candidate, first failing gate (None passes)
    ("Креветки ваннамей б/г с/м 16/20", "Креветки ваннамей б/г с/м 16/20 1 кг", None),
    ("Креветки ваннамей б/г с/м 16/20", "Креветки ваннамей б/г с/м 21/25", "CALIBER_MISMATCH"),
    ("Креветки ваннамей б/г с/м 16/20", "Креветки ваннамей б/г с/м", "CALIBER_MISSING"),
    ("Креветки с/м 21/25", "Креветки бланш 21/25", "SHRIMP_STATE_MISMATCH"),
    ("Креветки очищ с/м 21/25", "Креветки с/м 21/25", "SHRIMP_FORM_MISMATCH"),
    ("Креветки очищ с хвостом 21/25", "Креветки очищ без хвоста 21/25", "TAIL_STATE_MISMATCH"),
    ("Креветки очищ с хвостом 21/25", "Креветки очищ 21/25", "TAIL_STATE_UNKNOWN"),
    ("Креветки с/м 21/25", "Креветки с/м 21/25 в панировке", "BREADED_MISMATCH"),
    ("Лосось филе с/м", "Лосось филе охл", "STATE_MISMATCH"),
    ("Лосось филе на коже", "Лосось филе без кожи", "SKIN_MISMATCH"),
    ("Лосось филе на коже", "Лосось филе", None),
    ("Лосось филе 1 кг", "Лосось филе 5 шт", "UOM_MISMATCH"),
    ("Лосось филе", "Лосось филе короб", "IS_BOX_MISMATCH"),
]


@pytest.mark.parametrize("ref,cand,reason", PAIRS)
def test_domain_gates(spark, ref, cand, reason):
    rows = with_domain(spark.createDataFrame([("a", ref), ("b", cand)], "side string, name_raw string"))
    side = {s: rows.filter(F.col("side") == s).select(*[F.col(c).alias(f"{s}_{c}") for c in DOMAIN_COLUMNS]).withColumn("k", F.lit(1)) for s in "ab"}
    got = side["a"].join(side["b"], "k").select(
        first_reason(domain_gates(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).alias("r"), "a_domain", "b_domain", "a_species", "b_species"
    ).first()
    assert got.a_domain == got.b_domain and got.a_species == got.b_species
    assert got.r == reason


@pytest.mark.parametrize(
    "name,domain,black",
    [
        ("Гёдза с креветкой", None, True), ("Минтай филе", "FISH_FILLET", False), ("Минтай в кляре", "FISH_FILLET", False),
        ("Минтай тушка", None, False), ("Чипсы со вкусом креветки", None, True), ("Shrimp vannamei 31/40", "SHRIMP", False), ("Говядина", None, False),
    ],
)
def test_domain_detection(spark, name, domain, black):
    row = with_domain(spark.createDataFrame([(name,)], "name_raw string")).first()
    assert (row.domain, row.blacklisted) == (domain, black)


def test_signature(spark):
    df = spark.createDataFrame(
        [("Соус сырный порционный 25г", "sauce.cheese", None, None, None), ("Филе курин охл без кожи 2 кг", "meat.chicken", None, None, None)],
        "name_raw string, product_core_id string, brand_id string, net_weight_kg double, pack_qty int",
    )
    sauce, fillet = with_signature(df).collect()
    assert sauce.product_type == "sauce" and sauce.is_portion and sauce.portion_weight == 25.0 and sauce.sig_pack == pytest.approx(0.025)
    assert fillet.part_type == "fillet" and fillet.skin == "skinless" and fillet.product_form == "chilled" and fillet.sig_pack == 2.0
