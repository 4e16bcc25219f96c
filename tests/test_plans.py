"""Plans on small tables: nulls, empty tables, ties, and cases that the derived tables don't hold."""

import pytest
from pyspark.sql import functions as F

from offerloom.plans import audit, derive, extract, hybrid, nearest, score, search, select
from offerloom.sources import feeds
from tests.test_ratios import set_ratio


def test_nearest_labels(spark):
    labelled = spark.createDataFrame([("frozen squid rings", "seafood"), ("frozen squid rings", "fish"), ("beef steak", "meat"), (None, "x"), ("no class", None)], "text string, super_class string")
    names = spark.createDataFrame([("squid rings frozen 1kg",), ("beaf steak",), ("zzz",), (None,), ("",), ("beaf steak",)], "text string")
    got = {r.name: (r.matched, r.super_class, r.confidence) for r in nearest.nearest_labels(names, labelled).collect()}
    ratio = set_ratio("beaf steak", "beef steak") / 100
    assert got == {
        "squid rings frozen 1kg": ("frozen squid rings", "fish", 1.0), "beaf steak": ("beef steak", "meat", pytest.approx(ratio)),
        "zzz": (None, "other", 0.30), "": (None, "other", 0.30),
    }
    assert nearest.nearest_labels(names, labelled.where("false")).where("super_class <> 'other'").count() == 0
    assert nearest.nearest_labels(names.where("false"), labelled).count() == 0


def test_brand_layout(spark):
    known = spark.createDataFrame([("heinz", "heinz", 1), ("sen soy", "sensoy", 0)], "word string, brand_id string, ord int")
    rows = {
        "Кетчуп HEINZ Sen Soy 1 кг": ("sensoy", 1.0, "known"), "Рис, Россия, Мистраль": (None, 0.0, None),  # the comma is spent on the country
        "Рис, Мистраль, Россия": ("мистраль", 0.7, "comma"), "Масло 500 гр. Простор": ("простор", 0.6, "unit"),
        "Сок «Мой сад» 1л": ("мой_сад", 0.8, "quotes"), "Рис, Россия": (None, 0.0, None), "Мука 2 кг Экстра": (None, 0.0, None), "": (None, 0.0, None), "Сыр, D'Or-ё": ("dor-е", 0.7, "comma"),
    }
    names = spark.createDataFrame([(n,) for n in [*rows, None, ""]], "name string")
    got = {r.name: (r.brand, r.confidence, r.place) for r in extract.brand_by_layout(names, known).collect()}
    assert got == rows
    assert extract.brand_by_layout(names, known.where("false")).where("place = 'known'").count() == 0


def test_seed_cores(spark):
    schema = "raw string, canonical string, type string, action string, ord int"
    rules = spark.createDataFrame([("сыр", "cheese", "ingredient", None, 0), ("сырник", "syrnik", "product", "", 1), ("творог", "curd", "product", "skip", 2), ("с", "xx", "category", "", 3), (None, "none", "category", "", 4), ("сыр", "cheese2", "ingredient", "", 5)], schema)
    names = spark.createDataFrame([("Сырники творожные",), ("СЫР твёрдый!",), ("Творог",), (None,), ("",)], "name string")
    got = {r.name: r.core for r in extract.seed_cores(names, rules).collect()}
    assert got == {"Сырники творожные": "syrnik", "СЫР твёрдый!": "cheese2", "Творог": None, "": None}
    assert extract.seed_cores(names, rules.where("false")).where("core is not null").count() == 0


AUDITED = "offer_id bigint, active boolean, product_core_id string, super_class string, brand_id string, origin_country string, pack_value double, price double, unit_type string, supplier_id bigint, name_raw string"


def test_audit_of_few_offers(spark, tmp_path):
    rows = [(1, True, "a", "other.x", None, None, 0.0, 5.0, "PIECE", 1, "Баранина"), (2, True, None, "meat.pork", "b", "RU", 1.0, None, "WEIGHT", 1, "БАРАНИНА нога"), (3, None, "a", "x", "b", "RU", 1.0, 1.0, "KG", 2, "n"), (4, False, "a", "x", "b", "RU", 1.0, 1.0, "KG", 2, None), (5, True, "", None, "", None, None, 2.0, None, None, None)]
    found = audit.write_audit(spark.createDataFrame(rows, AUDITED), str(tmp_path / "a"))
    got = {(r.kind, r.key, r.metric): (r.value, r.severity) for r in found.collect()}
    assert got["all", None, "core_pct"] == (33.3, "WARNING") and got["all", None, "other_pct"] == (33.3, "WARNING")
    assert got["all", None, "lamb_as_pork_errors"] == (1.0, "CRITICAL") and got["all", None, "pork_as_lamb_errors"] == (0.0, None)
    assert got["super_class", "meat.pork", "pack_pct"] == (100.0, None) and got["supplier_id", None, "brand_pct"] == (0.0, None) and got["origin_country", "RU", "price_pct"] == (0.0, None)
    issues = spark.read.schema(found.schema).option("header", True).csv(str(tmp_path / "a/issues"))
    assert sorted(r.metric for r in issues.collect()) == ["core_pct", "lamb_as_pork_errors", "other_pct"]
    none = audit.with_severity(audit.audit_metrics(spark.createDataFrame([], AUDITED))).collect()
    assert {r.kind for r in none} <= {"all"} and all(r.severity == "CRITICAL" and r.n_active == 0 for r in none)


def test_feed_layouts(spark, tmp_path):
    files = {
        "old.csv": ("Прайс на май;;;\nАртикул;Наименование;Ед.;Цена\n1;Соль, мелкая;кг;20,5\n2;Рис;кг;50\n".encode("cp1251"), ("cp1251", ";", 4, 4)),
        "new.csv": ('name,unit,price\n"Salt, fine",kg,20\nRice; long,kg,50\n'.encode(), ("UTF-8", ",", 3, 3)),
        "tab.csv": ("название\tцена\nСоль\t5\n".encode(), ("UTF-8", "\t", 2, 2)),
        "one.csv": ("just\nlines\n".encode(), ("UTF-8", None, 1, 2)),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[-1]: (r.encoding, r.sep, r.n_fields, r.n_lines) for r in feeds.layouts(spark, str(tmp_path)).collect()}
    assert got == {name: told for name, (_, told) in files.items()}
    read = lambda name: [(r.name, r.article, r.unit, r.price) for r in feeds.read_feed(spark, feeds.Feed("s", str(tmp_path / name), "", "")).orderBy("row_no").collect()]
    assert read("old.csv") == [("Соль, мелкая", "1", "кг", "20,5"), ("Рис", "2", "кг", "50")]
    assert read("new.csv") == [("Salt, fine", None, "kg", "20"), ("Rice; long", None, "kg", "50")] and read("tab.csv") == [("Соль", None, None, "5")]
    with pytest.raises(ValueError):
        read("one.csv")


def test_a_row_like_the_heading_stays(spark, tmp_path):
    """Only the heading itself goes, not rows further down that repeat it."""
    (tmp_path / "f.csv").write_text("name,price\n" + "a,1\n" * 6 + "name,price\n")
    rows = feeds.read_feed(spark, feeds.Feed("s", str(tmp_path / "f.csv"))).orderBy("row_no").collect()
    assert [r.name for r in rows] == ["a"] * 6 + ["name"]


def test_synonym_choices(spark):
    table = search.synonym_table(spark, [["курица", "кур", "chicken"], ["филе", "филей"], ["кур", "петух"]])
    queries = spark.createDataFrame([("q", ["кур", "филейка", "ку", "xyz", "chick"]), ("none", []), ("null", None)], "query_id string, tokens array<string>")
    got = {r.query_id: sorted(sorted(c) for c in r.choices) for r in search.synonym_choices(queries, table).collect()}
    assert got == {"q": sorted([["кур", "петух"], ["филе", "филей", "филейка"], [], ["xyz"], ["chick", "chicken", "курица"]])}


def test_reference_matches_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = ["рис", "frozen", "заморож", "мука", "steak", "стейк", "соус", "кг", "beef", "pork", "long", "grain"]
    rows = [(k, rng.sample(words, rng.randint(0, 5)), rng.choice(["a.x", "a.y", "b", None, ""]), rng.choice([None, 0.0, 1.0, 1.1, 2.0]), rng.choice([None, 1.0]), rng.choice([None, "M", "m", "n"]), rng.random() < 0.4, rng.random() < 0.8) for k in range(60)]
    raw = spark.createDataFrame(rows, "id bigint, tokens array<string>, super_class string, net_weight_kg double, net_volume_l double, brand_id string, strict boolean, live boolean")
    items = raw.withColumn("words", select.telling_words(F.col("tokens"))).drop("tokens").cache()
    for threshold in (0.85, 0.6):
        a, b = (items.select(*(F.col(c).alias(f"{p}_{c}") for c in items.columns)) for p in "ab")
        every = a.crossJoin(b).where("b_live").withColumn("score", select.reference_score()).where(F.col("score") >= threshold)
        want = {(r.a_id, r.b_id, r.score) for r in every.collect() if not r.a_strict or not r.a_brand_id or (r.b_brand_id or "").lower() == r.a_brand_id.lower()}
        if threshold == 0.85:
            assert {w[:2] for w in want} and all(len(rows[i][1]) for i, _, _ in want)
        got = {tuple(r) for r in select.reference_matches(items, threshold).collect()}
        assert got == want


def test_hybrid_match_counts_prices_below(spark):
    """An option at the asked price is not cheaper; items of one cell, prices of one bucket and of lower ones all count."""
    items = spark.createDataFrame([(i, "c1" if i < 6 else "c2", 2.0, p, i * 10 if p else None) for i, p in enumerate([5.0, 5.0, 5.01, 9.0, 0.5, None, 4.0])], "p_partkey bigint, cell string, net_weight_kg double, price double, offer_id bigint")
    pairs = spark.createDataFrame([("c1", "c1"), ("c1", "c2")], "a_id string, b_id string")
    refs = spark.createDataFrame([(1, 0, 5.0), (2, 5, 5.01), (3, 3, 100.0), (4, 0, 0.5), (5, 6, 7.0), (6, 0, None), (7, 1, 5.0)], "ref_id bigint, l_partkey bigint, price double")
    got = {r.ref_id: tuple(r)[1:] for r in hybrid.hybrid_match(refs, items, pairs).collect()}
    assert got == {1: (2, 40, 0.5), 2: (4, 40, 0.5), 3: (6, 40, 0.5), 4: (0, None, None), 5: (0, None, None), 6: (0, None, None), 7: (2, 40, 0.5)}


def test_scored_cells(spark):
    """Items of equal features are scored as one cell, and the first by score and id come out for every item."""
    rows = [(i, "a b c", "x", "kg", "pcs", ["alpha", "beta", "gamma"] if i < 5 else ["alpha", "beta", "gamma", "delta"], None, None, [], "b", 1.0, None, float(i) if i != 1 else None, i if i != 1 else None) for i in range(8)]
    cells = spark.createDataFrame(rows, "p_partkey bigint, name_raw string, super_class string, base_unit string, unit_norm string, tokens array<string>, caliber string, fat int, flags array<string>, brand_id string, net_weight_kg double, net_volume_l double, price double, offer_id bigint")
    items, best = score.scored_cells(cells, 70, 3)
    assert best.select("cell").distinct().count() == 2
    got = sorted((r.a_id, r["rank"], r.b_id) for r in score.score_weighted(cells, 70, 3).collect())
    assert got == [(a, k + 1, b) for a in range(8) for k, b in enumerate([0, 2, 3] if a < 5 else [5, 6, 7])]


def test_offers_never_broadcast_item_texts(spark):
    plan = derive.offers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan
