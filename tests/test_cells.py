"""Guards and tiers between cells."""

from pyspark.sql import functions as F

from offerloom.operators.rulebits import RULE_SCHEMA, numbered, words_of
from offerloom.plans import guards


def test_words_are_looked_up_in_distinct_runs(spark, monkeypatch):
    """Many texts of few words: the dictionary meets the words, not every substring of every text."""
    from offerloom.operators import rulebits

    met = []
    plain = rulebits.cut_lineage
    monkeypatch.setattr(rulebits, "cut_lineage", lambda df, label: met.append(plain(df, label)) or met[-1])
    rules = [("r", 0, "X", "ask", False, match, word, None) for match, word in [("part", "in on"), ("token", "red"), ("part", "ed"), ("token", "a b"), ("part", " le"), ("token", " x")]]
    lines = numbered(spark.createDataFrame(rules, RULE_SCHEMA))
    texts = [f"skin on{i % 2} red{'' if i % 3 else 'der'} lemon a{' ' if i % 5 else '#'}b" for i in range(300)] + ["#x", "x#", "", None, "le", "a  b"]
    got = {r["id"]: set(r["words"]) for r in words_of(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", ["id"], lines).collect()}

    def held(text):
        from re import sub
        t = " " + sub(r"[^\w%/.,-]+", " ", text.lower()) + " "
        return {f"{m}:{w}" for _, _, _, _, _, m, w, _ in rules if (f" {w} " if m == "token" else w) in t}

    assert got == {i: held(t) for i, t in enumerate(texts) if t is not None and held(t)}
    assert met[0].count() <= 20


def test_cells_ignore_bits_that_refuse_no_pair(spark):
    """Offers that differ in words nothing conflicts with share their cells."""
    rules = spark.createDataFrame([*guards.opposite_rules([("raw", "boiled")]), *guards.conflict_rules([(f"w{i}", ["never"]) for i in range(80)])], RULE_SCHEMA)
    rows = [(i, 10.0, True, "WEIGHT", "c", f"{'raw' if i % 2 else 'boiled'} w{i}", "n") for i in range(80)]
    offers = spark.createDataFrame(rows, "offer_id bigint, price double, active boolean, unit_type string, super_class string, name_raw string, noun string")
    o, lines = guards.compiled(offers, rules, {"fish": ["squid"], "meat": ["beef"]}, {"c": 1.0})
    pairs = guards.cell_pairs(o).collect()
    assert len(pairs) == 4 and sorted((p["n"], p["bit"] is None) for p in pairs) == [(40, False), (40, True), (40, True), (40, True)]
    assert {tuple(r) for r in guards.guard_counts(o, lines).collect()} == {(i, "ATTRIBUTE_CONFLICT", 40) for i in range(1, 80, 2)}


def test_match_percent_works_out_distinct_pairs(spark, monkeypatch):
    """Rows whose reference and choice have the same names and bits share one guard check and one name ratio."""
    from offerloom.plans import hybrid

    stored = {}
    plain = hybrid.cut_lineage
    monkeypatch.setattr(hybrid, "cut_lineage", lambda df, label: stored.setdefault(label, plain(df, label)))
    schema = "offer_id bigint, price double, active boolean, unit_type string, super_class string, name_raw string, noun string, product_core_id string, pack_value double, min_order_qty int, brand_id string, brand_critical boolean"
    rows = [(i, 10.0 + i % 7, True, "WEIGHT", "c", "raw fish" if i % 3 else "boiled fish", "n", "c.n", 1.0, 1, "b", i % 2 == 0) for i in range(60)]
    rules = spark.createDataFrame(guards.opposite_rules([("raw", "boiled")]), RULE_SCHEMA)
    more = ["product_core_id", "pack_value", "min_order_qty", "brand_id", "brand_critical"]
    o, _ = guards.compiled(spark.createDataFrame(rows, schema), rules, {"fish": ["squid"], "meat": ["beef"]}, {"c": 1.0}, more=more)
    refs = o.withColumnRenamed("offer_id", "ref_id").withColumn("qty", F.lit(2.0))
    got = {r["ref_id"]: tuple(r)[1:] for r in hybrid.match_percent(refs, o).collect()}
    # All choose offer 0, a boiled one at 10; only its own kind passes the guards.
    assert stored["percent-pairs"].count() == 2 and len(got) == 60
    for i in range(60):
        raw = i % 3 != 0
        assert (got[i][0] < 90) == raw and got[i][1:] == ((i, True) if raw or (i % 2 == 0 and got[i][0] < 95) else (0, False))


def test_tiers_against_all_pairs(spark, monkeypatch):
    """Shapes meet without brands, so many brands don't multiply the pairs; counts and best offers as by all pairs."""
    import random

    from offerloom.plans import score

    stored = []
    plain = score.cut_lineage
    monkeypatch.setattr(score, "cut_lineage", lambda df, label: stored.append((label, plain(df, label))) or stored[-1][1])
    rng = random.Random(3)
    rows = [
        (i, rng.choice([5.0, 6.0, 7.5]), rng.random() < 0.8, "c", f"c.{rng.choice(['fish', 'crab'])}_{rng.choice(['a', 'b', 'c'])}" if i % 17 else "c.fish",
         rng.choice([None, 1.0, 2.0, 3.5, 9.0]), rng.choice([None, *(f"b{k}" for k in range(12))]),
         " ".join(rng.sample(["smoked", "breaded", "frozen", "chilled", "whole", "headless", "x", "y", "z", "u"], 2)))
        for i in range(260)
    ]
    frame = spark.createDataFrame(rows, "offer_id bigint, price double, active boolean, super_class string, product_core_id string, fat_pct double, brand_id string, name_raw string")
    seen = score.with_tier_features(frame).collect()
    want = set()
    for a in seen:
        found = {}
        for b in seen:
            if a.offer_id == b.offer_id or not b.active or a.ingredient != b.ingredient or a.kind is None or b.kind is None:
                continue
            soft = (a.processing is not None and a.processing != b.processing) or (a.state is not None and b.state is not None and a.state != b.state)
            fat = a.fat_pct is None or (b.fat_pct is not None and abs(a.fat_pct - b.fat_pct) <= 2)
            same = a.kind == b.kind
            tier = "C" if not same else None if not fat else "A" if not soft and not set(a.cuts) - set(b.cuts) else "B"
            if tier:
                points = {"A": 1000, "B": 500, "C": 100}[tier] + 50 * (a.brand_id is not None and a.brand_id == b.brand_id) + 30 + 20 * same
                points += 15 * (a.processing == b.processing) + 10 * (a.state == b.state) + 5 * len(set(a.cuts) & set(b.cuts))
                found.setdefault(tier, []).append((-points, b.price, b.offer_id))
        want |= {(a.offer_id, t, len(f), min(f)[2], -min(f)[0]) for t, f in found.items()}
    assert {tuple(r) for r in score.tiers(frame).collect()} == want
    features = next(df for label, df in stored if label == "tier-features")
    size = lambda *c: features.select("super_class", "ingredient", *c).distinct()
    most = size("kind", "processing", "state", "cuts", "fat_pct").count()
    assert len(want) > 300 and all(df.count() <= most**2 / 4 for label, df in stored if label == "tier-pairs")
