"""Rule bits, gram and posting indexes and the offer store against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators.offerstore import OfferStore
from offerloom.operators.postings import PostingIndex
from offerloom.operators.rulebits import RULE_SCHEMA, bit_arrays, first_bit, numbered, words_of
from offerloom.operators.trigrams import gram_index, match_parts
from offerloom.plans import guards
from offerloom.sources.versions import Entry, Versions, read_entries


# --- rules

RULES = [
    *guards.group_rules({"seafood": ["squid", "fish"], "meat": ["beef", "duck"]}),
    *guards.conflict_rules([("rice", ["flour", "noodle"])]),
    *guards.modifier_rules(["smoked", "black"]),
    *guards.class_rules("CROSS_FORBIDDEN", {"seafood.crab": ["stick"]}),
    *guards.opposite_rules([("with skin", "no skin"), ("no skin", "with skin")]),
    *guards.shared_rules(["salt", "16/20"], ["spice", "seafood*"]),
    *guards.class_rules("ANCHOR_MISSING", {"cheese": ["cheese", "feta"]}, missing=True),
    *guards.class_rules("FORBIDDEN_WORD", {"cheese": ["cake"]}),
    *guards.floor_rules({"cheese": 100.0}),
]


def refused(a, b):
    """First reason for a pair of (class, name, price)."""
    (ca, na, _), (cb, nb, pb) = a, b
    x, y = (n or "" for n in (na, nb))
    group = lambda c, n, g, words: (c or "").startswith(g) or (not (c or "").startswith(("seafood", "meat")) and any(w in n for w in words))
    fish, meat = ["squid", "fish"], ["beef", "duck"]
    if (group(ca, x, "seafood", fish) and any(w in y for w in meat)) or (group(ca, x, "meat", meat) and any(w in y for w in fish)):
        return "CATEGORY_MISMATCH"
    if "rice" in x.split() and {"flour", "noodle"} & set(y.split()):
        return "TOKEN_CONFLICT"
    if any((w in x) != (w in y) for w in ("smoked", "black")):
        return "MODIFIER_MISMATCH"
    if ca == "seafood.crab" and "stick" in y:
        return "CROSS_FORBIDDEN"
    if ("with skin" in x and "no skin" in y) or ("no skin" in x and "with skin" in y):
        return "ATTRIBUTE_CONFLICT"
    if any((ca == "spice" or (ca or "").startswith("seafood")) and w in x and w not in y for w in ("salt", "16/20")):
        return "SHARED_WORD_MISSING"
    if ca == "cheese":
        if not any(w in y for w in ("cheese", "feta")):
            return "ANCHOR_MISSING"
        if "cake" in y:
            return "FORBIDDEN_WORD"
    fat = lambda n: next((w for w in n.split() if w.endswith("%")), None)
    size = lambda n: next((w for w in n.split() if "/" in w), None)
    if fat(x) and fat(x) != fat(y):
        return "FAT_MISMATCH"
    if size(x) and size(x) != size(y):
        return "SIZE_MISMATCH"
    if ca == "cheese" and pb is not None and pb < 50:
        return "PRICE_TOO_LOW"
    return None


def offers_for_rules(n, seed):
    rng = random.Random(seed)
    words = ["squid", "beef", "duck", "rice", "ricecake", "flour", "noodle", "smoked", "black", "stick", "with skin", "no skin", "salt", "16/20", "21/25", "cheese", "feta", "cake", "5%", "3.2%"]
    classes = ["seafood.crab", "seafood.squid", "meat.beef", "spice", "cheese", "other", None]
    rows = [(i, rng.choice([10.0, 49.0, 50.0, 500.0]), rng.random() < 0.8, "WEIGHT", rng.choice(classes), " ".join(rng.sample(words, rng.randint(1, 4))), rng.choice(["n1", "n2"])) for i in range(n)]
    rows += [(n, 5.0, True, "WEIGHT", None, None, "n1"), (n + 1, None, True, "WEIGHT", "cheese", "cheese", "n1"), rows[0]]
    return rows


def test_guards_against_pairs(spark):
    rows = offers_for_rules(70, 2)
    offers = spark.createDataFrame(rows, "offer_id bigint, price double, active boolean, unit_type string, super_class string, name_raw string, noun string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    o, lines = guards.compiled(offers, rules, {"seafood": ["squid", "fish"], "meat": ["beef", "duck"]}, {"cheese": 100.0})
    want = {}
    for i, r in enumerate(rows):
        for j, c in enumerate(rows):
            if i != j and r[6] == c[6] and c[2] and c[1]:
                reason = refused((r[4], r[5], r[1]), (c[4], c[5], c[1]))
                if reason:
                    want[i, reason] = want.get((i, reason), 0) + 1
    expected = sorted((rows[i][0], reason, n) for (i, reason), n in want.items())
    assert sorted(map(tuple, guards.guard_counts(o, lines).collect())) == expected
    assert len({reason for _, reason, _ in expected}) >= 10
    best = {r.ask_cell: [b.offer_id for b in r.best] for r in guards.guarded_best(o, 3).collect()}
    for i, row in enumerate(o.select("offer_id", "ask_cell").collect()):
        r = next(x for x in rows if x[0] == row.offer_id)
        fits = sorted({(c[1], c[0]) for c in rows if c[2] and c[1] and c[6] == r[6] and not refused((r[4], r[5], r[1]), (c[4], c[5], c[1]))})
        assert sorted(set(best.get(row.ask_cell, []))) == sorted({i for _, i in fits[:3]}) or rows[0][0] in best.get(row.ask_cell, [])
    usage = {r.rule_id: (r.n_ask, r.n_show) for r in guards.rule_usage(o, lines).collect()}
    live = [r for r in rows if r[2] and r[1]]
    assert usage["conflict rice"] == (sum("rice" in (r[5] or "").split() for r in rows), sum(bool({"flour", "noodle"} & set((r[5] or "").split())) for r in live))


def test_rules_pass_through_a_file(spark, tmp_path):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    guards.write_rules(rules, str(tmp_path / "rules"))
    back = guards.read_rules(spark, str(tmp_path / "rules"))
    key = lambda t: sorted(map(str, map(tuple, t.select(rules.columns).collect())))
    assert key(back) == key(rules)


def test_many_rules(spark):
    """More rules than a number has bits: the first of them counts."""
    rules = [x for k in range(200) for x in guards.pair_rule(f"r{k:03d}", "ATTRIBUTE_CONFLICT", [("token", f"a{k}", None)], [("token", f"b{k}", None)])]
    lines = numbered(spark.createDataFrame(rules, RULE_SCHEMA)).cache()
    names = spark.createDataFrame([("x", "a150 a61 b199"), ("y", "b61 b150"), ("z", "b62 B150"), ("w", "none")], "id string, name string")
    entities = names.join(words_of(names, "name", ["id"], lines), "id", "left").withColumns({"features": F.lit(None).cast("array<string>"), "scope": F.lit(None).cast("string")})
    bits = {r["id"]: r for r in bit_arrays(entities, ["id"], lines).collect()}
    pairs = spark.createDataFrame([(p, q, bits[p].asks, bits[q].shows) for p in bits for q in bits], "a string, b string, asks array<bigint>, shows array<bigint>")
    got = {(r.a, r.b): r.bit for r in pairs.select("a", "b", first_bit(F.col("asks"), F.col("shows")).alias("bit")).collect()}
    assert got["x", "y"] == 61 and got["x", "z"] == 150 and got["x", "w"] is None and got["w", "y"] is None and got["x", "x"] is None


# --- substring search

def test_match_parts(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("abc d/#", k=rng.randint(0, 14))) for _ in range(150)] + ["Éclair XL", "x", "", None, "aaa aaa", "abc" * 700]
    queries = [(f"q{k}", ["".join(rng.choices("abcd/#", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]) for k in range(60)]
    queries += [("none", []), ("null", None), ("blank", ["", None]), ("case", ["éCL", "xl"]), ("single", ["x"]), ("absent", ["ab", "zzz"]), ("gap", ["a a"])]
    frame = spark.createDataFrame(queries, "query_id string, tokens array<string>")
    got = {tuple(r) for r in match_parts(frame, gram_index(spark.createDataFrame([(n,) for n in names + names[:3]], "name string"))).collect()}
    want = set()
    for q, tokens in queries:
        tokens = [t.lower() for t in tokens or [] if t]
        want |= {(q, n) for n in names if n is not None and tokens and " " not in "".join(tokens) and all(t in n.lower() for t in tokens)}
    assert got == want


# --- stored tables

def test_posting_index_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    index = PostingIndex(str(tmp_path / "index"), buckets=4)
    words = [f"t{k}" for k in range(12)]
    state = {f"o{k}": rng.sample(words, rng.randint(0, 4)) for k in range(40)}
    table = lambda rows: spark.createDataFrame(list(rows), "id string, tokens array<string>")
    index.build(table(state.items()))
    for step in range(5):
        changed = {f"o{rng.randint(0, 55)}": rng.sample(words, rng.randint(0, 4)) for _ in range(8)}
        same = {k: state[k] for k in rng.sample(sorted(state), 3) if k not in changed}
        gone = [k for k in rng.sample(sorted(state), 4) if k not in changed and k not in same]
        index.update(table([*changed.items(), *same.items()]), spark.createDataFrame([(k,) for k in gone], "id string"))
        state.update(changed)
        for k in gone:
            state.pop(k)
        if step in (1, 3):
            index.merge(spark)
        want = sorted((t, k) for k, ts in state.items() for t in set(ts))
        assert sorted(map(tuple, index.read(spark).collect())) == want
        assert sorted(map(tuple, index.read(spark, ["t1", "t2", "absent"]).collect())) == [w for w in want if w[0] in ("t1", "t2")]
    index.update(table([]), spark.createDataFrame([], "id string"))
    assert sorted(map(tuple, index.read(spark).collect())) == want


def test_versions(spark, tmp_path):
    versions = Versions(str(tmp_path / "v"))
    assert versions.newest(spark) is None and versions.entries(spark, None) == []
    for n in (1, 2, 3):
        spark.range(n).select(F.col("id").cast("string")).write.parquet(str(tmp_path / f"v/d{n}"))
        versions.commit(spark, n, [Entry("x", 0, str(tmp_path / f"v/d{n}"), n)])
    assert versions.newest(spark) == 3 and versions.newest(spark, 3) == 2
    assert versions.clean(spark) == [str(tmp_path / "v/d1")] and not (tmp_path / "v/d1").exists()
    assert read_entries(spark, versions.entries(spark, 3), "id string").count() == 3
    assert read_entries(spark, [], "id string").count() == 0


@pytest.mark.parametrize("most", [2, 100])
def test_offer_store_takes_lists_in_any_parts(spark, tmp_path, most):
    rng = random.Random(7)
    schema = "unique_key string, supplier_id bigint, article string, name_raw string, unit_type string, price double, price_list_id string, list_no int, row_no bigint"
    rows = [(f"{s}:{rng.randint(0, 9)}", s, None, "n", "kg", float(k), f"v{n}", n, k) for k in range(60) for s in [rng.randint(1, 3)] for n in [rng.randint(2, 4)]]
    first = [(f"{s}:{k}", s, None, "n", "kg", 0.5, "v1", 1, 0) for s in range(1, 5) for k in range(5)]
    newest = {}
    best = {}
    for r in first + rows:
        newest[r[1]] = max(newest.get(r[1], 0), r[7])
        if r[0] not in best or (r[7], r[8]) > (best[r[0]][7], best[r[0]][8]):
            best[r[0]] = r
    want = sorted((k, r[5], r[6], r[7] == newest[r[1]] and (r[7] > 1 or k != "4:0")) for k, r in best.items())
    store = OfferStore(str(tmp_path / "store"), buckets=3, most=most)
    store.create(spark.createDataFrame(first, schema).withColumn("active", F.col("unique_key") != "4:0"))
    rng.shuffle(rows)
    for batch in range(3):
        part = spark.createDataFrame(rows[batch::3], schema)
        for _ in range(2 if batch == 1 else 1):  # one batch runs again
            store.add(part, 2 * batch + 2)
            store.compact(spark, 2 * batch + 3)
    got = sorted((r.unique_key, r.price, r.price_list_id, r.active) for r in store.read(spark).collect())
    assert got == want
