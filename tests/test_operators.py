"""Ladders, running sums, rules, merges, feeds and streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators.cells import band_join
from offerloom.operators.ladder import nearest
from offerloom.operators.merge import clean_batch, import_stats, last_per_key, merge_snapshot
from offerloom.operators.offerstore import OfferStore
from offerloom.operators.rules import Rule, first_hit, hits
from offerloom.operators.running import sum_before
from offerloom.operators import tokensets
from offerloom.operators.tokensets import overlapping
from offerloom.plans import classify, search
from offerloom.session import fresh_dir
from offerloom.sources import feeds
from offerloom.streaming import jobs


@pytest.mark.parametrize("k,above", [(1, True), (3, False), (3, True)])
def test_nearest_equals_brute_force(spark, k, above):
    rnd = random.Random(5)
    # One line holds most rungs, and many rungs share a price.
    rungs = [("hot" if rnd.random() < 0.7 else f"L{rnd.randrange(3)}", rnd.choice([7.0, 7.0, round(rnd.uniform(1, 900), 2)]), i) for i in range(500)]
    asked = sorted({(rnd.choice(["hot", "L0", "L1", "none"]), rnd.choice([7.0, round(rnd.uniform(0.5, 1200), 2)])) for _ in range(250)})
    got = nearest(
        spark.createDataFrame(asked, "line string, v double"), spark.createDataFrame(rungs, "line string, price double, tie bigint"),
        "line", "v", "price", "tie", k, above,
    )
    found = {(r.line, r.v): [(x.price, x.tie) for x in r.near] for r in got.collect()}
    for line, v in asked:
        fit = [(p, t) for l, p, t in rungs if l == line and (p >= v if above else p <= v)]
        assert found[(line, v)] == sorted(fit, key=lambda x: (x[0] if above else -x[0], x[1]))[:k]


def test_band_join_equals_filter(spark):
    rnd = random.Random(2)
    a = [(rnd.choice("xy"), round(rnd.uniform(0.1, 9), 2)) for _ in range(80)]
    b = [(rnd.choice("xy"), round(rnd.uniform(0.1, 9), 2)) for _ in range(80)]
    l, r = spark.createDataFrame(a, "k string, p double"), spark.createDataFrame(b, "k string, q double")
    got = band_join(l, r, ["k"], "p", "q", 0.8, 1.2).filter((F.col("q") >= F.col("p") * 0.8) & (F.col("q") <= F.col("p") * 1.2)).count()
    assert got == sum(k == m and p * 0.8 <= q <= p * 1.2 for k, p in a for m, q in b)


def test_sum_before(spark):
    rows = [(i % 2, i, float(i * 3 % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, v double").withColumn("chunk", F.floor(F.col("o") / 16))
    got = {(r.g, r.o): r.before for r in sum_before(df, ["g"], "chunk", ["o"], F.col("v"), "before").collect()}
    for g, o, _ in rows:
        assert got[(g, o)] == pytest.approx(sum(v for h, p, v in rows if h == g and p < o))


def test_rules(spark):
    names = spark.createDataFrame([("соль нут",), ("минута",), ("сок апельсин",)], "name string")
    rules = [Rule("нут", "beans", 1, kind="word"), Rule("минут", "time", 2), Rule("апель", "citrus", 1, kind="start")]
    got = {r.name: r.target for r in first_hit(hits(names, "name", rules), ["name"]).collect()}
    assert got == {"соль нут": "beans", "минута": "time", "сок апельсин": "citrus"}


def test_overlapping_misses_no_pair(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    sets = [(i, "b", sorted(rnd.sample(words, rnd.randrange(2, 6)) + ["common"])) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, blk string, tokens array<string>")
    got = {(r.a, r.b) for r in overlapping(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), ["blk"], "a", "b", 0.5).collect()}
    want = {(i, j) for i, _, s in sets for j, _, t in sets if len(set(s) & set(t)) >= 0.5 * len(s)}
    assert want <= got


RAW = "supplier_id bigint, row_no bigint, article string, name string, unit string, price string"


@pytest.mark.parametrize("paired,slice_rows", [(40, 2000), (3, 5)])
def test_covering_equals_brute_force(spark, monkeypatch, paired, slice_rows):
    """Exactly the covered pairs, each once, with all columns; sets above ``MOST_PAIRED`` and keys above ``SLICE`` too."""
    monkeypatch.setattr(tokensets, "MOST_PAIRED", paired)
    monkeypatch.setattr(tokensets, "SLICE", slice_rows)
    rnd = random.Random(8)
    sets = lambda n: [(i, rnd.choice("xy") if i % 20 else None, [f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(9))] + ["hot"] * (i % 3 > 0), i * 2) for i in range(n)]
    a, b = [(*r, rnd.choice([0.2, 0.5, 0.7, 1.0])) for r in sets(60)], sets(70)
    left = spark.createDataFrame(a, "a_id int, blk string, a_tokens array<string>, kind int, share double")
    right = spark.createDataFrame(b, "b_id int, blk string, b_tokens array<string>, b_more int")
    got = sorted((r.a_id, r.b_id, r.kind, r.b_more) for r in tokensets.covering(left, right, ["blk"], F.col("share")).collect())
    held = lambda s, t, share: len(set(s) & set(t)) >= max(1, share * len(set(s)) - 1e-9)
    assert got == sorted((i, j, k, m) for i, u, s, k, share in a for j, v, t, m in b if u is not None and u == v and held(s, t, share))

def test_merge_snapshot(spark):
    first = spark.createDataFrame(
        [(1, 1, "10", "Соль", "кг", "20"), (1, 2, "", "Мука  пшен", "кг", "30"), (2, 1, "7", "Рис", "кг", "50")], RAW
    )
    empty = spark.createDataFrame([], "unique_key string, supplier_id bigint, article string, name_raw string, unit_type string, price double, price_list_id string, active boolean")
    table = merge_snapshot(empty, last_per_key(clean_batch(first, F.lit("a")).filter("refused IS NULL")))
    second = spark.createDataFrame(
        [(1, 1, "10.0", "Соль", "кг", "22,5"), (1, 2, "10", "Соль", "кг", "23,5"), (1, 3, "11", "", "кг", "9"), (1, 4, "12", "Чай", "шт", "0")], RAW
    )
    rows = clean_batch(second, F.lit("b"))
    merged = merge_snapshot(table.drop("change"), last_per_key(rows.filter("refused IS NULL")))
    got = {r.unique_key: (r.price, r.active, r.change) for r in merged.collect()}
    assert got == {"1:10": (23.5, True, "updated"), "1:мука пшен:WEIGHT": (30.0, False, "deactivated"), "2:7": (50.0, True, "kept")}
    stats = {r.supplier_id: r for r in import_stats(rows, merged).collect()}
    assert (stats[1].n_rows, stats[1].n_empty_name, stats[1].n_bad_price, stats[1].n_updated) == (4, 1, 1, 1)


def test_read_feed(spark, tmp_path):
    plain, russian = tmp_path / "a.csv", tmp_path / "b.csv"
    plain.write_text("productName,article,price,unit\nSalt,10,20.5,kg\nTea,,7,pcs\n", encoding="utf-8")
    russian.write_bytes("Прайс;;;\nКод товара;Наименование;Ед. изм.;Цена\n5;Соль;кг;12,5\n".encode("cp1251"))
    a = feeds.read_feed(spark, feeds.Feed("1", str(plain))).collect()
    assert [(r.name, r.article, r.price, r.unit) for r in a] == [("Salt", "10", "20.5", "kg"), ("Tea", None, "7", "pcs")]
    b = feeds.read_feed(spark, feeds.Feed("2", str(russian), sep=";", encoding="windows-1251")).collect()
    assert [(r.name, r.article, r.price, r.unit) for r in b] == [("Соль", "5", "12,5", "кг")]
    raw = spark.read.option("header", True).csv(str(plain))
    scores = {r.column: r.name_score for r in feeds.profile_columns(raw).collect()}
    assert max(scores, key=scores.get) == "productName" and scores["price"] == 0.0


def test_intake_checks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    sums = feeds.file_checksums(spark, str(tmp_path)).withColumn("supplier_id", F.lit("s")).withColumn("column_names", F.array(F.lit("a"), F.lit("a")))
    raw = sums.select("file")
    fresh = spark.createDataFrame([], "supplier_id string, checksum string")
    assert feeds.intake_checks(raw, sums, fresh).first()["refused"] == "DUPLICATE_COLUMN"
    assert feeds.intake_checks(raw, sums, sums.select("supplier_id", "checksum")).first()["refused"] == "ALREADY_LOADED"


def test_streams_over_several_batches(spark):
    base = fresh_dir(spark, "test-stream")
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", i % 3, ["view", "purchase"][i % 2], float(i), "") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.to_timestamp("t")).select(*[f.name for f in jobs.EVENTS])
    df.repartition(4, "event_id").write.parquet(f"{base}/in")
    events = jobs.events_stream(spark, f"{base}/in", 1)
    jobs.latest_prices(spark, events, f"{base}/latest", f"{base}/log1").awaitTermination()
    got = {(r.user_id, r.event_type): r.event_id for r in jobs.read_latest(spark, f"{base}/latest").collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        want[(r[2], r[3])] = r[0]
    assert got == want
    counts = jobs.rolling_counts(jobs.events_stream(spark, f"{base}/in", 1))
    jobs.write_batches(counts, f"{base}/counts", f"{base}/log2", "update").awaitTermination()
    out = jobs.newest_of_batches(spark, f"{base}/counts", ["window_start", "event_type"], counts.schema)
    assert out.agg(F.sum("n")).first()[0] <= 60 and out.count() == 2


def test_stream_import_by_files(spark):
    base = fresh_dir(spark, "test-import")
    first = "unique_key string, supplier_id bigint, article string, name_raw string, unit_type string, price double, price_list_id string, active boolean, list_no int, row_no int"
    store = OfferStore(f"{base}/store", buckets=2)
    store.create(spark.createDataFrame([], first))
    listed = lambda rows: spark.createDataFrame(rows, RAW).withColumns({"price_list_id": F.lit("v"), "list_no": F.lit(2)})
    one = listed([(1, 1, "10", "Соль", "кг", "20")])
    one.coalesce(1).write.parquet(f"{base}/in")
    listed([(2, 1, "7", "Рис", "кг", "50")]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    raw = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.import_stream(raw, store, f"{base}/log").awaitTermination()
    got = {(r.unique_key, r.price, r.active) for r in store.read(spark).collect()}
    assert got == {("1:10", 20.0, True), ("2:7", 50.0, True)}


def test_fingerprint_of_large_carts(spark):
    from offerloom.plans.cart import fingerprint

    rows = [(c, 100 + i, float(i % 5), i % 4 == 0) for c in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "cart_id bigint, anchor_offer_id bigint, qty double, locked boolean")
    plain = {r.cart_id: (r.cart_hash, r.n_lines) for r in fingerprint(df).collect()}
    mixed = {r.cart_id: (r.cart_hash, r.n_lines) for r in fingerprint(df.orderBy(F.rand(3))).collect()}
    other = {r.cart_id: r.cart_hash for r in fingerprint(df.where("anchor_offer_id < 139")).collect()}
    assert plain == mixed and plain[1] == plain[2] and plain[1][1] == 40 and other[1] != plain[1][0]


def _broadcast_generates(frame):
    """Whether the plan broadcasts rows that an explode makes."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda other: depth(other) > depth(line), plan[k + 1 :])
            if any("Generate explode" in other for other in below):
                return True
    return False


def test_texts_cut_up_are_not_broadcast(spark, tmp_path):
    """Their size is estimated by the files of the texts, which is far too low, so the driver would collect all of them."""
    path = str(tmp_path / "names")
    spark.createDataFrame([("Red ring, red rings",), ("blue bolt",), (None,), ("r",)], "name string").write.parquet(path)
    names = spark.read.parquet(path)
    listed = [Rule("red", "warm"), Rule("ring", "part", kind="word"), Rule("bl", "cold", kind="start")]
    found = hits(names, "name", listed)
    assert not _broadcast_generates(found)
    # Words that a text holds several times count once.
    assert sorted((r.name, r.target) for r in found.collect()) == [("Red ring, red rings", "warm"), ("blue bolt", "cold")]
    words = search.name_index(names.where("name is not null"), search.name_words(F.col("name")))
    asked = spark.createDataFrame([("q", ["red", "ring"])], "query_id string, tokens array<string>")
    assert not _broadcast_generates(search.match_all(asked, words))
    assert not _broadcast_generates(search.match_prefix(spark.createDataFrame([("q", "re")], "query_id string, prefix string"), words))
    aliases = names.select(F.col("name").alias("alias_norm"), F.col("name").alias("brand_id"))
    assert not _broadcast_generates(classify.detect_brand(names, aliases))
