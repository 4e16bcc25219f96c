"""Table maintenance, favourites, links and small order views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.text import query_words
from offerloom.operators.cells import top_k
from offerloom.operators.rules import Rule, hits
from offerloom.plans import derive as d
from offerloom.plans.catalog import CORE_KEY, sellable
from offerloom.plans.classify import CLASS_RULES, NEGATIVE_RULES, classify_by_rules, detect_brand, _aliases
from offerloom.plans.report import damaged, publishable, share

SELF_CHECK_RULES = [
    Rule("sauce", "food_in_packaging", scope="packaging"),
    Rule("vanilla", "food_in_packaging", scope="packaging"),
    Rule("steak", "meat_in_seafood", scope="seafood"),
    Rule("headless", "seafood_in_meat", scope="meat"),
    Rule("16/20", "seafood_in_meat", scope="meat"),
]
RECLASSIFY_CONFIDENCE = 0.8
TYPOS = {"widgit": "widget", "anvill": "anvil", "gizzmo": "gizmo"}


# --- favourites and carts

def q_valid_favorites(spark: SparkSession, sf: str) -> DataFrame:
    """Favourites whose core and unit some publishable offer of a supplier that is not paused still has."""
    o = damaged(d.offers(spark, sf))
    paused = d.table(spark, sf, "supplier").filter("s_suppkey % 25 <> 4").select(F.col("s_suppkey").alias("supplier_id"))
    live = o.filter(publishable(o)).join(paused, "supplier_id", "left_anti").select(*CORE_KEY).distinct()
    return d.offers(spark, sf).join(live, CORE_KEY, "left_semi").select(F.col("offer_id").alias("ref_id"), *CORE_KEY)


def q_invalid_cart(spark: SparkSession, sf: str) -> DataFrame:
    """Cart lines whose anchor offer cannot be published any more, per cart."""
    o = damaged(d.offers(spark, sf))
    good = o.filter(publishable(o)).select(F.col("offer_id").alias("anchor_offer_id"))
    bad = d.intents(spark, sf).join(good, "anchor_offer_id", "left_anti")
    return bad.groupBy("cart_id").agg(F.count("*").alias("n_invalid"), F.min("anchor_offer_id").alias("first_invalid"))


def q_favorites_view(spark: SparkSession, sf: str) -> DataFrame:
    """Favourites with their current offer; gone or inactive offers are marked."""
    favs = d.intents(spark, sf).groupBy("cart_id", "anchor_offer_id").agg(F.count("*").alias("n_times"))
    live = sellable(d.offers(spark, sf)).select(F.col("offer_id").alias("anchor_offer_id"), "name_raw", "price")
    return favs.join(live, "anchor_offer_id", "left").select(
        "cart_id", "anchor_offer_id", "n_times", "name_raw", "price", F.col("price").isNull().alias("inactive")
    )


def repair(stale: DataFrame, offers: DataFrame) -> DataFrame:
    """Replacement of a stale favourite: same brand, else shared words among the ten cheapest, else the cheapest."""
    live = sellable(offers)
    brand = live.filter("brand_id IS NOT NULL").groupBy("product_core_id", "brand_id").agg(F.min(F.struct("price", "offer_id")).alias("b"))
    ten = top_k(live.select("product_core_id", "name_raw", "price", "offer_id"), ["product_core_id"], [F.col("price"), F.col("offer_id")], 10)
    ten = ten.select("product_core_id", "rank", F.struct("price", "offer_id").alias("t"), query_words(F.col("name_raw")).alias("words"))
    keys = F.slice(F.filter(query_words(F.col("name_raw")), lambda w: F.length(w) > 3), 1, 3)
    shared = F.size(F.array_intersect(F.col("keys"), F.col("words"))) >= 2
    names = stale.select("product_core_id", "name_raw").distinct().withColumn("keys", keys)
    by_words = names.join(ten, "product_core_id").groupBy("product_core_id", "name_raw").agg(
        F.min(F.when(shared, F.struct("rank", "t"))).alias("w"), F.min(F.struct("rank", "t")).alias("c")
    )
    out = stale.join(brand, ["product_core_id", "brand_id"], "left").join(by_words, ["product_core_id", "name_raw"], "left")
    dotted = F.col("product_core_id").contains(".")
    tier = F.when(F.col("b").isNotNull(), 1).when(F.col("w").isNotNull(), 2).when(dotted & F.col("c").isNotNull(), 3)
    best = F.when(tier == 1, F.col("b")).when(tier == 2, F.col("w.t")).when(tier == 3, F.col("c.t"))
    return out.select("ref_id", tier.alias("tier"), best["offer_id"].alias("new_offer_id"), best["price"].alias("new_price"))


def q_repair(spark: SparkSession, sf: str) -> DataFrame:
    o = d.offers(spark, sf)
    return repair(o.filter("NOT active").withColumnRenamed("offer_id", "ref_id"), o)


def q_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Cart requests resolved by offer id, else by key, else by the favourite's anchor, else by the cheapest of the core."""
    o = d.offers(spark, sf)
    asked = d.intents(spark, sf).withColumn("how", F.col("l_orderkey") % 3)
    asked = asked.join(o.select(F.col("offer_id").alias("anchor_offer_id"), *CORE_KEY, "active"), "anchor_offer_id")
    cheapest = sellable(o).groupBy(*CORE_KEY).agg(F.min(F.struct("price", "offer_id")).alias("b"))
    keyed = sellable(o).select(
        F.concat_ws(":", F.col("supplier_id").cast("string"), F.col("l_partkey").cast("string")).alias("unique_key"), F.col("offer_id").alias("keyed_id")
    )
    asked = asked.withColumns(
        {
            "unique_key": F.when(F.col("how") == 1, F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))),
            "direct": F.when((F.col("how") == 0) & F.col("active"), F.col("anchor_offer_id")),
            "anchor": F.when((F.col("how") == 2) & F.col("active"), F.col("anchor_offer_id")),
        }
    )
    with_key = asked.filter("unique_key IS NOT NULL").join(keyed, "unique_key", "left")
    every = asked.filter("unique_key IS NULL").withColumn("keyed_id", F.lit(None).cast("bigint")).unionByName(with_key)
    every = every.join(cheapest, CORE_KEY, "left")
    source = F.when(F.col("direct").isNotNull(), "offer").when(F.col("keyed_id").isNotNull(), "key").when(F.col("anchor").isNotNull(), "anchor").when(
        F.col("b").isNotNull(), "cheapest"
    )
    chosen = every.withColumns({"source": source, "offer_id": F.coalesce("direct", "keyed_id", "anchor", F.col("b.offer_id"))})
    return chosen.groupBy("cart_id", "offer_id").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"), F.min("source").alias("source"))


def q_reference_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Reference card of every favourite: the cheapest live offer of its core, unit and pack."""
    o = d.offers(spark, sf)
    key = [*CORE_KEY, "pack_value"]
    best = sellable(o).groupBy(*key).agg(F.min(F.struct("price", "offer_id")).alias("b"), F.count("*").alias("n_same"))
    return o.join(best, key, "left").select(
        F.col("offer_id").alias("ref_id"), F.col("b.offer_id").alias("anchor_id"), F.col("b.price").alias("anchor_price"), F.coalesce("n_same", F.lit(0)).alias("n_same")
    )


def q_seed_favorites(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty repeatable random cards that no favourite uses yet."""
    o = d.offers(spark, sf)
    used = o.filter("supplier_id % 10 = 3").select("l_partkey").distinct()
    cards = sellable(o).select("l_partkey", "name_raw").distinct().join(used, "l_partkey", "left_anti")
    return cards.orderBy(F.md5(F.concat(F.col("l_partkey").cast("string"), F.lit("|42"))), "l_partkey").limit(20)


def q_reorder(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of favourites after some of them were moved to new places."""
    favs = d.intents(spark, sf).select("cart_id", "l_partkey").distinct().withColumn("position", F.col("l_partkey"))
    moved = favs.filter("l_partkey % 10 = 0").select("cart_id", "l_partkey", (-F.col("l_partkey")).alias("new_position"))
    return favs.join(moved, ["cart_id", "l_partkey"], "left").select("cart_id", "l_partkey", F.coalesce("new_position", "position").alias("position"))


# --- links, companies, documents

def q_contract_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier with its accepted and pending links to customers."""
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    links = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey", "o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("accepted"))
    n = links.groupBy("l_suppkey").agg(F.sum("accepted").alias("n_accepted"), F.sum(1 - F.col("accepted")).alias("n_pending"))
    s = d.companies(spark, sf)
    status = F.when(F.col("n_accepted") > F.col("n_pending"), "mostly_accepted").when(F.col("n_accepted") + F.col("n_pending") > 0, "mostly_pending").otherwise("none")
    return s.join(n, s.supplier_id == n.l_suppkey, "left").select(
        "supplier_id", "supplier_name", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), F.coalesce("n_pending", F.lit(0)).alias("n_pending"),
        F.coalesce(status, F.lit("none")).alias("status"),
    )


def link_new(suppliers: list[int], customers: DataFrame, links: DataFrame) -> DataFrame:
    """Pending links of newly registered suppliers to all customers they are not linked with."""
    rows = customers.withColumn("supplier_id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in suppliers])))
    return rows.join(links, ["supplier_id", "customer_id"], "left_anti").withColumn("contract_accepted", F.lit(False))


def q_link_new(spark: SparkSession, sf: str) -> DataFrame:
    li = d.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier_id"))
    o = d.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    links = li.join(o, li.l_orderkey == o.o_orderkey).select("supplier_id", "customer_id").distinct()
    return link_new([3, 7], d.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")), links)


def q_latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Newest document per source and language, with the supplier the source stands for."""
    docs = d.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    last = docs.groupBy("source", "lang").agg(F.max_by(F.struct("doc_id", "n_chars"), "doc_id").alias("m"), F.count("*").alias("n_versions"))
    last = last.withColumn("supplier_id", F.regexp_extract("source", r"(\d+)$", 1).cast("bigint"))
    return last.join(d.companies(spark, sf), "supplier_id", "left").select(
        "source", "lang", F.col("m.doc_id").alias("doc_id"), F.col("m.n_chars").alias("n_chars"), "n_versions",
        F.coalesce("supplier_name", F.lit("Unknown")).alias("supplier_name"),
    )


def q_requisites(spark: SparkSession, sf: str) -> DataFrame:
    """Customer fields a supplier may see: all of them with an accepted link, else name and segment."""
    o = d.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("accepted"))
    c = d.table(spark, sf, "customer")
    full = F.coalesce(F.col("accepted") == 1, F.lit(False))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        "c_custkey", "c_name", "c_mktsegment", F.when(full, F.col("c_acctbal")).alias("c_acctbal"), F.when(full, F.col("c_nationkey")).alias("c_nationkey"), full.alias("full_view")
    )


def q_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses kept as text become records with the text, an empty phone and a default mark on the first."""
    old = F.array(F.concat_ws(" ", F.lit("Street"), F.col("c_custkey")), F.concat_ws(" ", F.lit("Dock"), F.col("c_nationkey")))
    new = F.transform(old, lambda a, i: F.struct(a.alias("address"), F.lit("").alias("phone"), (i == 0).alias("is_default")))
    return d.table(spark, sf, "customer").select("c_custkey", F.explode(new).alias("a")).select("c_custkey", "a.*")


def q_supplier_search(spark: SparkSession, sf: str) -> DataFrame:
    """Offers of unpaused suppliers whose name holds the search text, after the typo map; counts per supplier."""
    o = sellable(d.offers(spark, sf)).filter("supplier_id % 25 <> 4")
    wanted = [TYPOS.get(q, q) for q in ("widgit", "anvil")]
    hit = F.array_compact(F.array(*[F.when(F.lower("name_raw").contains(w), F.lit(w)) for w in wanted]))
    return o.select("supplier_id", "price", F.explode(hit).alias("word")).groupBy("supplier_id", "word").agg(F.count("*").alias("n"), F.min("price").alias("min_price"))


def q_supplier_offers(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's own active offers under display names."""
    return d.offers(spark, sf).filter("active").select(
        "supplier_id", F.col("offer_id").alias("id"), F.col("name_raw").alias("product_name"), "price", F.coalesce("brand_id", F.lit("")).alias("brand"),
        F.when(F.col("unit_type") == "WEIGHT", "кг").when(F.col("unit_type") == "VOLUME", "л").otherwise("шт").alias("unit"),
    )


def q_orders_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of pending orders, newest first."""
    o = d.table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    page = o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(50)
    return page.join(c, "o_custkey", "left").select("o_orderkey", "o_orderdate", "o_totalprice", F.coalesce("c_name", F.lit("Unknown")).alias("customer"))


# --- corrections

def q_reclassify(spark: SparkSession, sf: str) -> DataFrame:
    """Change log: meat names that a sure rule puts into seafood."""
    names = d.items(spark, sf).filter("super_class = 'meat'").select(F.col("name_raw").alias("name")).distinct()
    new = classify_by_rules(names, CLASS_RULES, NEGATIVE_RULES)
    moved = new.filter((F.col("rule_class") == "seafood") & (F.col("rule_confidence") >= RECLASSIFY_CONFIDENCE))
    it = d.items(spark, sf).filter("super_class = 'meat'")
    return it.join(moved, it.name_raw == moved.name).select("p_partkey", F.col("super_class").alias("old_class"), F.col("rule_class").alias("new_class"), "matched")


def q_self_check(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a word that does not belong into their class: counts and the first sample."""
    names = d.items(spark, sf).select(F.col("name_raw").alias("name"), "super_class", "p_partkey")
    found = hits(names, "name", SELF_CHECK_RULES).filter(F.col("scope") == F.col("super_class")).select("target", "name", "p_partkey").distinct()
    return found.groupBy(F.col("target").alias("check")).agg(F.count("*").alias("n"), F.min("name").alias("sample"))


def q_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Brand coverage per class before and after filling gaps from the names."""
    it = d.items(spark, sf)
    found = detect_brand(it.select(F.col("name_raw").alias("name")).distinct(), _aliases(spark, sf)).select(F.col("name").alias("name_raw"), "brand")
    filled = it.join(found, "name_raw", "left").withColumn("new_brand", F.coalesce("brand_id", "brand"))
    n = F.count("*")
    return filled.groupBy("super_class").agg(
        n.alias("n"), share(F.count("brand_id"), n).alias("before_pct"), share(F.count("new_brand"), n).alias("after_pct"),
        F.sum(F.when(F.col("brand_id").isNull() & F.col("new_brand").isNotNull(), 1).otherwise(0)).alias("n_filled"),
    )


def q_deactivate_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Active offers that fail validation, by supplier, with what stays active."""
    o = damaged(d.offers(spark, sf)).filter("active")
    ok = publishable(o)
    return o.groupBy("supplier_id").agg(
        F.sum(F.when(~ok, 1).otherwise(0)).alias("n_deactivated"), F.sum(F.when(ok, 1).otherwise(0)).alias("n_still_active")
    )


def q_fill_core(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cores replaced by the class, with counts before and after."""
    it = d.items(spark, sf).withColumn("core", F.when(F.col("p_partkey") % 9 != 4, F.col("product_core_id")))
    new = F.coalesce("core", "super_class")
    return it.groupBy("super_class").agg(
        F.count("*").alias("n"), F.count("core").alias("n_before"), F.count(new).alias("n_after"),
        F.sum(F.when(new.contains("."), 1).otherwise(0)).alias("n_dotted"), F.countDistinct(new).alias("n_cores"),
    )


def q_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Import batches per supplier: size and first time; the newest stays, the others are to be deactivated."""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    li = d.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    b = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey", F.date_trunc("year", "o_orderdate").alias("batch")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").alias("first_at")
    )
    newest = b.groupBy("l_suppkey").agg(F.max("batch").alias("newest"))
    return b.join(newest, "l_suppkey").select("l_suppkey", F.year("batch").alias("batch_year"), "n", "first_at", (F.col("batch") == F.col("newest")).alias("keep"))


# --- position orders

def q_position_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered positions at the cheapest offer of the same name and unit, raised to its minimum quantity."""
    o = d.offers(spark, sf)
    best = sellable(o).groupBy(F.lower("name_raw").alias("key"), F.lower("unit_type").alias("unit")).agg(
        F.min(F.struct("price", "offer_id", "min_order_qty", "supplier_id")).alias("b")
    )
    names = d.items(spark, sf).select("p_partkey", F.lower("name_raw").alias("key"), F.lower("unit_type").alias("unit"))
    pos = d.intents(spark, sf)
    out = pos.join(names, pos.l_partkey == names.p_partkey).join(best, ["key", "unit"], "left")
    raised = F.greatest(F.col("qty"), F.col("b.min_order_qty").cast("double"))
    return out.groupBy("cart_id").agg(
        F.count("*").alias("n_positions"), F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).alias("n_errors"),
        F.sum(F.when(F.col("qty") < F.col("b.min_order_qty"), 1).otherwise(0)).alias("n_warnings"),
        F.round(F.sum(raised * F.col("b.price")), 2).alias("total"), F.countDistinct("b.supplier_id").alias("n_orders"),
    ).withColumn("confirmed", F.col("n_errors") == 0)


def q_batch_order(spark: SparkSession, sf: str) -> DataFrame:
    """All favourites of a cart ordered at the cheapest offer of their core and unit: totals and savings per supplier."""
    from offerloom.plans.catalog import baseline

    o = d.offers(spark, sf)
    best = sellable(o).groupBy(*CORE_KEY).agg(F.min(F.struct("price", "offer_id", "supplier_id")).alias("b"))
    it = d.items(spark, sf).select("p_partkey", *CORE_KEY)
    lines = d.intents(spark, sf)
    lines = lines.join(it, lines.l_partkey == it.p_partkey).join(best, CORE_KEY).join(baseline(o).select(*CORE_KEY, "baseline_price"), CORE_KEY, "left")
    paid = F.col("qty") * F.col("b.price")
    return lines.groupBy("cart_id", F.col("b.supplier_id").alias("supplier_id")).agg(
        F.count("*").alias("n_lines"), F.round(F.sum(paid), 2).alias("total"), F.round(F.sum(F.col("qty") * F.col("baseline_price") - paid), 3).alias("savings")
    )


QUERIES = {
    "semi_valid_favorites": q_valid_favorites,
    "anti_invalid_cart": q_invalid_cart,
    "favorites_view": q_favorites_view,
    "favorites_repair": q_repair,
    "intent_intake": q_intake,
    "reference_anchor": q_reference_anchor,
    "seed_favorites": q_seed_favorites,
    "reorder_favorites": q_reorder,
    "contract_status": q_contract_status,
    "link_new_suppliers": q_link_new,
    "latest_documents": q_latest_documents,
    "requisites_view": q_requisites,
    "address_migration": q_addresses,
    "supplier_search": q_supplier_search,
    "supplier_offers": q_supplier_offers,
    "orders_page": q_orders_page,
    "reclassify": q_reclassify,
    "class_selfcheck": q_self_check,
    "backfill_brand": q_backfill,
    "deactivate_invalid": q_deactivate_invalid,
    "fill_core": q_fill_core,
    "active_batches": q_batches,
    "position_orders": q_position_orders,
    "batch_order": q_batch_order,
}

from offerloom.plans.classify import _RULED  # noqa: E402
from offerloom.plans.report import _DAMAGED  # noqa: E402
from offerloom.plans.search import _duck_words  # noqa: E402

_PUB = "active AND price > 0 AND unit_type IS NOT NULL AND (unit_type = 'PIECE' OR pack_value > 0)"
_O = f"WITH {d.CTE_OFFERS}"
_OI = f"WITH {d.CTE_OFFERS}, {d.CTE_INTENTS}"
_BASE = """ r AS (SELECT product_core_id, unit_type, price, row_number() OVER (PARTITION BY product_core_id, unit_type ORDER BY price, offer_id) AS rn FROM offers WHERE active)
 , p3 AS (SELECT product_core_id, unit_type, count(*) AS n, max(CASE WHEN rn = 1 THEN price END) AS p1, max(CASE WHEN rn = 2 THEN price END) AS p2,
     max(CASE WHEN rn = 3 THEN price END) AS p3 FROM r WHERE rn <= 3 GROUP BY 1, 2)
 , base AS (SELECT product_core_id, unit_type, CASE n WHEN 1 THEN p1 WHEN 2 THEN (p1 + p2) / 2 ELSE p1 * 0.5 + p3 * 0.5 END AS bp FROM p3)"""

ORACLE = {
    "semi_valid_favorites": _DAMAGED + f""" SELECT offer_id AS ref_id, product_core_id, unit_type FROM offers WHERE (product_core_id, unit_type) IN
        (SELECT o.product_core_id, v.unit_type FROM v JOIN offers o USING (offer_id) WHERE v.active AND v.price > 0 AND v.unit_type IS NOT NULL
           AND (v.unit_type = 'PIECE' OR v.pack_value > 0) AND v.supplier_id % 25 = 4)""",
    "anti_invalid_cart": _DAMAGED + f""", {d.CTE_INTENTS} SELECT cart_id, count(*) AS n_invalid, min(anchor_offer_id) AS first_invalid FROM intents
        WHERE anchor_offer_id NOT IN (SELECT offer_id FROM v WHERE {_PUB}) GROUP BY 1""",
    "favorites_view": _OI + """ , f AS (SELECT cart_id, anchor_offer_id, count(*) AS n_times FROM intents GROUP BY 1, 2)
      SELECT cart_id, anchor_offer_id, n_times, name_raw, price, price IS NULL AS inactive FROM f LEFT JOIN (SELECT * FROM offers WHERE active) ON offer_id = anchor_offer_id""",
    "favorites_repair": _O + f""" , live AS (SELECT *, row_number() OVER (PARTITION BY product_core_id ORDER BY price, offer_id) AS rk, {_duck_words('name_raw')} AS words FROM offers WHERE active)
      , br AS (SELECT product_core_id, brand_id, arg_min(offer_id, (price, offer_id)) AS bo, min(price) AS bp FROM live WHERE brand_id IS NOT NULL GROUP BY 1, 2)
      , s AS (SELECT *, list_slice(list_filter({_duck_words('name_raw')}, lambda w: len(w) > 3), 1, 3) AS keys FROM offers WHERE NOT active)
      , w AS (SELECT s.offer_id AS ref_id, min(rk) AS wr FROM s JOIN live l ON l.product_core_id = s.product_core_id AND rk <= 10 AND len(list_intersect(list_distinct(s.keys), list_distinct(l.words))) >= 2 GROUP BY 1)
      , j AS (SELECT s.offer_id AS ref_id, bo, bp, lw.offer_id AS wo, lw.price AS wp, lc.offer_id AS co, lc.price AS cp FROM s LEFT JOIN br USING (product_core_id, brand_id)
          LEFT JOIN w ON w.ref_id = s.offer_id LEFT JOIN live lw ON lw.product_core_id = s.product_core_id AND lw.rk = w.wr LEFT JOIN live lc ON lc.product_core_id = s.product_core_id AND lc.rk = 1)
      SELECT ref_id, CASE WHEN bo IS NOT NULL THEN 1 WHEN wo IS NOT NULL THEN 2 WHEN co IS NOT NULL THEN 3 END AS tier, coalesce(bo, wo, co) AS new_offer_id, coalesce(bp, wp, cp) AS new_price FROM j""",
    "intent_intake": _OI + """ , best AS (SELECT product_core_id, unit_type, arg_min(offer_id, (price, offer_id)) AS bo FROM offers WHERE active GROUP BY 1, 2)
      , x AS (SELECT i.*, o.active, bo, l_orderkey % 3 AS how FROM intents i JOIN offers o ON o.offer_id = i.anchor_offer_id LEFT JOIN best USING (product_core_id, unit_type))
      , y AS (SELECT *, CASE WHEN active THEN anchor_offer_id ELSE bo END AS offer_id,
          CASE WHEN NOT active THEN CASE WHEN bo IS NOT NULL THEN 'cheapest' END WHEN how = 0 THEN 'offer' WHEN how = 1 THEN 'key' ELSE 'anchor' END AS source FROM x)
      SELECT cart_id, offer_id, sum(qty) AS qty, count(*) AS n, min(source) AS source FROM y GROUP BY 1, 2""",
    "reference_anchor": _O + """ , b AS (SELECT product_core_id, unit_type, pack_value, arg_min(offer_id, (price, offer_id)) AS anchor_id, min(price) AS anchor_price, count(*) AS n_same
          FROM offers WHERE active GROUP BY 1, 2, 3)
      SELECT offer_id AS ref_id, anchor_id, anchor_price, coalesce(n_same, 0) AS n_same FROM offers LEFT JOIN b USING (product_core_id, unit_type, pack_value)""",
    "seed_favorites": _O + """ SELECT DISTINCT l_partkey, name_raw FROM (SELECT DISTINCT l_partkey, name_raw, md5(CAST(l_partkey AS VARCHAR) || '|42') AS h FROM offers WHERE active AND l_partkey NOT IN
        (SELECT l_partkey FROM offers WHERE supplier_id % 10 = 3) ORDER BY h, l_partkey LIMIT 20)""",
    "reorder_favorites": _OI + " SELECT DISTINCT cart_id, l_partkey, CASE WHEN l_partkey % 10 = 0 THEN -l_partkey ELSE l_partkey END AS position FROM intents",
    "contract_status": """WITH l AS (SELECT l_suppkey, o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
      , n AS (SELECT l_suppkey, CAST(sum(a) AS BIGINT) AS na, CAST(sum(1 - a) AS BIGINT) AS np FROM l GROUP BY 1)
      SELECT s_suppkey AS supplier_id, s_name AS supplier_name, coalesce(na, 0) AS n_accepted, coalesce(np, 0) AS n_pending,
        CASE WHEN na > np THEN 'mostly_accepted' WHEN na + np > 0 THEN 'mostly_pending' ELSE 'none' END AS status FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey""",
    "link_new_suppliers": """SELECT c_custkey AS customer_id, CAST(s AS BIGINT) AS supplier_id, false AS contract_accepted FROM customer, (VALUES (3), (7)) AS v(s)
      WHERE (s, c_custkey) NOT IN (SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "latest_documents": """WITH m AS (SELECT source, lang, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars, count(*) AS n_versions FROM documents GROUP BY 1, 2)
      SELECT m.*, coalesce(s_name, 'Unknown') AS supplier_name FROM m LEFT JOIN supplier ON s_suppkey = CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT)""",
    "requisites_view": """WITH a AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ok FROM orders GROUP BY 1)
      SELECT c_custkey, c_name, c_mktsegment, CASE WHEN ok = 1 THEN c_acctbal END AS c_acctbal, CASE WHEN ok = 1 THEN c_nationkey END AS c_nationkey, coalesce(ok = 1, false) AS full_view
      FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
    "address_migration": """SELECT c_custkey, 'Street ' || CAST(c_custkey AS VARCHAR) AS address, '' AS phone, true AS is_default FROM customer
      UNION ALL SELECT c_custkey, 'Dock ' || CAST(c_nationkey AS VARCHAR), '', false FROM customer""",
    "supplier_search": _O + """ SELECT supplier_id, word, count(*) AS n, min(price) AS min_price FROM offers JOIN (VALUES ('widget'), ('anvil')) AS w(word) ON contains(lower(name_raw), word)
      WHERE active AND supplier_id % 25 <> 4 GROUP BY 1, 2""",
    "supplier_offers": _O + """ SELECT supplier_id, offer_id AS id, name_raw AS product_name, price, coalesce(brand_id, '') AS brand,
      CASE unit_type WHEN 'WEIGHT' THEN 'кг' WHEN 'VOLUME' THEN 'л' ELSE 'шт' END AS unit FROM offers WHERE active""",
    "orders_page": """SELECT o_orderkey, o_orderdate, o_totalprice, coalesce(c_name, 'Unknown') AS customer FROM
      (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50) LEFT JOIN customer ON c_custkey = o_custkey""",
    "reclassify": f"WITH {d.CTE_ITEMS}, {_RULED} SELECT p_partkey, super_class AS old_class, rule_class AS new_class, matched FROM items JOIN ruled ON name = name_raw "
    "WHERE super_class = 'meat' AND rule_class = 'seafood' AND rule_confidence >= 0.8",
    "class_selfcheck": f"""WITH {d.CTE_ITEMS}, t AS (SELECT *, CASE WHEN super_class = 'packaging' AND (contains(name_raw, 'sauce') OR contains(name_raw, 'vanilla')) THEN 'food_in_packaging'
        WHEN super_class = 'seafood' AND contains(name_raw, 'steak') THEN 'meat_in_seafood'
        WHEN super_class = 'meat' AND (contains(name_raw, 'headless') OR contains(name_raw, '16/20')) THEN 'seafood_in_meat' END AS chk FROM items)
      SELECT chk AS check, count(*) AS n, min(name_raw) AS sample FROM t WHERE chk IS NOT NULL GROUP BY 1""",
    "backfill_brand": f"""WITH {d.CTE_ITEMS} SELECT super_class, count(*) AS n, round(100.0 * count(brand_id) / count(*), 1) AS before_pct, 100.0::DOUBLE AS after_pct,
      count(*) FILTER (WHERE brand_id IS NULL) AS n_filled FROM items GROUP BY 1""",
    "deactivate_invalid": _DAMAGED + f""" SELECT supplier_id, count(*) FILTER (WHERE NOT coalesce({_PUB}, false)) AS n_deactivated,
      count(*) FILTER (WHERE {_PUB}) AS n_still_active FROM v WHERE active GROUP BY 1""",
    "fill_core": f"""WITH {d.CTE_ITEMS}, t AS (SELECT *, CASE WHEN p_partkey % 9 <> 4 THEN product_core_id END AS core FROM items)
      SELECT super_class, count(*) AS n, count(core) AS n_before, count(coalesce(core, super_class)) AS n_after, count(*) FILTER (WHERE contains(coalesce(core, super_class), '.')) AS n_dotted,
        count(DISTINCT coalesce(core, super_class)) AS n_cores FROM t GROUP BY 1""",
    "active_batches": """WITH b AS (SELECT l_suppkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderdate) AS first_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
      SELECT l_suppkey, CAST(y AS INT) AS batch_year, n, first_at, y = max(y) OVER (PARTITION BY l_suppkey) AS keep FROM b""",
    "position_orders": _OI + """ , b AS (SELECT lower(name_raw) AS k, unit_type, min((price, offer_id, min_order_qty, supplier_id)) AS b FROM offers WHERE active GROUP BY 1, 2)
      , l AS (SELECT i.cart_id, i.qty, b FROM intents i JOIN items ON p_partkey = i.l_partkey LEFT JOIN b ON k = lower(name_raw) AND b.unit_type = items.unit_type)
      SELECT cart_id, count(*) AS n_positions, count(*) FILTER (WHERE b IS NULL) AS n_errors, count(*) FILTER (WHERE qty < b[3]) AS n_warnings,
        round(sum(greatest(qty, b[3]) * b[1]), 2) AS total, count(DISTINCT b[4]) AS n_orders, count(*) FILTER (WHERE b IS NULL) = 0 AS confirmed FROM l GROUP BY 1""",
    "batch_order": _OI + f""" , {_BASE}
      , b AS (SELECT product_core_id, unit_type, min((price, offer_id, supplier_id)) AS b FROM offers WHERE active GROUP BY 1, 2)
      SELECT cart_id, b[3] AS supplier_id, count(*) AS n_lines, round(sum(qty * b[1]), 2) AS total, round(sum(qty * bp - qty * b[1]), 3) AS savings
      FROM intents JOIN items ON p_partkey = l_partkey JOIN b USING (product_core_id, unit_type) LEFT JOIN base USING (product_core_id, unit_type) GROUP BY 1, 2""",
}
