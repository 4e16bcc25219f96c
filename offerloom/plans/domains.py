"""Zero-trash matching of shrimp and fish fillet: strict gates, rejection counts, ranked alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.domain import DOMAIN_COLUMNS, domain_gates, with_domain
from offerloom.operators.cells import first_reason, key_of, top_k
from offerloom.plans import derive as d
from offerloom.plans.catalog import sellable
from offerloom.session import cut_lineage

LIMIT = 5
WEIGHT_GAP = 0.20
# Food names for the derived items: the noun gives the species, the tag the treatment. SQL that both engines read.
NOUNS = {
    "anvil": "Лосось", "bolt": "Треска", "gear": "Минтай", "gizmo": "Креветки ваннамей", "plate": "Креветки тигровые",
    "ring": "Форель", "rod": "Креветки", "widget": "Кальмар",
}
TREATMENTS = [
    "филе с/м", "филе охл", "филе без кожи", "филе на коже", "филе в панировке", "тушка", "стейк", "набор", "б/г с/м", "очищ с хвостом",
    "очищ без хвоста", "в/м", "бланш", "филе с/м кор", "филе", "с/г с/м",
]
_NOUN = "CASE split_part(p_name, ' ', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUNS.items()) + " END"
_TREAT = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TREATMENTS)) + " END"
_SIZE = "CASE CAST(floor(p_partkey / 16) AS BIGINT) % 3 WHEN 0 THEN ' 16/20' WHEN 1 THEN ' 21/25' ELSE '' END"
_WEIGHT = "CASE p_size % 4 WHEN 0 THEN ' ' || CAST(1 + p_size % 3 AS STRING) || ' кг' WHEN 1 THEN ' ' || CAST(300 + 100 * (p_size % 5) AS STRING) || ' г' WHEN 2 THEN ' 5 шт' ELSE '' END"
FOOD_NAME = f"{_NOUN} || ' ' || {_TREAT} || CASE WHEN contains({_NOUN}, 'Креветки') THEN {_SIZE} ELSE '' END || {_WEIGHT}"


def domain_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offers under food names with their domain signature. Names are read once per item and stored."""
    it = d.table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", f"{FOOD_NAME} AS name_raw", "CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE lower(p_brand) END AS brand_id")
    it = with_domain(it).withColumn("cell", key_of(*DOMAIN_COLUMNS))
    facts = d.offer_facts(spark, sf).select("l_partkey", "offer_id", "price", "active", F.lit("x").alias("unit_type"))
    return cut_lineage(facts.join(it, "l_partkey"), "domain-offers")


def gated(offers: DataFrame) -> DataFrame:
    """Cell pairs of the same domain and species with the first failing gate."""
    refs = offers.filter("domain IS NOT NULL").select("cell", *DOMAIN_COLUMNS).distinct()
    cands = sellable(offers).filter("domain IS NOT NULL AND NOT blacklisted").groupBy("cell", *DOMAIN_COLUMNS).agg(F.count("*").alias("n"))
    on = ["domain", "species"]
    left = refs.select(*on, *[F.col(c).alias(f"a_{c}") for c in ["cell", *DOMAIN_COLUMNS]])
    right = cands.select(*on, "n", *[F.col(c).alias(f"b_{c}") for c in ["cell", *DOMAIN_COLUMNS]])
    pairs = left.join(right, on)
    return pairs.withColumn("reason", first_reason(domain_gates(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))))


def rejections(offers: DataFrame) -> DataFrame:
    """Per reference: candidates stopped at each gate. Domain and species differences are counted, not paired.

    A reference outside both domains, or one that is blacklisted itself, gets one row with that reason and no candidates.
    """
    live = sellable(offers)
    total = live.filter("NOT blacklisted").groupBy("domain", "species").agg(F.count("*").alias("n"))
    in_domain = total.groupBy("domain").agg(F.sum("n").alias("n_domain"))
    species = total.filter("domain IS NOT NULL").select("domain", "species", F.col("n").alias("n_species"))
    keys = offers.filter("domain IS NOT NULL").select("cell", "domain", "species").distinct()
    n_black = live.agg(F.sum(F.col("blacklisted").cast("bigint")).alias("n")).scalar()
    n_all = live.agg(F.sum((~F.col("blacklisted")).cast("bigint")).alias("n")).scalar()
    keys = keys.join(in_domain, "domain", "left").join(species, ["domain", "species"], "left")
    keys = keys.withColumns({"n_black": n_black, "n_all": n_all})
    n_domain, n_species = F.coalesce("n_domain", F.lit(0)), F.coalesce("n_species", F.lit(0))
    coarse = F.array(
        F.struct(F.lit("FORBIDDEN_CLASS").alias("reason"), F.col("n_black").alias("n")),
        F.struct(F.concat(F.lit("NOT_"), F.col("domain")).alias("reason"), (F.col("n_all") - n_domain).alias("n")),
        F.struct(F.lit("SPECIES_MISMATCH").alias("reason"), (n_domain - n_species).alias("n")),
    )
    coarse = keys.select("cell", F.explode(coarse).alias("x")).select("cell", "x.reason", "x.n")
    fine = gated(offers).filter("reason IS NOT NULL").groupBy(F.col("a_cell").alias("cell"), "reason").agg(F.sum("n").alias("n"))
    per_cell = coarse.unionByName(fine).filter("n > 0")
    ids = offers.select(F.col("offer_id").alias("ref_id"), "cell", "domain", "blacklisted")
    matched = ids.filter("domain IS NOT NULL").join(per_cell, "cell").select("ref_id", "reason", "n")
    why = F.when(F.col("blacklisted"), "SOURCE_BLACKLISTED").otherwise("SOURCE_UNCLASSIFIED")
    return matched.unionByName(ids.filter("domain IS NULL").select("ref_id", why.alias("reason"), F.lit(0).cast("bigint").alias("n")))


def alternatives(offers: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Strict matches per reference: same brand first, then a weight within 20 %, then the price."""
    passed = gated(offers).filter("reason IS NULL").select("a_cell", "b_cell")
    rank_key = ["brand_id", "weight_kg"]
    refs = offers.filter("domain IS NOT NULL").select(F.col("cell").alias("a_cell"), *[F.col(c).alias(f"a_{c}") for c in rank_key]).distinct()
    refs = refs.withColumn("ref_cell", key_of("a_cell", "a_brand_id", "a_weight_kg"))
    cands = sellable(offers).select(F.col("cell").alias("b_cell"), *[F.col(c).alias(f"b_{c}") for c in rank_key], "offer_id", "price")
    best = top_k(cands, ["b_cell", "b_brand_id", "b_weight_kg"], [F.col("price"), F.col("offer_id")], limit + 1, "_r").drop("_r")
    same = F.coalesce(F.col("a_brand_id") == F.col("b_brand_id"), F.lit(False))
    gap = F.abs(F.col("a_weight_kg") - F.col("b_weight_kg")) / F.col("a_weight_kg")
    rows = refs.join(passed, "a_cell").join(best, "b_cell").withColumns({"same_brand": same, "weight_ok": F.coalesce(gap <= WEIGHT_GAP, F.lit(True))})
    rows = top_k(rows, ["ref_cell"], [F.desc("same_brand"), F.desc("weight_ok"), F.col("price"), F.col("offer_id")], limit + 1)
    lists = rows.groupBy("ref_cell").agg(F.array_sort(F.collect_list(F.struct("rank", "offer_id", "price", "same_brand", "weight_ok"))).alias("found"))
    ids = offers.withColumn("ref_cell", key_of("cell", "brand_id", "weight_kg")).select(F.col("offer_id").alias("ref_id"), "ref_cell", "domain")
    others = F.slice(F.filter("found", lambda x: x["offer_id"] != F.col("ref_id")), 1, limit)
    out = ids.join(lists, "ref_cell").select("ref_id", "domain", F.posexplode(others).alias("pos", "m"))
    return out.select("ref_id", "domain", (F.col("pos") + 1).alias("rank"), "m.offer_id", "m.price", "m.same_brand", "m.weight_ok")


def q_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return rejections(domain_offers(spark, sf))


def q_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return alternatives(domain_offers(spark, sf))


QUERIES = {"domain_rejections": q_rejections, "domain_alternatives": q_alternatives}

# The oracle states the signature for the words of the derived food names only.
_SIG = f"""WITH nm AS (SELECT p_partkey, lower({FOOD_NAME}) AS low, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE lower(p_brand) END AS brand FROM part)
 , s0 AS (SELECT *, contains(low, 'набор') AS black, contains(low, 'креветки') AS shr, CASE WHEN contains(low, 'лосось') THEN 'salmon' WHEN contains(low, 'треска') THEN 'cod'
     WHEN contains(low, 'минтай') THEN 'pollock' WHEN contains(low, 'форель') THEN 'trout' END AS fish, contains(low, 'филе') AS fil, contains(low, 'панир') AS bread,
     nullif(regexp_extract(low, '(\\d+/\\d+)', 1), '') AS cal, coalesce(TRY_CAST(regexp_extract(low, '(\\d+) кг', 1) AS DOUBLE), TRY_CAST(regexp_extract(low, '(\\d+) г(?:[^а-я]|$)', 1) AS DOUBLE) / 1000) AS w FROM nm)
 , s1 AS (SELECT *, CASE WHEN black THEN NULL WHEN fish IS NOT NULL AND fil THEN 'FISH_FILLET' WHEN shr THEN 'SHRIMP' END AS domain FROM s0)
 , sg AS (SELECT *, CASE domain WHEN 'SHRIMP' THEN CASE WHEN contains(low, 'ваннам') THEN 'vannamei' WHEN contains(low, 'тигр') THEN 'tiger' ELSE 'unspecified' END ELSE fish END AS species,
     CASE domain WHEN 'SHRIMP' THEN CASE WHEN contains(low, 'в/м') THEN 'c' WHEN contains(low, 'бланш') THEN 'b' ELSE 'r' END ELSE CASE WHEN contains(low, 'с/м') THEN 'f' WHEN contains(low, 'охл') THEN 'ch' END END AS state,
     CASE WHEN contains(low, 'очищ') THEN 'p' ELSE 's' END || CASE WHEN contains(low, 'с/г') THEN 'on' ELSE 'off' END AS form,
     CASE WHEN contains(low, 'без хвост') THEN 'off' WHEN contains(low, 'с хвост') THEN 'on' END AS tail,
     CASE WHEN contains(low, 'без кож') THEN 'off' WHEN contains(low, 'на кож') THEN 'on' END AS skin,
     CASE WHEN contains(low, ' шт') THEN 'pcs' WHEN w IS NOT NULL THEN 'kg' END AS uom, contains(low, ' кор') AS box FROM s1)
 , facts AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS unit_price FROM lineitem GROUP BY 1, 2)
 , o AS (SELECT l_partkey, {", ".join(f"{v} AS {k}" for k, v in d.OFFER_COLUMNS.items() if k in ("offer_id", "price", "active"))} FROM facts)
 , pr AS (SELECT a.p_partkey AS ap, b.p_partkey AS bp, coalesce(a.brand = b.brand, false) AS sb, coalesce(abs(a.w - b.w) / a.w <= 0.2, true) AS wok, a.domain,
     CASE WHEN b.black THEN 'FORBIDDEN_CLASS' WHEN a.domain IS DISTINCT FROM b.domain THEN 'NOT_' || a.domain WHEN a.species <> b.species THEN 'SPECIES_MISMATCH'
       WHEN a.domain = 'SHRIMP' AND a.state <> b.state THEN 'SHRIMP_STATE_MISMATCH' WHEN a.domain = 'SHRIMP' AND a.form <> b.form THEN 'SHRIMP_FORM_MISMATCH'
       WHEN a.domain = 'SHRIMP' AND a.tail <> b.tail THEN 'TAIL_STATE_MISMATCH' WHEN a.domain = 'SHRIMP' AND a.tail IS NOT NULL AND b.tail IS NULL THEN 'TAIL_STATE_UNKNOWN'
       WHEN a.bread <> b.bread THEN 'BREADED_MISMATCH' WHEN a.domain = 'SHRIMP' AND a.cal IS NOT NULL AND b.cal IS NULL THEN 'CALIBER_MISSING'
       WHEN a.domain = 'SHRIMP' AND a.cal <> b.cal THEN 'CALIBER_MISMATCH' WHEN a.domain = 'FISH_FILLET' AND a.skin <> b.skin THEN 'SKIN_MISMATCH'
       WHEN a.domain = 'FISH_FILLET' AND a.state <> b.state THEN 'STATE_MISMATCH' WHEN a.uom <> b.uom AND NOT (a.w IS NOT NULL AND b.w IS NOT NULL) THEN 'UOM_MISMATCH'
       WHEN a.box <> b.box THEN 'IS_BOX_MISMATCH' END AS reason FROM sg a JOIN sg b ON a.domain IS NOT NULL)"""
ORACLE = {
    "domain_rejections": _SIG + """ , bn AS (SELECT l_partkey AS bp, count(*) AS n FROM o WHERE active GROUP BY 1)
      , c AS (SELECT ap, reason, CAST(sum(n) AS BIGINT) AS n FROM pr JOIN bn USING (bp) WHERE reason IS NOT NULL GROUP BY 1, 2)
      SELECT offer_id AS ref_id, reason, n FROM o JOIN c ON ap = l_partkey
      UNION ALL SELECT offer_id, CASE WHEN black THEN 'SOURCE_BLACKLISTED' ELSE 'SOURCE_UNCLASSIFIED' END, 0 FROM o JOIN sg ON p_partkey = l_partkey WHERE domain IS NULL""",
    "domain_alternatives": _SIG + f""" , lo AS (SELECT l_partkey AS bp, offer_id, price, row_number() OVER (PARTITION BY l_partkey ORDER BY price, offer_id) AS r FROM o WHERE active)
      , rk AS (SELECT ap, domain, offer_id, price, sb, wok, row_number() OVER (PARTITION BY ap ORDER BY sb DESC, wok DESC, price, offer_id) AS r2 FROM pr JOIN lo USING (bp) WHERE reason IS NULL AND r <= {LIMIT + 1})
      , al AS (SELECT o.offer_id AS ref_id, domain, rk.offer_id, rk.price, sb AS same_brand, wok AS weight_ok, row_number() OVER (PARTITION BY o.offer_id ORDER BY r2) AS rank
          FROM o JOIN rk ON ap = l_partkey AND r2 <= {LIMIT + 1} WHERE rk.offer_id <> o.offer_id)
      SELECT ref_id, domain, CAST(rank AS INT) AS rank, offer_id, price, same_brand, weight_ok FROM al WHERE rank <= {LIMIT}""",
}
