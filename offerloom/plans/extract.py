"""Brands from where they stand in a name, and cores from typed seed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.rules import parts_held
from offerloom.plans import derive as d
from offerloom.session import cut_lineage

# Words that stand where brands do and are none.
COUNTRIES = [
    "россия", "рф", "китай", "китая", "чили", "таиланд", "вьетнам", "india", "индия", "италия", "испания", "германия", "франция",
    "сша", "usa", "беларусь", "казахстан", "турция", "греция", "норвегия", "peru", "перу",
]
NOT_BRANDS = [
    "пэт", "стекло", "ст/б", "ж/б", "вес", "шт", "уп", "упак", "кр", "блок", "балк", "дип-пот", "пакет", "банка", "бутылка",
    "тетра", "призма", "гост", "категория", "сорт", "экстра", "премиум", "premium", "extra", "il", "prb", "хэ", "pro", "россия",
    "china", "китай", "таиланд", "вьетнам", "италия", "испания", "германия", "франция", "чили", "индия", "usa", "сша",
    "мурманск", "черноморск", "импорт", "заморозка", "охлажд", "с/м", "см", "порционный", "порционная", "порционное",
    "классический", "традиционный", "оригинальный", "натуральный", "цветочный", "минеральная", "газированная",
    "безалкогольный", "безалкогольная", "без", "сахара", "штучн", "красный", "белый", "черный", "зеленый", "желтый", "копчен",
    "соленый", "сушеный",
]
# Places of a brand in a name with the confidence of each, in the order in which they are tried.
_WORDS = r"[A-Za-zА-Яа-яЁё\-'`\s]"
PLACES = [
    ("comma", r",\s*([A-ZА-ЯЁ]" + _WORDS + r"{2,25})(?:,|\s*$)", 0.7),
    ("unit", r"(?:\d+[,.]?\d*)\s*(?:кг|г|гр|л|мл|шт)[.]*\s+([A-ZА-ЯЁ]" + _WORDS + r"{2,25})(?:\s|,|$)", 0.6),
    ("quotes", r'["«]([A-ZА-ЯЁa-zа-яё]' + _WORDS + r'{1,25})["»]', 0.8),
]
# Order of the types of seed rules, actions that switch a rule off, and cores that are none.
SEED_TYPES = ["category", "product", "main_ingredient", "ingredient"]
OFF_ACTIONS = ["удалить", "skip"]
NOT_CORES = ["0%", "1%", "2%", "3%", "4%", "5%", "g", "kg", "l", "ml", "шт", "pcs"]
SHORTEST_CORE = 3


def brand_form(text: Column) -> Column:
    """Lower case, ё as е, without marks other than hyphens."""
    plain = F.translate(F.translate(F.trim(F.lower(text)), "ё", "е"), "`", "'")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s\-]", ""))


def brand_by_layout(names: DataFrame, known: DataFrame, not_brands: list[str] = [*COUNTRIES, *NOT_BRANDS]) -> DataFrame:  # noqa: B006
    """Per distinct ``name``: brand, confidence and place.

    A known brand (``known``: word, brand_id, ord; the first by ord counts) anywhere in the name is certain. Otherwise the first
    text counts that stands where brands do, after a comma, after an amount or in quotes, and is no country or common word.
    Null names have no row.
    """
    texts = cut_lineage(names.select("name").where("name is not null").distinct().withColumn("low", F.lower(F.trim("name"))), "brand-names")
    found = parts_held(texts, "low", known.select(F.lower("word").alias("word"), "brand_id", "ord"))
    sure = found.groupBy("name").agg(F.min(F.struct("ord", "brand_id")).alias("k")).select("name", F.col("k.brand_id").alias("known"))
    none = F.array(*map(F.lit, not_brands))

    def placed(place: str, pattern: str, confidence: float) -> Column:
        texts = F.transform(F.regexp_extract_all(F.trim("name"), F.lit(pattern), F.lit(1)), brand_form)
        first = F.get(F.filter(texts, lambda b: (F.length(b) >= 2) & (F.length(b) <= 25) & ~F.array_contains(none, b)), F.lit(0))
        return F.when(first.isNotNull(), F.struct(F.replace(first, F.lit(" "), F.lit("_")).alias("brand"), F.lit(confidence).alias("confidence"), F.lit(place).alias("place")))

    told = F.when(F.col("known").isNotNull(), F.struct(F.col("known").alias("brand"), F.lit(1.0).alias("confidence"), F.lit("known").alias("place")))
    best = F.coalesce(told, *(placed(*p) for p in PLACES))
    rows = texts.join(sure, "name", "left").withColumn("b", best)
    return rows.select("name", F.col("b.brand").alias("brand"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.col("b.place").alias("place"))


def backfill_brands(offers: DataFrame, known: DataFrame) -> DataFrame:
    """Live offers without a brand with the one that their name's layout tells: offer_id, name_raw, brand, confidence, place."""
    open_ = offers.where("active and coalesce(brand_id, '') = ''").select("offer_id", "name_raw")
    found = brand_by_layout(open_.select(F.col("name_raw").alias("name")), known).where("brand is not null")
    return open_.join(found, F.col("name_raw") == F.col("name")).drop("name")


def seed_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.trim(text)), "ё", "е"), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def seed_cores(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct ``name`` the canonical core of the seed rule (raw, canonical, type, action, ord) that it holds.

    Of several the one of the first type counts, then the longest, then the first. A later rule with the same text replaces an
    earlier one and keeps its place. Rules that are switched off, or whose core is short or none, don't count.
    """
    live = rules.where(~F.coalesce("action", F.lit("")).isin(OFF_ACTIONS) & (F.coalesce("raw", F.lit("")) != "") & (F.length("canonical") >= SHORTEST_CORE))
    last = live.groupBy(F.lower("raw").alias("word")).agg(F.max_by(F.struct("canonical", "type"), "ord").alias("r"), F.min("ord").alias("ord"))
    order = F.coalesce(*(F.when(F.col("r.type") == t, k + 1) for k, t in enumerate(SEED_TYPES)), F.lit(len(SEED_TYPES) + 1))
    table = last.select("word", "ord", F.col("r.canonical").alias("canonical"), order.alias("priority")).where(~F.col("canonical").isin(NOT_CORES))
    texts = names.select("name").where("name is not null").distinct().withColumn("form", seed_form(F.col("name")))
    found = parts_held(texts, "form", table).groupBy("name").agg(F.min(F.struct("priority", (-F.length("word")).alias("n"), "ord", "canonical")).alias("m"))
    return texts.join(found, "name", "left").select("name", F.col("m.canonical").alias("core"), F.col("m.priority").alias("priority"))


# ---------------------------------------------------------------------------------------------

# Names of the derived items with brands in all places, as SQL that both engines read.
_BRAND = "CASE p_partkey % 7 WHEN 0 THEN 'Россия' WHEN 1 THEN 'Alfa Foods' WHEN 2 THEN 'Ёлка-Плюс' WHEN 3 THEN 'Премиум' WHEN 4 THEN 'D''Oro' WHEN 5 THEN 'gamma' ELSE 'Beta' END"
LAYOUT_NAME = (
    f"CASE p_partkey % 5 WHEN 0 THEN p_name || ', ' || {_BRAND} || CASE WHEN p_partkey % 3 = 0 THEN ', Россия' ELSE '' END WHEN 1 THEN p_name || ' ' || CAST(p_size AS STRING) || ' кг. ' || {_BRAND}"
    f" WHEN 2 THEN p_name || ' «' || {_BRAND} || '»' WHEN 3 THEN p_name || ' ' || lower(p_brand) || ', ' || {_BRAND} ELSE p_name || ' ' || CAST(p_size AS STRING) || 'г' END"
)
_KNOWN = [("brand#1", "house", 0), ("brand#12", "twelve", 1), ("brand#2", "second", 2), ("beta", "beta", 3)]
_SEEDS = [
    ("ring", "ring.metal", "ingredient", "оставить", 0), ("widget", "widget", "product", "оставить", 1), ("small", "size.small", "attribute", "", 2), ("red r", "red.thing", "ingredient", "", 3),
    ("ring", "ring.any", "product", "учитывать", 4), ("gear", "gear", "category", "удалить", 5), ("bolt", "kg", "category", "", 6), ("bolt", "bolt", "main_ingredient", "", 7),
    ("hot bolt", "bolt.hot", "main_ingredient", None, 8), ("", "none", "category", "", 9), ("rod", "ro", "product", "", 10), ("gizmo", "gizmo", "ingredient", "", 11), ("o", "letter", "attribute", "", 12),
]


def _layout_names(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "part").select(F.expr(LAYOUT_NAME).alias("name"))


def q_brand_layout(spark: SparkSession, sf: str) -> DataFrame:
    return brand_by_layout(_layout_names(spark, sf), spark.createDataFrame(_KNOWN, "word string, brand_id string, ord int"))


def q_seed_cores(spark: SparkSession, sf: str) -> DataFrame:
    return seed_cores(_layout_names(spark, sf), spark.createDataFrame(_SEEDS, "raw string, canonical string, type string, action string, ord int"))


QUERIES = {"brand_layout": q_brand_layout, "seed_cores": q_seed_cores}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FORM = r"trim(regexp_replace(replace(replace(trim(lower(b)), 'ё', 'е'), '`', ''''), '[^\p{L}\p{N}_\s\-]', '', 'g'))"
_NAMES = f"nm AS (SELECT DISTINCT {LAYOUT_NAME} AS name FROM part)"


def _first(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"list_filter(list_transform(regexp_extract_all(trim(name), '{quoted}', 1), lambda b: {_FORM}), lambda b: len(b) >= 2 AND len(b) <= 25 AND NOT list_contains({_list([*COUNTRIES, *NOT_BRANDS])}, b))[1]"


_SEED_ROWS = ", ".join(f"('{raw}', '{canonical}', '{kind}', {'NULL' if action is None else repr(action)}, {k})" for raw, canonical, kind, action, k in _SEEDS)
ORACLE = {
    "brand_layout": f"""WITH {_NAMES}, kn(word, brand_id, ord) AS (VALUES {', '.join(map(str, _KNOWN))})
      , k AS (SELECT name, arg_min(brand_id, ord) AS known FROM nm JOIN kn ON contains(lower(trim(name)), word) GROUP BY 1)
      , p AS (SELECT name, known, {', '.join(f'{_first(pattern)} AS {place}' for place, pattern, _ in PLACES)} FROM nm LEFT JOIN k USING (name))
      SELECT name, coalesce(known, replace(comma, ' ', '_'), replace(unit, ' ', '_'), replace(quotes, ' ', '_')) AS brand,
        CAST(CASE WHEN known IS NOT NULL THEN 1.0 WHEN comma IS NOT NULL THEN 0.7 WHEN unit IS NOT NULL THEN 0.6 WHEN quotes IS NOT NULL THEN 0.8 ELSE 0.0 END AS DOUBLE) AS confidence,
        CASE WHEN known IS NOT NULL THEN 'known' WHEN comma IS NOT NULL THEN 'comma' WHEN unit IS NOT NULL THEN 'unit' WHEN quotes IS NOT NULL THEN 'quotes' END AS place FROM p""",
    "seed_cores": rf"""WITH {_NAMES}, f AS (SELECT name, trim(regexp_replace(regexp_replace(replace(lower(trim(name)), 'ё', 'е'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM nm)
      , r(raw, canonical, kind, action, ord) AS (VALUES {_SEED_ROWS})
      , l AS (SELECT lower(raw) AS word, arg_max(canonical, ord) AS canonical, arg_max(kind, ord) AS kind, min(ord) AS ord FROM r WHERE coalesce(action, '') NOT IN ('удалить', 'skip') AND raw <> '' AND len(canonical) >= 3 GROUP BY 1)
      , t AS (SELECT *, CASE kind WHEN 'category' THEN 1 WHEN 'product' THEN 2 WHEN 'main_ingredient' THEN 3 WHEN 'ingredient' THEN 4 ELSE 5 END AS priority FROM l WHERE NOT list_contains({_list(NOT_CORES)}, canonical))
      , h AS (SELECT name, min((priority, -len(word), ord, canonical)) AS m FROM f JOIN t ON contains(form, word) GROUP BY 1)
      SELECT name, m[4] AS core, CAST(m[1] AS INT) AS priority FROM f LEFT JOIN h USING (name)""",
}
