"""Weights, volumes, packs, unit prices and order quantities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import NOT_WORD_AHEAD

# Unit spellings.
UNIT_TYPE = {
    "шт": "PIECE", "шт.": "PIECE", "штук": "PIECE", "штука": "PIECE", "pcs": "PIECE",
    "кг": "WEIGHT", "кг.": "WEIGHT", "kg": "WEIGHT", "г": "WEIGHT", "гр": "WEIGHT", "г.": "WEIGHT",
    "л": "VOLUME", "л.": "VOLUME", "мл": "VOLUME", "мл.": "VOLUME", "l": "VOLUME", "ml": "VOLUME",
}
UNIT_NORM = {
    "kg": "kg", "кг": "kg", "kilogram": "kg", "кило": "kg",
    "g": "g", "г": "g", "gr": "g", "gram": "g", "грамм": "g", "гр": "g",
    "l": "l", "л": "l", "liter": "l", "литр": "l",
    "ml": "ml", "мл": "ml", "milliliter": "ml", "миллилитр": "ml",
    "pcs": "pcs", "шт": "pcs", "шт.": "pcs", "piece": "pcs", "штук": "pcs", "штука": "pcs",
    "box": "box", "кор": "box", "короб": "box", "коробка": "box",
}
# Pack patterns in order (pattern, factor to g / ml / pcs, unit type, confidence).
# A pattern ending in "\b" stops at the end of a word.
PACK_RULES = [
    (r"(\d+[.,]?\d*)\s*кг", 1000.0, "WEIGHT", 1.0),
    (r"(\d+[.,]?\d*)\s*kg", 1000.0, "WEIGHT", 1.0),
    (r"(\d+[.,]?\d*)\s*гр?\b", 1.0, "WEIGHT", 1.0),
    (r"(\d+[.,]?\d*)\s*gr?\b", 1.0, "WEIGHT", 1.0),
    (r"(\d+[.,]?\d*)\s*л\b", 1000.0, "VOLUME", 1.0),
    (r"(\d+[.,]?\d*)\s*l\b", 1000.0, "VOLUME", 1.0),
    (r"(\d+[.,]?\d*)\s*мл", 1.0, "VOLUME", 1.0),
    (r"(\d+[.,]?\d*)\s*ml", 1.0, "VOLUME", 1.0),
    (r"(0[,.]\d+)\s*$", 1000.0, "VOLUME", 0.7),
    (r"(\d+)\s*шт", 1.0, "PIECE", 1.0),
    (r"(\d+)\s*pcs", 1.0, "PIECE", 1.0),
    (r"(\d+)\s*лист", 1.0, "PIECE", 0.9),
    (r"(\d+)\s*рул", 1.0, "PIECE", 0.9),
    (r"(\d+)\s*уп", 1.0, "PIECE", 0.8),
    (r"(\d+)\s*пач", 1.0, "PIECE", 0.8),
    (r"(\d+)\s*порц", 1.0, "PIECE", 0.8),
    (r"(\d+)\s*п\b", 1.0, "PIECE", 0.7),
]
# Assumed packs (words, words that rule it out, grams, confidence), in order.
UNITS_SEEN = ["кг", "г ", "гр", "шт"]
ASSUMED_MEAT_FISH = [
    "говядин", "свинин", "курин", "индейк", "утк", "гуся", "кролик", "баранин", "телятин", "окорок", "филе",
    "вырезк", "голень", "бедр", "грудк", "печень", "сердц", "язык", "шея", "шейк",
]
ASSUMED_DAIRY = ["сыр ", "сливки", "сметан", "творог", "масло ", "молоко"]
ASSUMED_SPICE = [
    "базилик", "ваниль", "кориандр", "корица", "паприка", "перец", "орех", "изюм", "арахис", "кешью", "фисташ",
    "миндал", "груша суш",
]
ASSUMED_SAUSAGE = ["сосиск", "колбас", "сардельк", "ветчин"]
ASSUMED_BREAD = ["батон", "хлеб", "булк", "багет"]
ASSUMED_DRIED = ["груша суш", "компотн", "смесь", "сухар", "пудр"]
ASSUMED_FISH = ["копчен", "охл", "мидии", "гребешок", "палтус", "скумбрия", "лосось тушк"]
ASSUMED_GRAIN = ["рис ", "рис,", "гречк", "пшен", "овсян", "манк", "перлов"]


def lookup(col: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(col))), F.lit(default))


def unit_type(col: Column) -> Column:
    return lookup(col, UNIT_TYPE, "PIECE")


def unit_norm(col: Column) -> Column:
    return lookup(col, UNIT_NORM, "pcs")


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def _mentions(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g1..gn, one per match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), i) for i in range(1, groups + 1)]
    return F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found, 1)])


WEIGHT_PATTERN = r"(\d+(?:[.,]\d+)?)\s*[-~]?\s*(\d+(?:[.,]\d+)?)?\s*(кг|kg|г|гр|g)"
VOLUME_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(л|l|мл|ml)"


def with_weights(df: DataFrame, text: Column) -> DataFrame:
    """Adds net, package and piece weight in kg and the variable and bulk flags.

    The mentions are parsed once, in their own projection, since several columns read them.
    """
    def to_kg(m: Column) -> Column:
        low, high = number(m["g1"]), number(m["g2"])
        mean = F.when(m["g2"] != "", (low + high) / 2).otherwise(low)
        return F.when(m["g3"].isin("г", "гр", "g"), mean / 1000).otherwise(mean)

    kg = F.col("_kg")
    top, low, n = F.array_max(kg), F.array_min(kg), F.size(kg)
    ratio = top / F.greatest(low, F.lit(1e-9))
    parsed = df.withColumn("_mentions", _mentions(F.lower(text), WEIGHT_PATTERN + NOT_WORD_AHEAD, 3)).withColumn(
        "_kg", F.transform("_mentions", to_kg)
    )
    return (
        parsed.withColumn("bulk_package", F.coalesce((n > 1) & (top >= 2.0) & (low > 0) & (ratio >= 5), F.lit(False)))
        .withColumns(
            {
                "net_weight_kg": F.when(F.col("bulk_package"), low).otherwise(top),
                "package_weight_kg": F.when(F.col("bulk_package"), top),
                "piece_weight_kg": F.when(n > 1, low),
                "variable_weight": F.exists("_mentions", lambda m: m["g2"] != ""),
            }
        )
        .drop("_mentions", "_kg")
    )


def net_volume(text: Column) -> Column:
    found = _mentions(F.lower(text), VOLUME_PATTERN + NOT_WORD_AHEAD, 2)
    return F.array_max(
        F.transform(found, lambda m: F.when(m["g2"].isin("мл", "ml"), number(m["g1"]) / 1000).otherwise(number(m["g1"])))
    )


def pack_quantity(text: Column) -> Column:
    """Pieces per pack from ``12 шт/упак``, ``*225pcs`` and the like."""
    patterns = [
        r"(\d+)\s*(?:шт|pcs|pieces)\s*[/*×x]\s*(?:упак|pack|box)",
        r"(\d+)\s*(?:шт|pcs)/(?:кор|упак)",
        r"\*(\d+)\s*(?:шт|pcs)",
    ]
    hits = [F.regexp_extract(F.lower(text), p, 1) for p in patterns]
    return F.coalesce(*[F.when(h != "", h.try_cast("int")) for h in hits])


def _struct(kind: str | None, qty: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(kind if kind else "UNKNOWN").alias("unit_type"),
        qty.cast("double").alias("base_qty"),
        F.lit(confidence).alias("confidence"),
    )


def parse_pack(text: Column) -> Column:
    """Pack of a name in g, ml or pieces: N×M first, then the ordered rules, then assumed packs."""
    from offerloom.functions.text import any_contains

    t = F.lower(text)
    multi = r"(\d+)\s*x\s*(\d+[.,]?\d*)\s*(кг|г|л|мл)"
    count, each, unit = (F.regexp_extract(t, multi, i) for i in (1, 2, 3))
    total = number(count) * number(each) * F.when(unit.isin("кг", "л"), 1000.0).otherwise(1.0)
    branches = [
        F.when(unit.isin("кг", "г"), _struct("WEIGHT", total, 0.9)),
        F.when(unit.isin("л", "мл"), _struct("VOLUME", total, 0.9)),
    ]
    for pattern, factor, kind, confidence in PACK_RULES:
        java = pattern.replace(r"\b", NOT_WORD_AHEAD)
        if pattern.startswith("(0"):
            java = r"(?<![0-9a-zа-яё_])" + java
        hit = F.regexp_extract(t, java, 1)
        branches.append(F.when(hit != "", _struct(kind, number(hit) * factor, confidence)))

    def assume(condition: Column, grams: float, confidence: float, kind: str = "WEIGHT") -> None:
        branches.append(F.when(condition, _struct(kind, F.lit(grams), confidence)))

    def words(kw: list[str], seen: list[str]) -> Column:
        return any_contains(t, kw) & ~any_contains(t, seen)

    assume(t.rlike(r"(^|[^0-9a-zа-яё_])вес\s*$") | t.rlike(r"\sвес([^0-9a-zа-яё_]|$)"), 1000.0, 0.5)
    assume(any_contains(t, ["с/м вес", "см вес"]), 1000.0, 0.5)
    assume(t.rlike(r"(^|[^0-9a-zа-яё_])(с/м|см|зам\.?)\s*$") | t.rlike(r"(^|[^0-9a-zа-яё_])зам,"), 1000.0, 0.4)
    jar = [F.regexp_extract(t, r"(\d+)[,.](\d{3})\s*$", i) for i in (1, 2)]
    branches.append(F.when(jar[0] != "", _struct("VOLUME", number(jar[0]) * 1000 + number(jar[1]), 0.7)))
    assume(t.rlike(r"\d+\s*см([^0-9a-zа-яё_]|$)") & any_contains(t, ["бумаг", "рисов"]), 1.0, 0.6, "PIECE")
    metres = F.regexp_extract(t, r"(\d+)\s*м([^0-9a-zа-яё_]|$)", 1)
    branches.append(F.when((metres != "") & t.contains("рул"), _struct("PIECE", number(metres), 0.7)))
    assume(words(ASSUMED_MEAT_FISH, UNITS_SEEN), 1000.0, 0.3)
    assume(words(ASSUMED_DAIRY, UNITS_SEEN + ["л ", "мл"]), 1000.0, 0.3)
    assume(words(ASSUMED_SPICE, UNITS_SEEN), 100.0, 0.3)
    assume(F.trim(t).rlike(r" кг\.?$"), 1000.0, 0.4)
    assume(words(ASSUMED_SAUSAGE, UNITS_SEEN), 1000.0, 0.3)
    assume(t.rlike(r"(^|[^0-9a-zа-яё_])\d+/\d+\s*$"), 1000.0, 0.4)
    assume(words(ASSUMED_BREAD, UNITS_SEEN[:3]), 400.0, 0.3)
    assume(words(ASSUMED_DRIED, UNITS_SEEN[:3]), 1000.0, 0.3)
    assume(words(ASSUMED_FISH, UNITS_SEEN[:3]), 1000.0, 0.3)
    assume(words(ASSUMED_GRAIN, UNITS_SEEN[:3]), 1000.0, 0.3)
    return F.coalesce(*branches, _struct(None, F.lit(None), 0.0))


def packs_needed(ref_type: Column, ref_qty: Column, type_: Column, qty: Column) -> dict[str, Column]:
    """Packs to cover the wanted amount and the reason code; unknown amounts count as one pack."""
    ref_unknown, unknown = ref_type == "UNKNOWN", type_ == "UNKNOWN"
    reason = (
        F.when(ref_unknown & unknown, "BOTH_UNITS_UNKNOWN")
        .when(ref_unknown, "REFERENCE_UNIT_UNKNOWN")
        .when(unknown, "OFFER_UNIT_UNKNOWN")
        .when(ref_qty.isNull() | qty.isNull(), "QTY_MISSING")
        .when(ref_type != type_, F.concat(F.lit("UNIT_MISMATCH_"), ref_type, F.lit("_vs_"), type_))
        .when(qty <= 0, "OFFER_PACK_ZERO")
        .otherwise("OK")
    )
    blocked = reason.startswith("UNIT_MISMATCH") | (reason == "OFFER_PACK_ZERO")
    packs = F.when(reason == "OK", F.ceil(ref_qty / qty)).when(blocked, F.lit(None)).otherwise(F.lit(1))
    return {"packs_needed": packs.cast("bigint"), "pack_reason": reason}


def pack_penalty(packs: Column) -> Column:
    """Percent points taken off the match for many packs."""
    steps = [(1, 0), (2, 5), (5, 10), (10, 15), (20, 25), (50, 30)]
    out = F.when(packs.isNull() | (packs == 0), 20)
    for limit, penalty in steps:
        out = out.when(packs <= limit, penalty)
    return out.otherwise(40)


def pack_explanation(ref_type: Column, ref_qty: Column, qty: Column, packs: Column) -> Column:
    """Text such as ``3 × 500 г = 1.5 кг``."""
    def show(amount: Column) -> Column:
        def scaled(big: str, small: str) -> Column:
            return F.when(amount >= 1000, F.format_string(f"%.1f {big}", F.bround(amount / 1000, 1))).otherwise(
                F.format_string(f"%.0f {small}", F.bround(amount, 0))
            )

        return (
            F.when(ref_type == "WEIGHT", scaled("кг", "г"))
            .when(ref_type == "VOLUME", scaled("л", "мл"))
            .when(ref_type == "PIECE", F.format_string("%.0f шт", F.bround(amount, 0)))
        )

    text = F.concat(packs.cast("string"), F.lit(" × "), show(qty), F.lit(" = "), show(ref_qty))
    return F.coalesce(F.when((packs > 0) & (ref_qty > 0) & (qty > 0), text), F.lit(""))


def base_unit(weight_kg: Column, volume_l: Column) -> Column:
    return F.when(weight_kg > 0, "kg").when(volume_l > 0, "l").otherwise("pcs")


def unit_price(price: Column, unit: Column, base: Column, w: Column, v: Column, piece: Column, qty: Column) -> Column:
    """struct(ppu, route, unknown): price per base unit by the first route that has its inputs."""
    counted = unit.isin("pcs", "box")

    def route(value: Column, name: str, unknown: bool = False) -> Column:
        return F.struct(value.cast("double").alias("ppu"), F.lit(name).alias("route"), F.lit(unknown).alias("unknown"))

    total = piece * qty
    return (
        F.when(price.isNull() | (price <= 0), route(F.lit(None), "0", True))
        .when(unit == "kg", route(price, "A"))
        .when(unit == "l", route(price, "B"))
        .when((unit == "g") & (w != 0), route(price / w, "A1"))
        .when((unit == "ml") & (v != 0), route(price / v, "B1"))
        .when(counted & (w > 0) & (base == "kg"), route(price / w, "C"))
        .when(counted & (w > 0), route(price, "C_pcs"))
        .when(counted & (v > 0) & (base == "l"), route(price / v, "D"))
        .when(counted & (v > 0), route(price, "D_pcs"))
        .when((qty > 0) & (total > 0) & (base == "kg"), route(price / total, "E"))
        .when(counted & (base == "pcs"), route(price, "0_pcs"))
        .otherwise(route(F.lit(None), "0", True))
    )


def route_confidence(route: Column, variable: Column) -> Column:
    return (
        F.when(route.isin("A", "B"), 1.0)
        .when(route.isin("A1", "B1"), 0.95)
        .when(route == "C", F.when(variable, 0.7).otherwise(0.9))
        .when(route.isin("D", "E"), 0.85)
        .when(route.isin("0_pcs", "C_pcs", "D_pcs"), 0.8)
        .otherwise(0.0)
    )


def ranking_price(price: Column, unit_type_: Column, pack: Column) -> Column:
    return F.when(unit_type_.isin("WEIGHT", "VOLUME") & (pack > 0) & (price > 0), price / pack)


def min_line_total(price: Column, min_qty: Column) -> Column:
    return price * F.greatest(F.coalesce(min_qty, F.lit(1)), F.lit(1))


def effective_qty(qty: Column, min_qty: Column) -> Column:
    """Quantity rounded up to whole minimum lots."""
    return F.when(min_qty <= 1, qty).otherwise(F.ceil(qty / min_qty) * min_qty).cast("double")


def constrained_qty(qty: Column, min_qty: Column, step: Column) -> dict[str, Column]:
    """Raised to the minimum, then up to a whole number of steps, with flags."""
    low = F.coalesce(min_qty, F.lit(1))
    by = F.coalesce(step, F.lit(1))
    raised = F.greatest(qty, low.cast("double"))
    rest = F.pmod(raised, by.cast("double"))
    stepped = (by > 1) & (rest > 0)
    final = F.when(stepped, raised + (by - rest)).otherwise(raised)
    return {"final_qty": final, "min_rounded": qty < low, "step_applied": stepped}
