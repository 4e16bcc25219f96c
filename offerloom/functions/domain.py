"""Shrimp and fish-fillet signatures of a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.amounts import number
from offerloom.functions.text import NOT_WORD_AHEAD, NOT_WORD_BEHIND, any_contains, first_key

# Fixed values, in order of precedence.
SHRIMP_TERMS = [
    "креветк", "креветоч", "shrimp", "prawn", "ваннамей", "ванамей", "vannamei", "vanamei", "vannameii", "тигров",
    "tiger", "королевск", "king", "royal", "лангустин", "langoustine", "langostin", "северн", "северян", "north",
    "northern", "аргентин", "argentin", "argentina", "черномор",
]
SHRIMP_ATTRIBUTES = [
    "б/г", "с/г", "без голов", "с голов", "headless", "head on", "head-on", "очищ", "неочищ", "peeled", "unpeeled",
    "shell on", "shell-on", "б/хв", "с/хв", "без хвост", "с хвост", "tail on", "tail off", "tail-on", "tail-off",
    "с/м", "в/м", "в/п", "raw", "cooked", "бланш", "шт/ф", "штуч", "iqf", "block", "блок", "во льду", "глазур",
    "калибр", "размер", "size",
]
SHRIMP_EXCLUDES = [
    "со вкусом", "вкус кревет", "ароматизатор", "чипс", "снек", "сухар", "крекер", "соус", "заправ", "маринад",
]
SHRIMP_SPECIES = {
    "vannamei": ["ваннам", "белоног", "vanam", "vannam"],
    "tiger": ["тигр", "tiger"],
    "argentine": ["аргент", "argentin"],
    "northern": ["северн", "ботан", "pandalus", "coldwater", "northern", "норвеж", "гренланд"],
    "king": ["королев", "king", "royal"],
}
SHRIMP_STATE = {"cooked_frozen": ["варён", "варен", "в/м", "cooked"], "blanched": ["бланш", "blanch"]}
SHRIMP_BREADED = [
    "панир", "панко", "темпур", "кляр", "breaded", "tempura", "batter", "torpedo", "торпедо", "хрустящ",
]
FISH_SPECIES = {
    "salmon": ["лосось", "лососев", "лосося", "сёмга", "семга", "сёмги", "семги", "атлантиче"],
    "trout": ["форель", "форели"],
    "cod": ["треска", "трески", "трескова", "трескового"],
    "pollock": ["минтай", "минтая"],
    "tuna": ["тунец", "тунца"],
    "halibut": ["палтус", "палтуса"],
    "mackerel": ["скумбри"],
    "herring": ["сельд", "сельди"],
    "seabass": ["сибас", "сибаса"],
    "dorado": ["дорад", "дорадо"],
    "tilapia": ["тилапи"],
    "perch": ["окун", "окуня", "судак"],
    "pike": ["щук", "щуки"],
    "pangasius": ["пангасиус"],
    "hake": ["хек", "хека", "мерлуз"],
    "flounder": ["камбал"],
    "zander": ["судак", "судака"],
    "carp": ["карп", "сазан"],
    "catfish": ["сом", "сома"],
    "haddock": ["пикш"],
    "redfish": ["окунь морск", "красн рыб"],
    "pink_salmon": ["горбуш"],
    "chum_salmon": ["кета", "кеты"],
    "coho_salmon": ["кижуч"],
    "sockeye_salmon": ["нерк"],
}
FISH_CUT = {
    "liver": ["печень"],
    "fillet": ["филе", "fillet", "filet", "филей"],
    "minced": ["фарш", "mince", "ground"],
    "steak": ["стейк", "steak", "кусок", "порц", "ломт"],
    "carcass": ["каркас", "хребет", "хребты", "спинк", "carcass"],
    "whole": [
        "тушка", "тушки", "целая", "целый", "whole", "н/р", "н/п", "неразд", "непотр", "потрош", "с головой",
        "без голов", "б/г", "с/г",
    ],
}
FISH_BREADED = ["панир", "панко", "breaded", "batter", "кляр", "хрустящ", "tempura", "темпур"]
FISH_STATE = {
    "frozen": ["с/м", "свежеморож", "свежемороз", "зам", "замор", "мороз", "frozen"],
    "chilled": ["охл", "охлажд", "chilled", "свеж"],
}
SKIN = {
    "skin_off": [r"без\s*кож", r"б/к" + NOT_WORD_AHEAD, r"skin[\s\-]?off" + NOT_WORD_AHEAD, r"skinless" + NOT_WORD_AHEAD, r"бескож"],
    "skin_on": [r"на\s*кож", r"с\s*кож", r"skin[\s\-]?on" + NOT_WORD_AHEAD, r"с/к" + NOT_WORD_AHEAD],
}
TAIL = {
    "tail_off": [
        r"б/хв" + NOT_WORD_AHEAD, r"б/х" + NOT_WORD_AHEAD, r"без\s*хв", r"безхв", r"tail[\s\-]?off" + NOT_WORD_AHEAD,
        r"t[\s\-]?off" + NOT_WORD_AHEAD, r"tailless" + NOT_WORD_AHEAD,
    ],
    "tail_on": [
        r"с/хв" + NOT_WORD_AHEAD, r"с/х" + NOT_WORD_AHEAD, r"с\s+хв" + NOT_WORD_AHEAD, r"с\s*хвост", r"на\s*хвост",
        r"хвостик", r"с\s*хв\.", r"tail[\s\-]?on" + NOT_WORD_AHEAD, r"t[\s\-]?on" + NOT_WORD_AHEAD,
    ],
}
SHRIMP_BLACKLIST = [
    "гёдза!", "гедза!", "пельмен", "варенник", "вареник", "хинкали!", "полуфабрикат", "п/ф!", r"готовое\s+блюдо",
    "закуска!", "суп!", "супа!", "супов!", "салат", "набор", "ассорти!", "микс!", "котлет", "наггетс", "фрикадел",
    "лапша!", "удон!", "рамен!", "спагетти!", "соус", "чипс", "снек", "крекер", r"со\s+вкусом!", r"вкус\s+кревет",
    r"крабов[а-яё]*\s+палоч", "сурими!",
]
FISH_BLACKLIST = [
    "гёдза!", "гедза!", "пельмен", "варенник", "вареник", "хинкали!", "манты!", "полуфабрикат", "п/ф!",
    r"готовое\s+блюдо", "суп!", "супа!", "супов!", "салат", "набор", "ассорти!", "микс!", "сет!", "котлет", "наггетс",
    "фрикадел", "тефтел", "бургер", r"со\s+вкусом!", r"крабов[а-яё]*\s+палоч", "сурими!", "консерв", "пресерв",
    "ж/б!", r"в\s+масле!", r"в\s+томат", "копч", "х/к!", "г/к!", "солён", "солен", "малосол", "икра!", "молок!",
    "печень!",
]
BOX = [
    rf"{NOT_WORD_BEHIND}кор\.?{NOT_WORD_AHEAD}", rf"{NOT_WORD_BEHIND}короб", rf"{NOT_WORD_BEHIND}ящик",
    rf"{NOT_WORD_BEHIND}box{NOT_WORD_AHEAD}", rf"{NOT_WORD_BEHIND}(10|20)\s*кг{NOT_WORD_AHEAD}", r"кг\s*/\s*кор", r"вес\s+\d+\s*кг",
]
CALIBER = r"(\d{1,3})\s*[/\-:]\s*(\d{1,3})"


def word_pattern(parts: list[str]) -> str:
    """One pattern of words that start here; a trailing ! also ends the word."""
    return "|".join(NOT_WORD_BEHIND + (p[:-1] + NOT_WORD_AHEAD if p.endswith("!") else p) for p in parts)


def first_pattern(text: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike("|".join(NOT_WORD_BEHIND + p for p in ps)), F.lit(k)) for k, ps in table.items()])


DOMAIN_COLUMNS = ["domain", "blacklisted", "species", "state", "form", "cut", "tail", "skin", "breaded", "caliber", "uom", "has_weight", "is_box"]


def with_domain(df: DataFrame, name: str = "name_raw") -> DataFrame:
    """Adds the domain signature and ``weight_kg``. The domain is null for names outside shrimp and fish fillet."""
    low = F.lower(F.col(name))
    c = {i: F.regexp_extract(low, CALIBER, i) for i in (1, 2)}
    caliber = F.when(c[1] != "", F.concat(c[1].cast("int").cast("string"), F.lit("/"), c[2].cast("int").cast("string")))
    df = df.withColumns(
        {
            "_low": low,
            "caliber": caliber,
            "fish": first_key(low, FISH_SPECIES),
            "cut": first_key(low, FISH_CUT),
            "_fish_breaded": any_contains(low, FISH_BREADED),
            "_fish_black": low.rlike(word_pattern(FISH_BLACKLIST)),
            "_shrimp_black": low.rlike(word_pattern(SHRIMP_BLACKLIST)),
        }
    )
    low = F.col("_low")
    shrimp = ~any_contains(low, SHRIMP_EXCLUDES) & (
        any_contains(low, SHRIMP_TERMS) | (F.col("caliber").isNotNull() & any_contains(low, SHRIMP_ATTRIBUTES))
    )
    fillet = F.col("fish").isNotNull() & (
        F.coalesce(F.col("cut") == "fillet", F.lit(False))
        | (F.col("_fish_breaded") & ~F.coalesce(F.col("cut").isin("whole", "carcass"), F.lit(False)))
    )
    domain = F.when(fillet & ~F.col("_fish_black"), "FISH_FILLET").when(shrimp & ~F.col("_shrimp_black"), "SHRIMP")
    df = df.withColumns({"domain": domain, "blacklisted": F.col("_fish_black") | F.col("_shrimp_black")})
    is_shrimp, is_fish = F.col("domain") == "SHRIMP", F.col("domain") == "FISH_FILLET"
    shell = F.when(any_contains(low, ["неочищ", "в панцир", "в скорлуп", "unpeeled", "shell on"]), "shell_on").when(
        any_contains(low, ["очищ", "peeled", "о/м", "чищен"]), "peeled"
    ).otherwise("shell_on")
    head = F.when(any_contains(low, ["б/г", "без голов", "headless"]), "headless").when(
        any_contains(low, ["с/г", "с голов", "head on"]), "head_on"
    ).otherwise("headless")
    kg = number(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?)\s*кг" + NOT_WORD_AHEAD, 1))
    g = number(F.regexp_extract(low, r"(\d+)\s*гр?" + NOT_WORD_AHEAD, 1))
    weight = F.coalesce(kg, F.when(g.between(50, 10000), g / 1000))
    uom = F.when(low.rlike(r"\d\s*шт" + NOT_WORD_AHEAD), "pcs").when(weight.isNotNull(), "kg")
    return df.withColumns(
        {
            "species": F.when(is_shrimp, F.coalesce(first_key(low, SHRIMP_SPECIES), F.lit("unspecified"))).when(is_fish, F.col("fish")),
            "state": F.when(is_shrimp, F.coalesce(first_key(low, SHRIMP_STATE), F.lit("raw_frozen"))).when(is_fish, first_key(low, FISH_STATE)),
            "form": F.when(is_shrimp, F.concat(shell, F.lit("_"), head)),
            "cut": F.when(is_fish, F.col("cut")),
            "tail": F.when(is_shrimp, first_pattern(low, TAIL)),
            "skin": F.when(is_fish, first_pattern(low, SKIN)),
            "breaded": F.when(is_shrimp, any_contains(low, SHRIMP_BREADED)).when(is_fish, F.col("_fish_breaded")),
            "caliber": F.when(is_shrimp, F.col("caliber")),
            "weight_kg": weight,
            "uom": uom,
            "has_weight": weight.isNotNull(),
            "is_box": reduce(lambda x, y: x | y, [low.rlike(p) for p in BOX]),
        }
    ).drop("_low", "fish", "_fish_breaded", "_fish_black", "_shrimp_black")


def domain_gates(a, b) -> list[tuple[str, Column]]:
    """Strict gates inside one (domain, species), in order, for sides given as name-to-column functions."""
    shrimp, fish = a("domain") == "SHRIMP", a("domain") == "FISH_FILLET"

    def differ(name: str) -> Column:
        return F.coalesce(a(name) != b(name), F.lit(False))

    def missing(name: str) -> Column:
        return a(name).isNotNull() & b(name).isNull()

    units = differ("uom") & ~(a("has_weight") & b("has_weight"))
    return [
        ("SHRIMP_STATE_MISMATCH", shrimp & differ("state")),
        ("SHRIMP_FORM_MISMATCH", shrimp & differ("form")),
        ("TAIL_STATE_MISMATCH", shrimp & differ("tail")),
        ("TAIL_STATE_UNKNOWN", shrimp & missing("tail")),
        ("CUT_TYPE_MISSING", fish & missing("cut")),
        ("CUT_TYPE_MISMATCH", fish & differ("cut")),
        ("BREADED_MISMATCH", differ("breaded")),
        ("CALIBER_MISSING", shrimp & missing("caliber")),
        ("CALIBER_MISMATCH", shrimp & differ("caliber")),
        ("SKIN_MISMATCH", fish & differ("skin")),
        ("STATE_MISMATCH", fish & differ("state")),
        ("UOM_MISMATCH", units),
        ("IS_BOX_MISMATCH", a("is_box") != b("is_box")),
    ]
