"""Name cleaning, tokens and stems as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAME_STOPWORDS = [
    "зам", "зам.", "замороженный", "замороженная", "с/м", "см", "с/г", "в/у", "гост", "вес", "фас", "упак",
    "кор", "пак", "блок", "frozen", "pack", "box", "pcs", "carton",
]
SEARCH_STOPWORDS = [
    "и", "в", "на", "с", "по", "из", "для", "от", "до", "за", "при", "без", "под", "над", "об", "о", "а", "но",
    "или", "же", "ли", "бы", "не", "ни", "что", "как", "так", "то", "это", "все", "вся", "весь", "его", "ее",
    "их", "мы", "вы", "он", "она", "оно", "они", "мой", "твой", "наш", "ваш", "свой", "кто", "тот", "этот",
    "сам", "самый", "каждый", "другой", "такой", "который", "чей", "сей",
]
QUERY_STOPWORDS = ["и", "в", "на", "с", "по", "для", "из", "от", "до", "за", "к", "у", "о", "не"]
SHORT_STEM_ENDINGS = [
    "ами", "ями", "ому", "ему", "ого", "его", "ими", "ыми", "ах", "ях", "ов", "ев", "ий", "ый", "ой", "ей",
    "ию", "ью", "ая", "яя", "ое", "ее", "ие", "ые", "ом", "ем", "им", "ым", "ую", "юю", "ам", "ям", "а", "я",
    "о", "е", "и", "ы", "у", "ю",
]
VOWELS = "аеёиоуыэюяaeiouy"

WORD = "0-9a-zа-яё_"
NOT_WORD_AHEAD = f"(?![{WORD}])"
NOT_WORD_BEHIND = f"(?<![{WORD}])"
CALIBER = r"\d+/\d+"


def blank_to_null(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def first_key(text: Column, table: dict[str, list[str]]) -> Column:
    """Key of the first table entry with a word inside ``text``."""
    hits = [F.when(any_contains(text, words), F.lit(key)) for key, words in table.items() if words]
    return F.coalesce(*hits)


def word_in(text: Column, word: str) -> Column:
    """Whole-word test by padded containment."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {word} ")


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_name(raw: Column) -> Column:
    """Lower case, no codes, weights, calibers, punctuation or stop words."""
    t = F.translate(F.lower(raw), "ё", "е")
    t = F.regexp_replace(t, rf"{NOT_WORD_BEHIND}\d{{6,}}{NOT_WORD_AHEAD}", "")
    t = F.regexp_replace(t, rf"\d+(?:[.,]\d+)?[-~]?\d*\s*(?:кг|kg|г|гр|g|мл|ml|л|l){NOT_WORD_AHEAD}", "")
    t = F.regexp_replace(t, rf"{NOT_WORD_BEHIND}\d{{1,3}}\s*/\s*\d{{1,3}}(?:\+(?=[{WORD}])|{NOT_WORD_AHEAD})", "")
    t = squash(F.regexp_replace(t, rf"[^{WORD}\s]", " "))
    words = F.filter(F.split(t, " "), lambda w: (F.length(w) > 1) & ~w.isin(NAME_STOPWORDS))
    return F.array_join(words, " ")


def item_code(raw: Column) -> Column:
    """Six or more digits at the start, else at the end, of the name."""
    start = F.regexp_extract(raw, r"^(\d{6,})\s+.+$", 1)
    end = F.regexp_extract(raw, r"^.+?\s+(\d{6,})$", 1)
    return F.coalesce(F.when(start != "", start), F.when(end != "", end))


def normalize_search(raw: Column) -> Column:
    """Search form of a text; a caliber such as 31/40 stays one token."""
    t = F.translate(F.lower(raw), "ё", "е")
    t = F.regexp_replace(t, r"(\d+)/(\d+)", "$1\u0001$2")
    t = F.regexp_replace(t, rf"[^{WORD}\s\u0001]", " ")
    return squash(F.translate(t, "\u0001", "/"))


def is_special(token: Column) -> Column:
    return token.rlike(r"^\d+(/\d+)?$")


def search_words(raw: Column) -> Column:
    words = F.split(normalize_search(raw), " ")
    return F.filter(words, lambda w: is_special(w) | ((F.length(w) > 1) & ~w.isin(SEARCH_STOPWORDS)))


def search_tokens(name: Column, brand: Column, super_class: Column, core: Column) -> Column:
    """Sorted token set of name, brand, class parts and core parts."""
    def parts(col: Column) -> Column:
        return search_words(F.translate(F.coalesce(col, F.lit("")), "_.", "  "))

    brand_raw = F.when(brand.isNotNull(), F.array(F.lower(brand))).otherwise(F.array().cast("array<string>"))
    everything = F.concat(search_words(name), parts(brand), brand_raw, parts(super_class), parts(core))
    return F.array_sort(F.array_distinct(F.filter(everything, lambda w: w != "")))


def short_stem(word: Column) -> Column:
    """First ending of the ordered list that leaves three letters is cut."""
    cuts = [
        F.when(word.endswith(e) & (F.length(word) - len(e) >= 3), F.substring(word, F.lit(1), F.length(word) - len(e)))
        for e in SHORT_STEM_ENDINGS
    ]
    return F.coalesce(*cuts, word)


def long_stem(word: Column, endings: list[str]) -> Column:
    """Longest ending that leaves two letters with a vowel is cut; numbers and calibers stay."""
    ordered = sorted(dict.fromkeys(endings), key=len, reverse=True)
    cuts = []
    for e in ordered:
        stem = F.substring(word, F.lit(1), F.length(word) - len(e))
        cuts.append(F.when(word.endswith(e) & (F.length(stem) >= 2) & stem.rlike(f"[{VOWELS}]"), stem))
    stemmed = F.coalesce(*cuts, word)
    return F.when(word.rlike(r"^\d+([/.,]\d+)?$") | (F.length(word) <= 2), word).otherwise(stemmed)


def query_words(raw: Column) -> Column:
    """Words of a search text: letters and digits first, then calibers."""
    q = F.lower(F.trim(raw))
    calibers = F.regexp_extract_all(q, F.lit(rf"({CALIBER})"), 1)
    plain = F.regexp_extract_all(F.regexp_replace(q, CALIBER, " "), F.lit("([а-яёa-z0-9]+)"), 1)
    return F.filter(F.concat(plain, calibers), lambda w: (F.length(w) >= 2) & ~w.isin(QUERY_STOPWORDS))


def lemmas(words: Column) -> Column:
    stems = F.transform(F.filter(words, lambda w: F.length(w) >= 2), short_stem)
    return F.array_sort(F.array_distinct(F.filter(stems, lambda s: F.length(s) >= 2)))


def normalize_alias(raw: Column) -> Column:
    """Alias form: case, ё, marks and punctuation folded."""
    t = F.translate(F.lower(F.trim(raw)), "ё", "е")
    t = F.regexp_replace(t, r"[\"'«».,;:/\\\-_]", " ")
    return squash(F.regexp_replace(t, rf"[^{WORD}\s]", ""))


def semantic_tokens(name: Column, stopwords: list[str]) -> Column:
    """Words that carry meaning: no amounts, calibers, numbers or stop words; sorted set."""
    t = F.lower(name)
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)?\s*(?:кг|kg|гр|г|g|мл|ml|л|l|шт|pcs)" + NOT_WORD_AHEAD, " ")
    t = F.regexp_replace(t, r"\d+\s*/\s*\d+", " ")
    t = F.regexp_replace(t, r"\d+", " ")
    words = F.regexp_extract_all(t, F.lit("([а-яёa-z]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stopwords))
    return F.array_sort(F.array_distinct(kept))


def parse_price(raw: Column) -> Column:
    """Price text to a positive double, else null."""
    t = F.regexp_replace(F.translate(raw, "  ", ""), ",", ".")
    value = F.regexp_replace(t, r"[^\d.]", "").try_cast("double")
    return F.when(value > 0, value)


def clean_code(raw: Column) -> Column:
    """Article code; ``2001.0`` read from a number cell becomes ``2001``."""
    t = F.trim(raw)
    t = F.regexp_replace(t, r"^(\d+)\.0+$", "$1")
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def word_groups(words: Column, max_words: int) -> Column:
    """Distinct runs of one to ``max_words`` neighbouring words, joined by spaces."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, max_words + 1)])))
