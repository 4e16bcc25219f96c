"""Pair rules compiled to bit arrays.

A pair rule refuses a (reference, candidate) pair by what either side holds: it *asks* on the reference's side and *shows* on
the candidate's, and the pair is refused where both hold. A rule table has several lines a rule; a line names a word, a scope
(class, or the start of one with ``*``) or both, and a side of a rule holds if any of its lines matches, or none if the side
is negated. That covers forbidden words, opposite attributes, words that both sides must share, and anchors of a class.

Rules get a bit each, in order of priority. Every distinct entity (a name with its class and features) gets two arrays of 62-bit
words, ``asks`` and ``shows``. A pair is refused if their AND is not zero, and its lowest bit is the first rule that refuses
it. So pairs are decided between distinct bit arrays and not between rows, and counted without being listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import checked_broadcast, cut_lineage

#: Bits used of each number.
WIDTH = 62
#: A rule table's columns. ``match``: token (a whole word of the text), part (anywhere in it), feature (given beside the text).
RULE_SCHEMA = "rule_id string, priority int, reason string, side string, negated boolean, match string, word string, scope string"


def numbered(rules: DataFrame) -> DataFrame:
    """The rule lines with their rule's ``bit``. A rule table is a dictionary, so one task numbers it."""
    order = rules.groupBy("rule_id").agg(F.min("priority").alias("_p")).withColumn("bit", F.row_number().over(Window.orderBy("_p", "rule_id")) - 1)
    return rules.join(order.drop("_p"), "rule_id")


def words_of(texts: DataFrame, text: str, keys: list[str], rules: DataFrame) -> DataFrame:
    """``keys`` and ``words``: the dictionary words that a text holds, for any size of dictionary.

    A dictionary word with n spaces inside stands within n + 1 words of a text in a row. So the distinct runs of that many words
    are cut into their substrings of the lengths that the dictionary has (with a space on both sides for whole words), these
    join the dictionary, and the texts look up their runs.
    """
    listed = rules.where("match in ('token', 'part') and word is not null")
    gram = F.lower(F.when(F.col("match") == "token", F.concat(F.lit(" "), "word", F.lit(" "))).otherwise(F.col("word")))
    bare = F.trim("_gram")
    # Two spaces at an end stand only where a text begins or ends.
    inside = (bare != "") & ~F.col("_gram").startswith("  ") & ~F.col("_gram").endswith("  ")
    span = F.when(inside, F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).otherwise(0)
    listed = listed.select(gram.alias("_gram"), _mark(F.col("match"), F.col("word")).alias("_mark")).distinct().withColumn("_span", span)
    sizes: dict[int, list[int]] = {}
    for r in listed.select("_span", F.length("_gram").alias("n")).distinct().sort("_span", "n").collect():
        sizes.setdefault(r["_span"], []).append(r["n"])
    if not sizes:
        return texts.select(*keys, F.array().cast("array<string>").alias("words")).where("false")
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}%/.,-]+", " "), F.lit(" "))

    def runs(n: int) -> Column:
        if n == 0:
            return F.array("_t")
        starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice("_w", i, F.lit(n)), " "), F.lit(" ")))

    def grams(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_run") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring("_run", i, n))

    split = F.split("_t", " ")
    cut = texts.select(*keys, padded.alias("_t")).withColumn("_w", F.slice(split, F.lit(2), F.size(split) - 2))
    every = F.flatten(F.array(*(F.transform(runs(n), lambda r: F.struct(F.lit(n).alias("_span"), r.alias("_run"))) for n in sizes)))
    cut = cut.select(*keys, F.explode(F.array_distinct(every)).alias("_r")).select(*keys, "_r.*")
    of_span = F.coalesce(*(F.when(F.col("_span") == n, F.flatten(F.transform(F.array(*map(F.lit, ns)), grams))) for n, ns in sizes.items()))
    known = cut.select("_span", "_run").distinct().withColumn("_gram", F.explode(F.array_distinct(of_span)))
    known = known.join(listed, ["_span", "_gram"]).groupBy("_span", "_run").agg(F.collect_set("_mark").alias("_marks"))
    known = checked_broadcast(cut_lineage(known, "rule-runs"))
    return cut.join(known, ["_span", "_run"]).groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("_marks"))).alias("words"))


def _mark(match: Column, word: Column) -> Column:
    return F.concat(match, F.lit(":"), F.lower(word))


def bit_arrays(entities: DataFrame, keys: list[str], lines: DataFrame) -> DataFrame:
    """``entities`` (keys, words, features, scope) with ``asks`` and ``shows``. ``lines`` are numbered rule lines.

    ``words`` come from ``words_of``, ``features`` are strings that the caller has read from the row. Null arrays are empty; a
    null scope matches no scope.
    """
    n = (lines.agg(F.max("bit").alias("n")).first()["n"] or 0) // WIDTH + 1
    place, value = F.expr(f"bit div {WIDTH}"), F.expr(f"shiftleft(1L, CAST(bit % {WIDTH} AS INT))")
    flips = {(r["side"], r["w"]): r["v"] for r in lines.where("negated").groupBy("side", place.alias("w")).agg(F.bit_or(value).alias("v")).collect()}
    empty = F.array().cast("array<string>")
    held = F.concat(F.coalesce("words", empty), F.transform(F.coalesce("features", empty), lambda f: F.concat(F.lit("feature:"), F.lower(f))), F.array(F.lit("")))
    # Lines are met by word and class, so that an entity does not meet the lines of all classes.
    scopes = F.array_compact(F.array(F.lit(""), F.when(F.col("scope").isNotNull(), F.lit("*")), F.concat(F.lit("="), "scope")))
    rows = entities.select(*keys, F.col("scope").alias("_own"), F.explode(held).alias("_mark"), scopes.alias("_scopes")).withColumn("_scope", F.explode("_scopes")).drop("_scopes")
    mark = F.when(F.col("word").isNull(), F.lit("")).otherwise(_mark(F.col("match"), F.col("word")))
    asked = F.when(F.col("scope").isNull(), F.lit("")).when(F.col("scope").endswith("*"), F.lit("*")).otherwise(F.concat(F.lit("="), "scope"))
    rows = rows.join(lines.withColumns({"_mark": mark, "_scope": asked}).select("_mark", "_scope", "side", "bit", F.col("scope").alias("_asked")), ["_mark", "_scope"])
    rows = rows.where((F.col("_scope") != "*") | F.col("_own").startswith(F.expr("left(_asked, length(_asked) - 1)")))
    words = rows.groupBy(*keys, "side", place.alias("w")).agg(F.bit_or(value).alias("v"))
    found = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("side", F.col("w").cast("string")), "v"))).alias("_bits"))

    def array(side: str) -> Column:
        flip = F.array(*(F.lit(flips.get((side, w), 0)).cast("bigint") for w in range(n)))
        return F.transform(flip, lambda x, w: F.coalesce(F.col("_bits")[F.concat(F.lit(side), w.cast("string"))], F.lit(0).cast("bigint")).bitwiseXOR(x))

    return entities.join(found, keys, "left").withColumns({"asks": array("ask"), "shows": array("show")}).drop("_bits")


def marks_of(words: Column, features: Column, scope: Column) -> Column:
    """A key that entities share if their words, features and scope are the same, so that their bits are worked out once."""
    empty = F.array().cast("array<string>")
    return F.sha2(F.to_json(F.struct(F.array_sort(F.coalesce(words, empty)), F.array_sort(F.coalesce(features, empty)), scope)), 256)


def live_bits(bits: DataFrame) -> Column:
    """Array of the bits that some row of ``bits`` asks and some row shows; no other bit refuses a pair."""
    ors = [bits.select(F.posexplode(side).alias("w", "v")).groupBy("w").agg(F.bit_or("v").alias(side)) for side in ("asks", "shows")]
    live = {r["w"]: r["asks"] & r["shows"] for r in ors[0].join(ors[1], "w").collect()}
    return F.array(*(F.lit(live[w]).cast("bigint") for w in sorted(live))).cast("array<bigint>")


def first_bit(asks: Column, shows: Column, n: int | None = None) -> Column:
    """Number of the first rule that refuses the pair; null if none does. ``n``: the length of the arrays, which saves the folds."""
    if n:
        each = (F.get(asks, F.lit(w)).bitwiseAND(F.get(shows, F.lit(w))) for w in range(n))
        return F.coalesce(*(F.when(v != 0, F.lit(w * WIDTH) + F.bit_count(v.bitwiseAND(-v) - 1)) for w, v in enumerate(each))).cast("int")
    both = F.zip_with(asks, shows, lambda a, b: a.bitwiseAND(b))
    found = F.transform(both, lambda v, w: F.when(v != 0, w * WIDTH + F.bit_count(v.bitwiseAND(-v) - 1)))
    return F.get(F.array_compact(found), F.lit(0)).cast("int")
