"""Match guards from rule tables: what each guard refuses, how often rules apply, and the audit of all offers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.functions import guard_words as W
from offerloom.operators.cells import key_of, top_k
from offerloom.operators.rulebits import RULE_SCHEMA, bit_arrays, first_bit, live_bits, marks_of, numbered, words_of
from offerloom.plans import derive as d
from offerloom.plans.catalog import sellable
from offerloom.session import cut_lineage, fresh_dir
from offerloom.sources.feeds import read_dictionary

#: Reasons in the order in which guards are tried.
REASONS = [
    "CATEGORY_MISMATCH", "TOKEN_CONFLICT", "MODIFIER_MISMATCH", "CROSS_FORBIDDEN", "ATTRIBUTE_CONFLICT", "SHARED_WORD_MISSING", "ANCHOR_MISSING",
    "FORBIDDEN_WORD", "FAT_MISMATCH", "GRADE_MISMATCH", "SIZE_MISMATCH", "PRICE_TOO_LOW",
]
GROUPS = ("seafood", "meat")
FLOOR_SHARE = 0.5
PREMIUM_RATIO = 5.0
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
SCHEMA = T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split(" ") for c in RULE_SCHEMA.split(", "))])

Line = tuple[str, int, str, str, bool, str, str | None, str | None]


def pair_rule(name: str, reason: str, ask: Sequence[tuple], show: Sequence[tuple], ask_not: bool = False, show_not: bool = False) -> list[Line]:
    """Lines of one rule; ``ask`` and ``show`` hold (match, word, scope)."""
    sides = (("ask", ask_not, ask), ("show", show_not, show))
    return [(name, REASONS.index(reason), reason, side, negated, match, word, scope) for side, negated, lines in sides for match, word, scope in lines]


def opposite_rules(pairs: Sequence[tuple[str, str]]) -> list[Line]:
    return [x for a, b in pairs for x in pair_rule(f"opposite {a} / {b}", "ATTRIBUTE_CONFLICT", [("part", a, None)], [("part", b, None)])]


def conflict_rules(conflicts: Sequence[tuple[str, Sequence[str]]]) -> list[Line]:
    return [x for a, bad in conflicts for x in pair_rule(f"conflict {a}", "TOKEN_CONFLICT", [("token", a, None)], [("token", b, None) for b in bad])]


def modifier_rules(words: Sequence[str]) -> list[Line]:
    """Both sides hold the word or neither."""
    out = []
    for w in words:
        has = [("part", w, None)]
        out += pair_rule(f"modifier {w}", "MODIFIER_MISMATCH", has, has, show_not=True)
        out += pair_rule(f"modifier not {w}", "MODIFIER_MISMATCH", has, has, ask_not=True)
    return out


def class_rules(reason: str, words: Mapping[str, Sequence[str]], missing: bool = False) -> list[Line]:
    """For references of a class: candidates that hold one of its words, or (``missing``) none of them."""
    return [x for c, ws in words.items() for x in pair_rule(f"{reason.lower()} {c}", reason, [("part", None, c)], [("part", w, None) for w in ws], show_not=missing)]


def shared_rules(words: Sequence[str], scopes: Sequence[str]) -> list[Line]:
    """A word of a reference in one of the classes must stand in the candidate too."""
    return [x for w in words for x in pair_rule(f"shared {w} {scopes[0]}", "SHARED_WORD_MISSING", [("part", w, s) for s in scopes], [("part", w, None)], show_not=True)]


def group_rules(words: Mapping[str, Sequence[str]]) -> list[Line]:
    """References of a group (feature ``group=``) refuse candidates with a word of another group."""
    pairs = [(a, b) for a in words for b in words if a != b]
    return [x for a, b in pairs for x in pair_rule(f"group {a} / {b}", "CATEGORY_MISMATCH", [("feature", f"group={a}", None)], [("part", w, None) for w in words[b]])]


def floor_rules(floors: Mapping[str, float]) -> list[Line]:
    return [x for c in floors for x in pair_rule(f"floor {c}", "PRICE_TOO_LOW", [("feature", f"class={c}", None)], [("feature", f"under={c}", None)])]


def fixed_rules() -> list[Line]:
    """The rules whose tables ship with the library; longer ones come from a file of the same columns."""
    return [
        *group_rules({"seafood": W.SEAFOOD_WORDS, "meat": W.MEAT_WORDS}),
        *conflict_rules(W.TOKEN_CONFLICTS),
        *modifier_rules(W.MODIFIERS),
        *class_rules("CROSS_FORBIDDEN", W.CROSS_WORDS),
        *opposite_rules(W.ATTRIBUTE_PAIRS),
        *shared_rules(W.SHARED_WORDS, W.SHARED_SCOPES),
        *shared_rules(W.SHARED_MEAT_WORDS, ["meat.beef"]),
        *class_rules("ANCHOR_MISSING", W.ANCHOR_WORDS, missing=True),
        *class_rules("FORBIDDEN_WORD", W.FORBIDDEN_WORDS),
        *floor_rules(W.PRICE_FLOORS),
    ]


def exact_rules(entities: DataFrame) -> DataFrame:
    """Rules for the attributes that must agree exactly (fat, grade, size): one per value that the names hold."""
    reasons = {"fat": "FAT_MISMATCH", "grade": "GRADE_MISMATCH", "size": "SIZE_MISMATCH"}
    values = entities.select(F.explode("features").alias("word")).distinct().withColumn("_kind", F.substring_index("word", "=", 1))
    values = values.where(F.col("_kind").isin(*reasons))
    reason = F.coalesce(*(F.when(F.col("_kind") == k, r) for k, r in reasons.items()))
    priority = F.coalesce(*(F.when(F.col("_kind") == k, REASONS.index(r)) for k, r in reasons.items()))
    sides = F.explode(F.array(F.lit("ask"), F.lit("show")))
    lines = values.select(F.concat(F.lit("exact "), "word").alias("rule_id"), priority.cast("int").alias("priority"), reason.alias("reason"), sides.alias("side"), "word")
    return lines.select("rule_id", "priority", "reason", "side", (F.col("side") == "show").alias("negated"), F.lit("feature").alias("match"), "word", F.lit(None).cast("string").alias("scope"))


def write_rules(rules: DataFrame, path: str) -> None:
    """A rule table as CSV with a header."""
    rules.select(*SCHEMA.names).coalesce(1).write.option("header", True).csv(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_dictionary(spark, path, SCHEMA)


def exact_features(name: Column, grades: Sequence[str]) -> list[Column]:
    fat = F.regexp_extract(name, r"(\d+[,.]?\d*)\s*%", 1)
    size = F.regexp_extract(name, r"(\d+/\d+)", 1)
    grade = F.coalesce(*(F.when(F.lower(name).contains(g), F.lit(g)) for g in grades), F.lit(""))
    found = {"fat": F.replace(fat, F.lit(","), F.lit(".")), "size": size, "grade": grade}
    return [F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in found.items()]


def compiled(offers: DataFrame, rules: DataFrame, groups: Mapping[str, Sequence[str]], floors: Mapping[str, float], grades: Sequence[str] = (), more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Offers with ``asks``, ``shows`` and the cells of both, and the numbered rule lines; both stored. ``more`` names columns to keep.

    Bits are worked out once for each distinct (class, name, floors that the price is under). A null class or name takes part
    with what is known of it; a null price is under no floor.
    """
    under = F.array_compact(F.array(*(F.when(F.col("price") < FLOOR_SHARE * v, F.lit(f"under={c}")) for c, v in floors.items()), F.lit(None).cast("string")))
    o = offers.select("offer_id", "price", "active", "unit_type", "super_class", "name_raw", "noun", *more, under.alias("under"))
    o = cut_lineage(o.withColumn("entity", F.xxhash64(key_of("super_class", "name_raw", F.array_join("under", "|")))), "guard-offers")
    entities = o.groupBy("entity").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("super_class", "name_raw", "under")))
    entities = entities.withColumn("features", F.array_compact(F.concat("under", F.array(*exact_features(F.col("name_raw"), grades), F.concat(F.lit("class="), "super_class")))))
    entities = cut_lineage(entities, "guard-entities")
    lines = cut_lineage(numbered(rules.unionByName(exact_rules(entities))), "guard-rules")
    words = words_of(entities.select("name_raw").distinct(), "name_raw", ["name_raw"], lines)
    entities = entities.join(words, "name_raw", "left")
    known = {g: F.coalesce(F.col("super_class").startswith(g), F.lit(False)) for g in groups}
    named = ~F.greatest(*known.values())
    member = [
        F.when(known[g] | (named & F.coalesce(F.arrays_overlap("words", F.array(*(F.lit(f"part:{w.lower()}") for w in ws))), F.lit(False))), F.lit(f"group={g}"))
        for g, ws in groups.items()
    ]
    entities = entities.withColumn("features", F.array_compact(F.concat("features", F.array(*member)))).withColumn("scope", F.col("super_class"))
    entities = entities.withColumn("marks", marks_of(F.col("words"), F.col("features"), F.col("scope")))
    entities = cut_lineage(entities.select("entity", "marks", "words", "features", "scope"), "guard-marks")
    sets = entities.groupBy("marks").agg(*(F.any_value(c).alias(c) for c in ("words", "features", "scope")))
    bits = cut_lineage(bit_arrays(sets, ["marks"], lines).select("marks", "asks", "shows"), "guard-bits")
    # Offers that differ only in bits that refuse no pair are one cell.
    live = live_bits(bits)
    texts = {f"_{side}": F.array_join(F.zip_with(side, live, lambda x, y: x.bitwiseAND(y)), ",") for side in ("asks", "shows")}
    bits = cut_lineage(entities.select("entity", "marks").join(bits.withColumns(texts), "marks").drop("marks"), "entity-bits")
    o = o.drop("under").join(bits, "entity").withColumns({side: F.concat_ws("|", F.coalesce("noun", F.lit("")), bit) for side, bit in (("ask_cell", "_asks"), ("show_cell", "_shows"))})
    return cut_lineage(o.drop("_asks", "_shows"), "guard-cells"), lines


def width(o: DataFrame) -> int | None:
    """Length of the bit arrays, the same in all rows."""
    one = o.select(F.size("asks").alias("n")).first()
    return one["n"] if one else None


def cell_pairs(o: DataFrame) -> DataFrame:
    """(ask_cell, show_cell, n candidates, bit of the first rule that refuses them, or null), between distinct live bits of a noun."""
    refs = o.groupBy("noun", "ask_cell").agg(F.any_value("asks").alias("asks"))
    cands = sellable(o).groupBy("noun", "show_cell").agg(F.any_value("shows").alias("shows"), F.count("*").alias("n"))
    # Few bytes, but much work: dealt to all tasks.
    tasks = int(o.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs, cands = cut_lineage(refs, "ask-cells").repartition(tasks, "ask_cell"), cut_lineage(cands, "show-cells")
    # Exploded, so that the bit is worked out once a pair.
    return refs.join(cands, "noun").select("ask_cell", "show_cell", "n", F.explode(F.array(first_bit(F.col("asks"), F.col("shows"), width(o)))).alias("bit"))


def reasons_of(lines: DataFrame) -> DataFrame:
    return lines.select("bit", "reason").distinct()


def guard_counts(o: DataFrame, lines: DataFrame) -> DataFrame:
    """Per reference: candidates of the same noun that each guard stopped, the reference itself left out."""
    refused = cell_pairs(o).where("bit is not null").join(reasons_of(lines), "bit")
    per = refused.groupBy("ask_cell", "reason").agg(F.sum("n").alias("n"))
    own = reasons_of(lines).withColumnRenamed("reason", "own_reason").withColumnRenamed("bit", "own_bit")
    rows = o.withColumn("own_bit", first_bit(F.col("asks"), F.col("shows"), width(o))).join(own, "own_bit", "left").join(per, "ask_cell")
    mine = F.when((F.col("own_reason") == F.col("reason")) & F.col("active") & (F.col("price") > 0) & F.col("unit_type").isNotNull(), 1).otherwise(0)
    return rows.withColumn("n", F.col("n") - mine).where("n > 0").select(F.col("offer_id").alias("ref_id"), "reason", "n")


def guarded_best(o: DataFrame, k: int = 2) -> DataFrame:
    """Per ask_cell the ``k`` cheapest offers past all guards, as an array of (rank, offer_id, price)."""
    cheap = top_k(sellable(o).select("show_cell", "offer_id", "price"), ["show_cell"], [F.col("price"), F.col("offer_id")], k, "_r")
    passed = cell_pairs(o).where("bit is null").select("ask_cell", "show_cell")
    best = top_k(passed.join(cheap, "show_cell"), ["ask_cell"], [F.col("price"), F.col("offer_id")], k)
    return best.groupBy("ask_cell").agg(F.array_sort(F.collect_list(F.struct("rank", "offer_id", "price"))).alias("best"))


def match_audit(o: DataFrame) -> DataFrame:
    """Every offer as a reference: the cheapest other offer past all guards, and whether that match looks wrong."""
    rows = o.join(guarded_best(o), "ask_cell", "left").withColumn("m", F.get(F.filter("best", lambda x: x["offer_id"] != F.col("offer_id")), F.lit(0)))
    outcome = F.when(F.col("m").isNull(), "no_match").when(F.col("price") / F.col("m.price") > PREMIUM_RATIO, "suspicious_price").otherwise("ok")
    return rows.withColumn("outcome", outcome).groupBy("super_class", "outcome").agg(F.count("*").alias("n"), F.count("m").alias("n_matched"))


def rule_usage(o: DataFrame, lines: DataFrame) -> DataFrame:
    """Per rule: offers that ask by it as references, and live offers that show what it refuses."""
    rules = lines.select("bit", "rule_id", "reason").distinct()

    def bits(side: str) -> Column:
        every = F.flatten(F.transform(side, lambda v, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(61)), lambda k: F.getbit(v, k) == 1), lambda k: w * 62 + k)))
        return F.explode(every).alias("bit")

    asked = o.groupBy("asks").agg(F.count("*").alias("n")).select(bits("asks"), "n").groupBy("bit").agg(F.sum("n").alias("n_ask"))
    shown = sellable(o).groupBy("shows").agg(F.count("*").alias("n")).select(bits("shows"), "n").groupBy("bit").agg(F.sum("n").alias("n_show"))
    return rules.join(asked, "bit", "left").join(shown, "bit", "left").na.fill(0, ["n_ask", "n_show"]).drop("bit")


# ---------------------------------------------------------------------------------------------
# English stand-ins for the derived names.

TEST_GROUPS = {"seafood": ["headless", "breaded"], "meat": ["steak", "soy"]}
TEST_FLOORS = {"seafood": 2400.0, "meat": 2200.0, "spice": 1900.0}
TEST_OPPOSITES = [("fillet", "whole"), ("steak", "fillet"), ("skinless", "skin on"), ("skin on", "skinless"), ("frozen", "chilled")]
TEST_CONFLICTS = [("mango", ["vanilla", "lemon"]), ("sauce", ["soy", "condensed"])]
TEST_MODIFIERS = ["smoked", "vanilla"]
TEST_FORBIDDEN = {"dairy": ["condensed"], "spice": ["chilled"]}
TEST_CROSS = {"seafood": ["sauce"], "packaging": ["lemon", "mango"]}
TEST_ANCHORS = {"sauce": ["sauce", "lemon", "chilled", "kg", "pcs"]}
TEST_SHARED = (["lemon", "steak"], ["other", "packaging"])
TEST_GRADES = ["condensed", "soy"]


def test_rules() -> list[Line]:
    return [
        *group_rules(TEST_GROUPS), *conflict_rules(TEST_CONFLICTS), *modifier_rules(TEST_MODIFIERS), *class_rules("CROSS_FORBIDDEN", TEST_CROSS),
        *opposite_rules(TEST_OPPOSITES), *shared_rules(*TEST_SHARED), *class_rules("ANCHOR_MISSING", TEST_ANCHORS, missing=True),
        *class_rules("FORBIDDEN_WORD", TEST_FORBIDDEN), *floor_rules(TEST_FLOORS),
    ]


test_rules.__test__ = False


def _compiled(spark: SparkSession, sf: str, more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The derived offers under the fixed rules and the stand-ins, which pass through a CSV file as a user's own would."""
    path = fresh_dir(spark, "rules-csv")
    write_rules(spark.createDataFrame([*fixed_rules(), *test_rules()], SCHEMA), path)
    offers = d.offers(spark, sf).withColumn("noun", F.element_at(F.split("product_core_id", r"\."), 2))
    groups = {g: [*w, *TEST_GROUPS[g]] for g, w in (("seafood", W.SEAFOOD_WORDS), ("meat", W.MEAT_WORDS))}
    return compiled(offers, read_rules(spark, path), groups, {**W.PRICE_FLOORS, **TEST_FLOORS}, TEST_GRADES, more)


def q_guards(spark: SparkSession, sf: str) -> DataFrame:
    return guard_counts(*_compiled(spark, sf))


def q_match_audit(spark: SparkSession, sf: str) -> DataFrame:
    return match_audit(_compiled(spark, sf)[0])


def q_guard_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Use of every rule, written as CSV and read back."""
    path = fresh_dir(spark, "rule-usage-csv")
    usage = rule_usage(*_compiled(spark, sf))
    usage.coalesce(1).write.option("header", True).csv(path)
    return spark.read.schema(usage.schema).option("header", True).csv(path)


QUERIES = {"guard_conflicts": q_guards, "match_audit": q_match_audit, "guard_rules": q_guard_rules}


def _has(side: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({side}.low, '{w}')" for w in words) + ")"


def _token(side: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({side}.pad, ' {w} ')" for w in words) + ")"


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


_WORDS = {g: [*w, *TEST_GROUPS[g]] for g, w in (("seafood", W.SEAFOOD_WORDS), ("meat", W.MEAT_WORDS))}
_OTHER = {"seafood": "meat", "meat": "seafood"}
_FLOORS = {**W.PRICE_FLOORS, **TEST_FLOORS}
_GROUP_SQL = _any([f"(a.is_{g} AND {_has('b', [*W_, *TEST_GROUPS[_OTHER[g]]])})" for g, W_ in (("seafood", W.MEAT_WORDS), ("meat", W.SEAFOOD_WORDS))])
# The stand-in groups are rules of their own, so a reference of a group refuses the words of both tables.
_CASES = {
    "CATEGORY_MISMATCH": _GROUP_SQL,
    "TOKEN_CONFLICT": _any([f"({_token('a', [x])} AND {_token('b', ys)})" for x, ys in [*W.TOKEN_CONFLICTS, *TEST_CONFLICTS]]),
    "MODIFIER_MISMATCH": _any([f"{_has('a', [w])} <> {_has('b', [w])}" for w in [*W.MODIFIERS, *TEST_MODIFIERS]]),
    "CROSS_FORBIDDEN": _any([f"(coalesce(a.super_class = '{c}', false) AND {_has('b', ws)})" for c, ws in TEST_CROSS.items()]),
    "ATTRIBUTE_CONFLICT": _any([f"({_has('a', [x])} AND {_has('b', [y])})" for x, y in [*W.ATTRIBUTE_PAIRS, *TEST_OPPOSITES]]),
    "SHARED_WORD_MISSING": _any([f"(a.super_class IN ('other', 'packaging') AND {_has('a', [w])} AND NOT {_has('b', [w])})" for w in TEST_SHARED[0]]
                                + [f"(a.super_class = 'other' AND {_has('a', [w])} AND NOT {_has('b', [w])})" for w in W.SHARED_WORDS]),
    "ANCHOR_MISSING": _any([f"(a.super_class = '{c}' AND NOT {_has('b', ws)})" for c, ws in TEST_ANCHORS.items()]),
    "FORBIDDEN_WORD": _any([f"(a.super_class = '{c}' AND {_has('b', ws)})" for c, ws in TEST_FORBIDDEN.items()]),
    "FAT_MISMATCH": "(a.fat IS NOT NULL AND a.fat IS DISTINCT FROM b.fat)",
    "GRADE_MISMATCH": "(a.grade IS NOT NULL AND a.grade IS DISTINCT FROM b.grade)",
    "SIZE_MISMATCH": "(a.size IS NOT NULL AND a.size IS DISTINCT FROM b.size)",
}
_CASE = "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in _CASES.items()) + " END"
_FLOOR = "CASE a.super_class " + " ".join(f"WHEN '{c}' THEN {FLOOR_SHARE * v}" for c, v in _FLOORS.items()) + " END"
_GRADE = "CASE " + " ".join(f"WHEN contains(low, '{g}') THEN '{g}'" for g in TEST_GRADES) + " END"
_GUARD = rf"""WITH {d.CTE_OFFERS}
 , itm AS MATERIALIZED (SELECT *, super_class LIKE 'seafood%' OR (super_class NOT LIKE 'meat%' AND {_any([f"contains(low, '{w}')" for w in _WORDS['seafood']])}) AS is_seafood,
       super_class LIKE 'meat%' OR (super_class NOT LIKE 'seafood%' AND {_any([f"contains(low, '{w}')" for w in _WORDS['meat']])}) AS is_meat,
       replace(nullif(regexp_extract(name_raw, '(\d+[,.]?\d*)\s*%', 1), ''), ',', '.') AS fat, nullif(regexp_extract(name_raw, '(\d+/\d+)', 1), '') AS size, {_GRADE} AS grade
     FROM (SELECT DISTINCT p_partkey AS l_partkey, split_part(product_core_id, '.', 2) AS noun, super_class, name_raw, lower(name_raw) AS low, ' ' || lower(replace(name_raw, '#', ' ')) || ' ' AS pad FROM items))
 , fl AS MATERIALIZED (SELECT l_partkey, price, offer_id, active FROM offers)
 , pc AS MATERIALIZED (SELECT a.l_partkey AS ap, b.l_partkey AS bp, {_CASE} AS r, {_FLOOR} AS floor FROM itm a JOIN itm b ON a.noun = b.noun)
 , own AS (SELECT ap, r AS own, floor FROM pc WHERE ap = bp)"""

ORACLE = {
    "guard_conflicts": _GUARD + """
      , cnt AS (SELECT ap, coalesce(r, CASE WHEN price < floor THEN 'PRICE_TOO_LOW' END) AS reason, count(*) AS n FROM pc JOIN fl ON bp = l_partkey WHERE active GROUP BY 1, 2)
      , ref AS (SELECT offer_id AS ref_id, l_partkey, active, coalesce(own, CASE WHEN price < floor THEN 'PRICE_TOO_LOW' END) AS own FROM fl JOIN own ON ap = l_partkey)
      SELECT ref_id, reason, CAST(n - CASE WHEN active AND coalesce(reason = own, false) THEN 1 ELSE 0 END AS BIGINT) AS n
      FROM ref JOIN cnt ON ap = l_partkey WHERE reason IS NOT NULL AND n - CASE WHEN active AND coalesce(reason = own, false) THEN 1 ELSE 0 END > 0""",
    "match_audit": _GUARD + f"""
      , ok AS (SELECT ap, offer_id, price, row_number() OVER (PARTITION BY ap ORDER BY price, offer_id) AS rn FROM pc JOIN fl ON bp = l_partkey WHERE active AND r IS NULL AND NOT coalesce(price < floor, false))
      , two AS (SELECT ap, max(CASE WHEN rn = 1 THEN offer_id END) AS b1, max(CASE WHEN rn = 1 THEN price END) AS p1, max(CASE WHEN rn = 2 THEN price END) AS p2 FROM ok WHERE rn <= 2 GROUP BY 1)
      , m AS (SELECT super_class, price, CASE WHEN b1 = offer_id THEN p2 ELSE p1 END AS mp FROM offers LEFT JOIN two ON ap = l_partkey)
      SELECT super_class, CASE WHEN mp IS NULL THEN 'no_match' WHEN price / mp > {PREMIUM_RATIO} THEN 'suspicious_price' ELSE 'ok' END AS outcome, count(*) AS n, count(mp) AS n_matched FROM m GROUP BY 1, 2""",
}


def _line_sql(match: str, word: str | None, scope: str | None) -> str:
    """One line of a rule on a row with low, pad, the groups, super_class and price."""
    if match == "feature":
        kind, value = word.split("=", 1)
        return {"group": f"is_{value}", "class": f"super_class = '{value}'", "under": f"price < {FLOOR_SHARE * _FLOORS.get(value, 0.0)}"}[kind]
    tests = [] if word is None else [f"contains(pad, ' {word} ')" if match == "token" else f"contains(low, '{word}')"]
    tests += [] if scope is None else [f"super_class LIKE '{scope[:-1]}%'" if scope.endswith("*") else f"super_class = '{scope}'"]
    return "(" + " AND ".join(tests) + ")"


def _usage_sql() -> str:
    rules: dict[tuple[str, str], dict[str, list]] = {}
    for name, _, reason, side, negated, match, word, scope in [*fixed_rules(), *test_rules()]:
        rules.setdefault((name, reason), {}).setdefault(side, [negated]).append(_line_sql(match, word, scope))
    side = lambda lines: ("NOT " if lines[0] else "") + "coalesce(" + _any(list(dict.fromkeys(lines[1:]))) + ", false)"
    counts = [
        f"SELECT '{name}' AS rule_id, '{reason}' AS reason, count(*) FILTER (WHERE {side(s['ask'])}) AS n_ask, count(*) FILTER (WHERE active AND {side(s['show'])}) AS n_show FROM r"
        for (name, reason), s in rules.items()
    ]
    for kind, reason in (("fat", "FAT_MISMATCH"), ("grade", "GRADE_MISMATCH"), ("size", "SIZE_MISMATCH")):
        counts.append(f"SELECT 'exact {kind}=' || v, '{reason}', (SELECT count(*) FROM r WHERE {kind} = v), (SELECT count(*) FROM r WHERE active AND {kind} IS DISTINCT FROM v) FROM (SELECT DISTINCT {kind} AS v FROM itm WHERE {kind} IS NOT NULL)")
    return _GUARD + "\n, r AS MATERIALIZED (SELECT itm.*, fl.price, fl.active FROM fl JOIN itm USING (l_partkey))\n" + "\nUNION ALL ".join(counts)


ORACLE["guard_rules"] = _usage_sql()
