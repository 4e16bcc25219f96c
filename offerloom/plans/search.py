"""Catalogue search for many queries at once: token index, lemma, synonym and prefix matches, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.text import lemmas, query_words, search_tokens, short_stem
from offerloom.operators.cells import top_k
from offerloom.operators.trigrams import gram_index, match_any_parts, match_parts
from offerloom.plans import derive as d
from offerloom.plans.catalog import sellable
from offerloom.session import cut_lineage

PAGE = 20
PREFIX_BONUS = 0.3
# Synonym groups of the derived tables; the first word is the canonical one.
SYNONYMS = [["red", "crimson", "scarlet"], ["ring", "loop"], ["gizmo", "gadget"], ["small", "little", "tiny"]]


def name_index(names: DataFrame, words: Column) -> DataFrame:
    """(token, name) rows of the distinct names."""
    return names.select("name", F.explode(words).alias("token"))


def name_words(name: Column) -> Column:
    return F.array_distinct(query_words(name))


def match_all(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, name) where the name holds every token of the query. ``queries``: query_id, tokens.

    The index grows with the names and is estimated by their files, far too low, so it is never broadcast.
    """
    asked = queries.select("query_id", F.size(F.array_distinct("tokens")).alias("n_tokens"), F.explode(F.array_distinct("tokens")).alias("token"))
    return (
        asked.join(index.hint("merge"), "token")
        .groupBy("query_id", "name", "n_tokens")
        .agg(F.count("*").alias("n_hit"))
        .filter(F.col("n_hit") == F.col("n_tokens"))
        .select("query_id", "name")
    )


def match_prefix(prefixes: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, name) where a word of the name starts with the query's prefix. ``prefixes``: query_id, prefix.

    Every word of the vocabulary is cut to all its starts, so this stays an equi-join.
    """
    vocabulary = index.select("token").distinct()
    starts = vocabulary.select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("n"))
    starts = starts.select("token", F.col("token").substr(F.lit(1), F.col("n")).alias("prefix"))
    return prefixes.join(starts.hint("merge"), "prefix").join(index.hint("merge"), "token").select("query_id", "name").distinct()


def expand_synonyms(queries: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Tokens replaced by the canonical word of their group."""
    table = queries.sparkSession.createDataFrame([(w, g[0]) for g in groups for w in g], "token string, canonical string")
    flat = queries.select("query_id", F.explode("tokens").alias("token")).join(F.broadcast(table), "token", "left")
    return flat.groupBy("query_id").agg(F.collect_set(F.coalesce("canonical", "token")).alias("tokens"))


SHORTEST_PREFIX, SHORTEST_SYNONYM = 3, 4


def synonym_table(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """word, words of its group, and its place in the dictionary; a word in several groups is of the last and keeps its first place."""
    rows: dict[str, tuple[list[str], int]] = {}
    for group in groups:
        for word in group:
            rows[word.lower()] = ([w.lower() for w in group], rows[word.lower()][1] if word.lower() in rows else len(rows))
    return spark.createDataFrame([(w, g, k) for w, (g, k) in rows.items()], "word string, words array<string>, ord int")


def synonym_choices(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id, choices: for each token the texts that may stand for it.

    A token's group is that of the same word, else of the first word in the dictionary that the token starts or that starts the
    token, with three letters at least. Synonyms of four letters and more count, and the token itself from three letters on.
    """
    tokens = queries.select(F.explode("tokens").alias("token")).distinct().where("token is not null")
    exact = tokens.join(synonyms.withColumnRenamed("word", "token"), "token").select("token", F.lit(0).alias("tier"), "ord", "words")
    cuts = lambda c: F.transform(F.sequence(F.lit(SHORTEST_PREFIX), F.greatest(F.length(c), F.lit(SHORTEST_PREFIX))), lambda n: F.substring(c, F.lit(1), n))
    starts = synonyms.where(F.length("word") >= SHORTEST_PREFIX).select(F.explode(cuts(F.col("word"))).alias("token"), "ord", "words")
    typed = tokens.join(starts, "token").select("token", F.lit(1).alias("tier"), "ord", "words")
    longer = tokens.where(F.length("token") >= SHORTEST_PREFIX).select("token", F.explode(cuts(F.col("token"))).alias("word")).join(synonyms, "word")
    found = exact.unionByName(typed).unionByName(longer.select("token", F.lit(1).alias("tier"), "ord", "words"))
    group = found.groupBy("token").agg(F.min_by("words", F.struct("tier", "ord")).alias("words"))
    known = F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.length(w) >= SHORTEST_SYNONYM)
    own = F.when(F.length("token") >= SHORTEST_PREFIX, F.array("token")).otherwise(F.array().cast("array<string>"))
    texts = tokens.join(group, "token", "left").select("token", F.array_distinct(F.concat(known, own)).alias("texts"))
    spread = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).join(texts, "token")
    return spread.groupBy("query_id").agg(F.collect_list("texts").alias("choices"))


def complete(token: Column) -> Column:
    """A word the user has finished: six letters, or five whose stem is shorter."""
    return (F.length(token) >= 6) | ((F.length(token) >= 5) & (short_stem(token) != token))


def search(queries: DataFrame, names: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(query_id, name) by the plan of each query.

    One word: lemma match when it is complete, and in any case word-start match. Several words: all lemmas, all
    words or their synonyms as parts of the name, or all words as parts in any order; with an unfinished last word, also the other lemmas plus its prefix.
    """
    # Both are read by every branch below, so they are written once.
    q = queries.withColumn("tokens", query_words(F.col("query"))).filter(F.size("tokens") > 0)
    q = q.withColumns({"last": F.element_at("tokens", -1), "n": F.size("tokens"), "lemma": lemmas(F.col("tokens"))})
    q = cut_lineage(q.withColumn("done", complete(F.col("last"))), "search-queries")
    words = cut_lineage(name_index(names, name_words(F.col("name"))), "search-words")
    stems = words.select("name", short_stem(F.col("token")).alias("token")).distinct()
    grams = gram_index(names)

    one, many = q.filter("n = 1"), q.filter("n > 1")
    by_lemma = match_all(q.filter("n > 1 OR done").select("query_id", F.col("lemma").alias("tokens")), stems)
    by_start = match_prefix(one.select("query_id", F.col("last").alias("prefix")), words)
    by_synonym = match_any_parts(synonym_choices(many, synonym_table(names.sparkSession, groups)), grams)
    by_part = match_parts(many.select("query_id", "tokens"), grams)
    open_end = many.filter("NOT done").withColumn("head", lemmas(F.slice("tokens", 1, F.size("tokens") - 1)))
    by_head = match_all(open_end.select("query_id", F.col("head").alias("tokens")), stems)
    by_tail = match_prefix(open_end.select("query_id", F.col("last").alias("prefix")), words)
    found = by_lemma.unionByName(by_start).unionByName(by_synonym).unionByName(by_part)
    return found.unionByName(by_head.join(by_tail, ["query_id", "name"])).distinct()


def rank_offers(found: DataFrame, offers: DataFrame, queries: DataFrame, page: int = PAGE) -> DataFrame:
    """First page per query: price, price per unit (unknown last), minimum total, score, name."""
    live = sellable(offers).select(
        F.col("name_raw").alias("name"), "offer_id", "price",
        F.when(F.col("unit_type") != "PIECE", F.col("price") / F.col("pack_value")).alias("ppu"),
        (F.col("price") * F.col("min_order_qty")).alias("min_total"),
    )
    per_name = [F.col("price"), F.col("ppu").asc_nulls_last(), F.col("min_total"), F.col("offer_id")]
    best = top_k(live, ["name"], per_name, page, "_r").drop("_r")
    scored = found.join(queries.select("query_id", lemmas(query_words(F.col("query"))).alias("ql"), F.element_at(query_words(F.col("query")), -1).alias("last")), "query_id")
    nl = lemmas(query_words(F.col("name")))
    share = F.size(F.array_intersect("ql", nl)) / F.size("ql")
    starts = F.exists(query_words(F.col("name")), lambda w: w.startswith(F.col("last")))
    bonus = F.when(starts, (F.size("ql") - PREFIX_BONUS) / F.size("ql")).otherwise(0.0)
    scored = scored.withColumn("score", F.greatest(share, bonus)).select("query_id", "name", "score")
    order = [F.col("price"), F.col("ppu").asc_nulls_last(), F.col("min_total"), F.desc("score"), F.col("name"), F.col("offer_id")]
    return top_k(scored.join(best, "name"), ["query_id"], order, page)


def query_brands(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Brands meant by each query: an alias as a word, else as two words, else as a prefix of the longest word that fits."""
    q = queries.withColumn("tokens", query_words(F.col("query")))
    pos = q.select("query_id", F.posexplode("tokens").alias("pos", "alias_norm"))
    exact = pos.join(aliases, "alias_norm").select("query_id", F.lit(1).alias("tier"), F.col("pos").alias("ord"), "alias_norm", "brand_id")
    pairs = q.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, 2), " "))).alias("pos", "alias_norm"))
    two = pairs.filter(F.col("alias_norm").contains(" ")).join(aliases, "alias_norm").select("query_id", F.lit(2).alias("tier"), F.col("pos").alias("ord"), "alias_norm", "brand_id")
    cuts = F.transform(F.sequence(F.lit(2), F.greatest(F.length("alias_norm"), F.lit(2))), lambda n: F.col("alias_norm").substr(F.lit(1), n))
    starts = aliases.select("brand_id", F.explode(F.array_distinct(cuts)).alias("prefix"))
    pre = pos.filter(F.length("alias_norm") >= 2).join(starts, F.col("alias_norm") == F.col("prefix"))
    pre = pre.select("query_id", F.lit(3).alias("tier"), (F.col("pos") - 1000 * F.length("prefix")).alias("ord"), F.col("prefix").alias("alias_norm"), "brand_id")
    every = exact.unionByName(two).unionByName(pre)
    best = every.groupBy("query_id").agg(F.min(F.struct("tier", "ord")).alias("m"))
    chosen = every.join(best, "query_id").filter((F.col("tier") == F.col("m.tier")) & (F.col("ord") == F.col("m.ord")))
    n = F.length("alias_norm")
    confidence = F.when(F.col("tier") < 3, 1.0).when(n >= 4, 0.9).when(n >= 3, 0.7).otherwise(0.5)
    return chosen.groupBy("query_id", "alias_norm", "tier").agg(F.array_join(F.array_sort(F.collect_set("brand_id")), ",").alias("brands")).withColumn(
        "confidence", confidence
    ).withColumn("use", F.when(F.col("confidence") >= 0.7, "filter").otherwise("boost"))


# ---------------------------------------------------------------------------------------------

# Queries of the derived tables: every item name's first words, in several shapes.
QUERY_SHAPES = """
  SELECT DISTINCT p_name || '#full' AS query_id, p_name AS query FROM part
  UNION SELECT DISTINCT p_name || '#open', left(p_name, length(p_name) - 2) FROM part
  UNION SELECT DISTINCT p_name || '#word', split_part(p_name, ' ', 2) FROM part
  UNION SELECT DISTINCT p_name || '#start', left(split_part(p_name, ' ', 2), 3) FROM part
  UNION SELECT DISTINCT p_name || '#syn', replace(replace(replace(p_name, 'red', 'crimson'), 'ring', 'loop'), 'small', 'tiny') FROM part
"""


# Words cut to their first four letters, and words with an ending.
CUT_QUERY = "replace(replace(replace(query, 'scarlet', 'scar'), 'crimson', 'crim'), 'ring', 'rings')"
# Pieces of words in another order than in the names, down to one letter.
PART_SHAPES = """
  SELECT DISTINCT p_name || '#mid' AS query_id, substr(split_part(p_name, ' ', 2), 2, 3) || ' ' || substr(p_name, 1, 2) AS query FROM part
  UNION SELECT DISTINCT p_brand || '#brand', substr(lower(p_brand), 3) || ' ' || substr(p_name, 2, 2) FROM part
  UNION SELECT DISTINCT p_size || '#size', p_size || 'kg ill' FROM part
  UNION SELECT DISTINCT substr(p_name, 1, 1) || '#letter', substr(p_name, 1, 1) || ' ' || substr(p_name, 3, 1) || ' zen' FROM part
  UNION SELECT DISTINCT p_name || '#none', p_name || ' qqq' FROM part
"""


def part_queries(spark: SparkSession, sf: str) -> DataFrame:
    d.table(spark, sf, "part").createOrReplaceTempView("_search_part")
    return spark.sql(PART_SHAPES.replace("FROM part", "FROM _search_part"))


def query_table(spark: SparkSession, sf: str) -> DataFrame:
    d.table(spark, sf, "part").createOrReplaceTempView("_search_part")
    return spark.sql(QUERY_SHAPES.replace("FROM part", "FROM _search_part"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return d.items(spark, sf).select(F.col("name_raw").alias("name")).distinct()


def q_token_index(spark: SparkSession, sf: str) -> DataFrame:
    """Token statistics of the offer index: names and offers behind every token."""
    it = d.items(spark, sf)
    tokens = search_tokens(F.col("name_raw"), F.col("brand_id"), F.col("super_class"), F.col("product_core_id"))
    n = d.offer_facts(spark, sf).groupBy("l_partkey").agg(F.count("*").alias("n"))
    return (
        it.join(n, F.col("p_partkey") == F.col("l_partkey"))
        .select("name_raw", "n", F.explode(tokens).alias("token"))
        .groupBy("token").agg(F.countDistinct("name_raw").alias("n_names"), F.sum("n").alias("n_offers"))
    )


def q_document_index(spark: SparkSession, sf: str) -> DataFrame:
    """Lemma index over the whole documents: documents and uses of every lemma."""
    stems = F.transform(query_words(F.col("text")), short_stem)
    return (
        d.table(spark, sf, "documents").select("doc_id", F.explode(stems).alias("lemma"))
        .groupBy("lemma").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_uses"))
    )


def q_lemma_search(spark: SparkSession, sf: str) -> DataFrame:
    stems = name_index(_names(spark, sf), lemmas(query_words(F.col("name"))))
    asked = query_table(spark, sf).select("query_id", lemmas(query_words(F.col("query"))).alias("tokens"))
    return match_all(asked, stems).groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


def q_synonym_search(spark: SparkSession, sf: str) -> DataFrame:
    canonical = F.create_map(*[F.lit(x) for g in SYNONYMS for w in g for x in (w, g[0])])
    words = name_index(_names(spark, sf), name_words(F.col("name")))
    canon = words.select("name", F.coalesce(F.element_at(canonical, F.col("token")), F.col("token")).alias("token")).distinct()
    asked = query_table(spark, sf).select("query_id", query_words(F.col("query")).alias("tokens"))
    found = match_all(expand_synonyms(asked, SYNONYMS), canon)
    return found.groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


def q_synonym_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold each word of a query or a synonym of it as a part; half of the words are typed in part or too long."""
    asked = query_table(spark, sf).unionByName(query_table(spark, sf).select(F.concat("query_id", F.lit("#cut")).alias("query_id"), F.expr(CUT_QUERY).alias("query")))
    choices = synonym_choices(asked.select("query_id", query_words(F.col("query")).alias("tokens")), synonym_table(spark, SYNONYMS))
    found = match_any_parts(choices, gram_index(_names(spark, sf)))
    return found.groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def q_prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    words = name_index(_names(spark, sf), name_words(F.col("name")))
    asked = query_table(spark, sf).select("query_id", F.element_at(query_words(F.col("query")), -1).alias("prefix"))
    found = match_prefix(asked, words)
    return found.groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


def q_substring_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold every word of a query as a part; the queries are pieces out of the middle of item names."""
    asked = part_queries(spark, sf).withColumn("tokens", F.split("query", " "))
    found = match_parts(asked, gram_index(_names(spark, sf)))
    return found.groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def q_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search(query_table(spark, sf), _names(spark, sf), SYNONYMS)
    return found.groupBy("query_id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def q_rank(spark: SparkSession, sf: str) -> DataFrame:
    q = query_table(spark, sf)
    found = search(q, _names(spark, sf), SYNONYMS)
    return rank_offers(found, d.offers(spark, sf), q).select("query_id", "rank", "offer_id", "price", F.round("score", 6).alias("score"))


def q_query_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Brands in queries built from item names: whole brand, two words, or the start of a brand."""
    from offerloom.plans.classify import _aliases

    p = d.table(spark, sf, "part").withColumn("b", F.regexp_replace(F.lower("p_brand"), "#", ""))
    shapes = F.array(
        F.concat_ws(" ", "p_name", "b"), F.concat_ws(" ", F.lit("cheap"), "p_name"), F.concat_ws(" ", "p_name", F.lit("br")),
        F.concat_ws(" ", F.lit("bran"), "p_name"),
    )
    q = p.select(F.explode(shapes).alias("query")).distinct().withColumn("query_id", F.col("query"))
    return query_brands(q, _aliases(spark, sf))


QUERIES = {
    "token_index": q_token_index,
    "document_lemma_index": q_document_index,
    "lemma_search": q_lemma_search,
    "synonym_search": q_synonym_search,
    "prefix_search": q_prefix_search,
    "synonym_parts": q_synonym_parts,
    "substring_search": q_substring_search,
    "catalog_search": q_search,
    "search_rank": q_rank,
    "query_brand_detect": q_query_brand,
}

from offerloom.functions.text import QUERY_STOPWORDS, SEARCH_STOPWORDS, SHORT_STEM_ENDINGS  # noqa: E402


def _duck_words(col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)
    return (
        rf"list_filter(list_concat(regexp_extract_all(regexp_replace(lower({col}), '\d+/\d+', ' ', 'g'), '[а-яёa-z0-9]+'),"
        rf" regexp_extract_all(lower({col}), '\d+/\d+')), lambda w: len(w) >= 2 AND w NOT IN ({stop}))"
    )


def _duck_stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with({w}, '{e}') AND len({w}) - {len(e)} >= 3 THEN left({w}, len({w}) - {len(e)})" for e in SHORT_STEM_ENDINGS)
    return f"CASE {cases} ELSE {w} END"


_Q = f"""q0 AS ({QUERY_SHAPES}), q AS (SELECT query_id, query, {_duck_words('query')} AS toks FROM q0)
 , nm AS (SELECT name, list_distinct({_duck_words('name')}) AS words FROM (SELECT DISTINCT name_raw AS name FROM items))
 , nw AS (SELECT name, unnest(words) AS w FROM nm), qw AS (SELECT query_id, len(list_distinct(toks)) AS n, toks[-1] AS last, unnest(list_distinct(toks)) AS w FROM q)"""
_SYN = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(chr(39) + w + chr(39) for w in g)}) THEN '{g[0]}'" for g in SYNONYMS) + " ELSE {0} END"
# Every token of the test names is Latin or a number, which no ending of the stem list fits, so stems equal words here.
_KEYS = ", ".join(f"('{w}', [{', '.join(chr(39) + x + chr(39) for x in g)}], {k})" for k, (w, g) in enumerate((w, g) for g in SYNONYMS for w in g))


def _duck_choices(tokens: str) -> str:
    """Tokens (query_id, w) of a table with the texts that may stand for each."""
    return f"""kv(word, words, ord) AS (VALUES {_KEYS}), tk AS (SELECT DISTINCT query_id, w FROM {tokens})
 , grp AS (SELECT w, arg_min(words, (CASE WHEN word = w THEN 0 ELSE 1 END, ord)) AS words FROM (SELECT DISTINCT w FROM tk) JOIN kv
     ON word = w OR (len(w) >= 3 AND starts_with(word, w)) OR (len(word) >= 3 AND starts_with(w, word)) GROUP BY 1)
 , alt AS (SELECT query_id, w, list_concat(list_filter(coalesce(words, []), lambda x: len(x) >= 4), CASE WHEN len(w) >= 3 THEN [w] ELSE [] END) AS alts FROM tk LEFT JOIN grp USING (w))
 , need AS (SELECT query_id, count(*) AS k FROM alt WHERE len(alts) > 0 GROUP BY 1)
 , hit AS (SELECT query_id, name, count(*) AS h FROM alt JOIN nm ON len(list_filter(alts, lambda x: contains(lower(name), x))) > 0 GROUP BY 1, 2)
 , syn_of AS (SELECT query_id, name FROM hit JOIN need USING (query_id) WHERE h = k)"""


_MATCH = f"""{_Q}
 , allw AS (SELECT query_id, name FROM qw JOIN nw USING (w) GROUP BY query_id, name, n HAVING count(*) = n)
 , syn AS (SELECT query_id, name FROM (SELECT DISTINCT query_id, {_SYN.format('w')} AS w FROM qw) a JOIN (SELECT DISTINCT name, {_SYN.format('w')} AS w FROM nw) b USING (w)
     JOIN (SELECT query_id, count(DISTINCT {_SYN.format('w')}) AS m FROM qw GROUP BY 1) USING (query_id) GROUP BY query_id, name, m HAVING count(*) = m)
 , pre AS (SELECT DISTINCT query_id, name FROM (SELECT DISTINCT query_id, last FROM qw) JOIN nw ON starts_with(w, last))"""
_SEARCH = f"""{_MATCH}
 , {_duck_choices('qw')}
 , meta AS (SELECT DISTINCT query_id, len(toks) AS n, toks[-1] AS last, len(toks[-1]) >= 6 AS done, toks FROM q WHERE len(toks) > 0)
 , part_of AS (SELECT query_id, name FROM meta, nm WHERE n > 1 AND len(list_filter(toks, lambda w: contains(lower(name), w))) = n)
 , head AS (SELECT query_id, name FROM (SELECT query_id, unnest(toks[1:n - 1]) AS w, n - 1 AS k FROM meta WHERE n > 1 AND NOT done) JOIN nw USING (w) GROUP BY query_id, name, k HAVING count(*) = k)
 , found AS (SELECT query_id, name FROM allw JOIN meta USING (query_id) WHERE meta.n > 1 OR done UNION SELECT query_id, name FROM pre JOIN meta USING (query_id) WHERE meta.n = 1
     UNION SELECT query_id, name FROM part_of
     UNION SELECT query_id, name FROM syn_of JOIN meta USING (query_id) WHERE meta.n > 1
     UNION SELECT query_id, name FROM head JOIN pre USING (query_id, name))"""
_AGG = "SELECT query_id, count(*) AS n_names, min(name) AS first_name FROM {} GROUP BY 1"
_SEARCH_STOP = ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS)


def _duck_tokens(col: str) -> str:
    return (
        rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({col}), '[^0-9a-zа-я_/\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),"
        rf" lambda w: regexp_full_match(w, '\d+(/\d+)?') OR (len(w) > 1 AND w NOT IN ({_SEARCH_STOP})))"
    )


ORACLE = {
    "token_index": f"""WITH {d.CTE_OFFERS}
      , t AS (SELECT name_raw, n, unnest(list_distinct(list_concat(list_concat({_duck_tokens('name_raw')}, {_duck_tokens("coalesce(brand_id, '')")}),
          list_concat(CASE WHEN brand_id IS NULL THEN [] ELSE [brand_id] END, list_concat([super_class], {_duck_tokens("replace(replace(product_core_id, '.', ' '), '_', ' ')")}))))) AS token
          FROM items JOIN (SELECT l_partkey, count(*) AS n FROM offers GROUP BY 1) ON l_partkey = p_partkey)
      SELECT token, count(DISTINCT name_raw) AS n_names, CAST(sum(n) AS BIGINT) AS n_offers FROM t WHERE token <> '' GROUP BY 1""",
    "document_lemma_index": f"""WITH w AS (SELECT doc_id, unnest({_duck_words('text')}) AS w FROM documents), s AS (SELECT doc_id, {_duck_stem('w')} AS lemma FROM w)
      SELECT lemma, count(DISTINCT doc_id) AS n_docs, count(*) AS n_uses FROM s GROUP BY 1""",
    "lemma_search": f"WITH {d.CTE_ITEMS}, {_MATCH} " + _AGG.format("allw"),
    "synonym_search": f"WITH {d.CTE_ITEMS}, {_MATCH} " + _AGG.format("syn"),
    "prefix_search": f"WITH {d.CTE_ITEMS}, {_MATCH} " + _AGG.format("pre"),
    "synonym_parts": f"""WITH {d.CTE_ITEMS}, q0 AS ({QUERY_SHAPES} UNION ALL SELECT query_id || '#cut', {CUT_QUERY} FROM ({QUERY_SHAPES}))
      , nm AS (SELECT DISTINCT name_raw AS name FROM items), qw AS (SELECT query_id, unnest({_duck_words('query')}) AS w FROM q0), {_duck_choices('qw')}
      SELECT query_id, count(*) AS n_names, min(name) AS first_name, max(name) AS last_name FROM syn_of GROUP BY 1""",
    "substring_search": f"""WITH {d.CTE_ITEMS}, q AS ({PART_SHAPES}), nm AS (SELECT DISTINCT name_raw AS name FROM items)
      SELECT query_id, count(*) AS n_names, min(name) AS first_name, max(name) AS last_name FROM q, nm
      WHERE len(list_filter(string_split(query, ' '), lambda w: NOT contains(lower(name), lower(w)))) = 0 GROUP BY 1""",
    "catalog_search": f"WITH {d.CTE_ITEMS}, {_SEARCH} SELECT query_id, count(*) AS n_names, min(name) AS first_name, max(name) AS last_name FROM found GROUP BY 1",
    "search_rank": f"""WITH {d.CTE_OFFERS}, {_SEARCH}
      , sc AS (SELECT f.query_id, f.name, greatest(len(list_intersect(list_distinct(q.toks), nm.words)) / len(list_distinct(q.toks)),
            CASE WHEN len(list_filter(nm.words, lambda x: starts_with(x, q.toks[-1]))) > 0 THEN (len(list_distinct(q.toks)) - 0.3) / len(list_distinct(q.toks)) ELSE 0 END) AS score
          FROM found f JOIN q USING (query_id) JOIN nm USING (name))
      , r AS (SELECT query_id, offer_id, price, score, row_number() OVER (PARTITION BY query_id ORDER BY price, CASE WHEN unit_type <> 'PIECE' THEN price / pack_value END NULLS LAST,
            price * min_order_qty, score DESC, name, offer_id) AS rank FROM sc JOIN offers ON name_raw = name WHERE active)
      SELECT query_id, CAST(rank AS INT) AS rank, offer_id, price, round(score, 6) AS score FROM r WHERE rank <= {PAGE}""",
    "query_brand_detect": """WITH p AS (SELECT DISTINCT p_name, replace(lower(p_brand), '#', '') AS b FROM part)
      , q AS (SELECT DISTINCT unnest([p_name || ' ' || b, 'cheap ' || p_name, p_name || ' br', 'bran ' || p_name]) AS query FROM p)
      , al AS (SELECT DISTINCT replace(lower(p_brand), '#', '') AS alias, lower(p_brand) AS brand FROM part UNION ALL SELECT 'blue plate', 'house_blue' UNION ALL SELECT 'cold rod', 'house_cold')
      , t AS (SELECT query, string_split(query, ' ') AS w FROM q), n AS (SELECT query, w, unnest(range(1, len(w) + 1)) AS i FROM t)
      , h AS (SELECT query, 1 AS tier, i AS ord, alias, brand FROM n JOIN al ON alias = w[i]
          UNION ALL SELECT query, 2, i, alias, brand FROM n JOIN al ON alias = w[i] || ' ' || w[i + 1] WHERE i < len(w)
          UNION ALL SELECT query, 3, i - 1000 * len(w[i]), w[i], brand FROM n JOIN al ON starts_with(alias, w[i]) WHERE len(w[i]) >= 2)
      , m AS (SELECT query, min((tier, ord)) AS m FROM h GROUP BY 1)
      , g AS (SELECT h.query AS query_id, alias AS alias_norm, tier, array_to_string(list_sort(list(DISTINCT brand)), ',') AS brands FROM h JOIN m ON h.query = m.query AND (tier, ord) = m.m GROUP BY 1, 2, 3)
      SELECT *, CAST(CASE WHEN tier < 3 OR len(alias_norm) >= 4 THEN CASE WHEN tier < 3 THEN 1.0 ELSE 0.9 END WHEN len(alias_norm) = 3 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
        CASE WHEN tier < 3 OR len(alias_norm) >= 3 THEN 'filter' ELSE 'boost' END AS "use" FROM g""",
}
