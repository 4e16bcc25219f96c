"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern: the set of sources they belong to, and the words they hold. Flow runs
from patterns to the quotas of their sources; the first pass over a pattern's words is free, every repetition costs more
than the one before (convex costs), so words are repeated only where a quota can't be met otherwise, and least where
sources overlap. The flow then says how many words of each pattern are taken, and documents are chosen by a seeded hash
order until those words are reached. Only patterns and sources, never documents, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Most membership patterns and sources; beyond it the flow network is refused rather than solved on part of the data.
MOST_PATTERNS = 100_000
#: Parts of a pattern in its seeded order; running sums are taken over parts first, then within each.
CHUNKS = 4096

#: Fill rounds: rows of up to gap / share words fill what the rounds before have left of a pattern's part.
FILL_SHARES = (4, 1)


def word_count() -> Column:
    """Number of words (runs other than space and tab to carriage return) in the text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> dict[str | None, float]:
    """Target words by source. Sources by code point, null last, get the weights in turn and share all words; a target
    stops at ``most`` times its source's size, and the excess is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, rest = set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in order if s in free and rest * weight[s] / total > most * sizes[s]]
        if not over:
            out.update({s: rest * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in over)
        free -= set(over)
    return out


def route(patterns: dict[tuple, int], quotas: dict, passes: int = MOST_PASSES) -> dict[tuple, int]:
    """Words taken of every pattern (repetitions counted) by a min-cost flow.

    ``patterns`` maps a tuple of sources to its words, ``quotas`` a source to its target. A pass over a pattern costs as
    much as its number; flow is pushed along cheapest augmenting paths (pass by pass, since costs depend on the pass
    alone), rerouting between sources where patterns overlap.
    """
    left = {s: int(round(q)) for s, q in quotas.items()}
    flow: dict[tuple[tuple, object], int] = {}
    taken = dict.fromkeys(patterns, 0)
    members: dict[object, list[tuple]] = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    for turn in range(1, passes + 1):
        for p in sorted(patterns, key=repr):
            while taken[p] < turn * patterns[p]:
                path = _path(p, left, flow, members)
                if path is None:
                    break
                amount = min([turn * patterns[p] - taken[p], left[path[-1][1]], *(flow[q, s] for q, s in zip([x[0] for x in path[1:]], [x[1] for x in path]))])
                for k, (q, s) in enumerate(path):
                    flow[q, s] = flow.get((q, s), 0) + amount
                    if k:
                        flow[q, path[k - 1][1]] -= amount
                left[path[-1][1]] -= amount
                taken[p] += amount
    return taken


def _path(start: tuple, left: dict, flow: dict, members: dict) -> list[tuple] | None:
    """Steps (pattern, source): each pattern gives to a source; the next pattern gave to it and gives elsewhere."""
    seen, queue = set(), [(start, [])]
    while queue:
        p, path = queue.pop(0)
        for s in p:
            if s in seen:
                continue
            seen.add(s)
            step = [*path, (p, s)]
            if left.get(s, 0) > 0:
                return step
            queue += [(q, step) for q in members[s] if q != p and flow.get((q, s), 0) > 0]
    return None


def mix(docs: DataFrame, membership: Column | None = None, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES, seed: int = 7) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken.

    ``membership`` is an array of the sources that a document belongs to; without it, the one in ``source`` (null is a
    source of its own). ``source_size`` and ``target`` belong to the first member, for which the row counts when sizes
    are summed. ``taken`` is the words that the mix takes of the row: its size times the passes over it, so never above
    ``passes`` times its size. Reruns choose the same rows: the order is a hash of seed, doc_id and text. Null texts and
    texts without words have size 0 and are never taken. Rows that agree in doc_id and text come next to each other and
    are told apart by nothing; which of them is taken makes no difference to the result.
    """
    sources = membership if membership is not None else F.array("source")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_sort(sources).alias("pattern"), word_count().alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), "text").alias("h"))
    rows = rows.withColumn("chunk", F.pmod("h", F.lit(CHUNKS)).cast("int"))
    rows = cut_lineage(rows, "mix")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in sums if r["pattern"]}
    sizes: dict[str | None, int] = {}
    for p, size in patterns.items():
        sizes[p[0]] = sizes.get(p[0], 0) + size
        for s in p[1:]:
            sizes.setdefault(s, 0)
    goal = targets(sizes, weights, passes)
    taken = route(patterns, goal, passes)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(list(p), sizes[p[0]], goal[p[0]], words // size if size else 0, words % size if size else 0) for p, size in patterns.items() for words in [taken[p]]],
        "name array<string>, source_size bigint, target double, passes bigint, part bigint",
    )
    done = cut_lineage(_prefix(rows.join(F.broadcast(plan), _same("pattern", "name")).withColumn("more", F.lit(0)), "part"), "part")
    # A large row may end the order early; smaller rows behind it then fill what is left of the part.
    for share in FILL_SHARES:
        got = done.groupBy(F.col("name").alias("other")).agg(F.sum(F.col("size") * F.col("more")).alias("got"))
        rest = done.join(F.broadcast(got), _same("name", "other")).withColumn("gap", F.col("part") - F.col("got")).drop("other", "got")
        fill = (F.col("more") == 0) & (F.col("size") > 0) & (F.col("size") * share <= F.col("gap"))
        done = cut_lineage(_prefix(rest.where(fill), "gap").unionByName(rest.where(~fill)).drop("gap"), "part")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _prefix(rows: DataFrame, quota: str) -> DataFrame:
    """Sets ``more`` to 1 for the rows of every pattern whose running size stays within its ``quota``."""
    chunks = rows.groupBy("name", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("name").alias("n"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("name", "chunk").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(within)
    placed = rows.join(chunks, _same("name", "n") & (F.col("chunk") == F.col("c"))).withColumn("upto", upto)
    return placed.withColumn("more", (F.col("upto") <= F.col(quota)).cast("int")).drop("n", "c", "before", "upto")
