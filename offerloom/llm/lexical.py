"""Ranked lexical search by best-first document intervals under range-maximum bounds.

Documents become rows of the query terms that they hold, with counts (one pass over the texts). Each task then reads its rows
in segments. In a segment every query term has a posting list of documents with impacts, and a sparse table over the list that
names the greatest impact of any range of it in two look-ups. An item's search starts with the interval of all documents of the
segment. The sum of its terms' range maxima bounds every score in an interval. The intervals with the highest bounds are split
at the document that holds the greatest impact in them: that document gets its full score, and the two halves get bounds of
their own. An interval whose bound is below the item's k-th best score so far is given up; when none is left, the k best of the
segment are known exactly. They carry over to the next segment of the task, and the lists of all tasks are ranked at the end.

Intervals are split many at a time with array operations, which changes their order but no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import cut_lineage

#: Results an item; documents of a segment; intervals split at a time; distinct (item, term) pairs of a block of items.
BEST, SEGMENT, WAVE, BLOCK_TERMS = 10, 8192, 256, 200_000

#: A-Z become lower case; all other bytes below 128 but digits and a-z separate terms, so they become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or b"").translate(_TABLE).split()


def weight(docs: int, holding: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term); rows that repeat an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            ids = batch.column("item_id").to_pylist()
            flat = [(i, t) for i, ts in zip(ids, found) for t in ts]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in flat], pa.int64()), pa.array([t for _, t in flat], pa.binary())], ["item_id", "term"])

    read = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return read.mapInArrow(run, "item_id bigint, term binary").distinct()


def term_rows(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """For documents with a term: doc_id, n terms, and the numbered terms that they hold with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kept, sizes, ids, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                kept.append(row)
                sizes.append(len(found))
                for term, count in Counter(found).items():
                    number = known.get(term)
                    if number is not None:
                        ids.append(number)
                        counts.append(count)
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    read = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return read.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of every numbered term."""

    docs: int
    length: int
    weights: np.ndarray

    def impacts(self, terms: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The impact of each posting; ``n`` is the length of its document."""
        wide = int(n.max(initial=0)) * self.docs * 90 >= 1 << 63
        m = 10 + (90 * (n.astype(object) if wide else n) * self.docs) // self.length
        counts = counts.astype(np.int64)
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m.astype(np.int64)))


class Segment:
    """Posting lists of a run of documents in one array, sorted by (term, document), with a sparse table over all of it."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, docs: int):
        self.docs = docs
        keys = terms.astype(np.int64) * docs + places
        order = np.argsort(keys)
        self.keys, self.places, self.impacts = keys[order], places[order], impacts[order]
        lengths = np.bincount(terms) if len(terms) else np.zeros(0, np.int64)
        levels = [np.arange(len(keys), dtype=np.int32)]
        step = 1
        while 2 * step <= lengths.max(initial=0):
            last = levels[-1]
            left, right = last[:-step], last[step:]
            best = np.where(self.impacts[left] >= self.impacts[right], left, right)
            levels.append(np.concatenate((best, last[len(best) :])))  # the end of a level is never asked
            step *= 2
        self.table = np.stack(levels)

    def starts(self, terms: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, terms.astype(np.int64) * self.docs)

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the greatest impact in every range of postings; the ranges aren't empty."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        left, right = self.table[level, begin], self.table[level, end - (1 << level)]
        return np.where(self.impacts[left] >= self.impacts[right], left, right)

    def bounds(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals (rows) over terms (columns): the sum of the range maxima, and the document of the greatest."""
        full = begin < end
        best = np.zeros(begin.shape, np.int64)
        where = np.zeros(begin.shape, np.int64)
        found = self.maxima(begin[full], end[full])
        best[full], where[full] = self.impacts[found], self.places[found]
        top = best.argmax(axis=1)
        return best.sum(axis=1), where[np.arange(len(top)), top]

    def search(self, terms: np.ndarray, ids: np.ndarray, best: list[tuple], size: int) -> list[tuple]:
        """The ``size`` best (score, id) of ``best`` and of this segment's documents; ``ids`` are those of the documents."""
        begin, end = self.starts(terms)[None, :], self.starts(terms + 1)[None, :]
        held = (begin < end)[0]
        if not held.any():
            return best
        terms, begin, end = terms[held], begin[:, held], end[:, held]
        base = terms.astype(np.int64) * self.docs
        bound, split = self.bounds(begin, end)
        while len(bound):
            least = best[-1][0] if len(best) == size else 1
            alive = np.flatnonzero(bound >= least)
            if not len(alive):
                break
            if len(alive) > WAVE:
                alive = alive[np.argpartition(-bound[alive], WAVE - 1)]
            now, later = alive[:WAVE], alive[WAVE:]
            at = split[now]
            cut = np.searchsorted(self.keys, base + at[:, None])
            cut = np.clip(cut, begin[now], end[now])
            inside = cut < end[now]
            probe = np.where(inside, cut, 0)
            hit = inside & (self.places[probe] == at[:, None])
            scores = np.where(hit, self.impacts[probe], 0).sum(axis=1)
            good = np.flatnonzero(scores >= least)
            if len(good):
                best = ranked(best + [(int(scores[g]), ids[at[g]]) for g in good])[:size]
            halves = np.concatenate((begin[now], cut + hit)), np.concatenate((cut, end[now]))
            bounds, splits = self.bounds(*halves)
            least = best[-1][0] if len(best) == size else 1
            kept = bounds >= least
            begin, end = np.concatenate((begin[later], halves[0][kept])), np.concatenate((end[later], halves[1][kept]))
            bound, split = np.concatenate((bound[later], bounds[kept])), np.concatenate((split[later], splits[kept]))
        return best


def ranked(found: list[tuple]) -> list[tuple]:
    """(score, id) with the highest score first, equal ones by id, rows without an id last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def best_of_tasks(rows: DataFrame, corpus: Corpus, items: list[tuple], size: int) -> DataFrame:
    """The ``size`` best (item_id, doc_id, score) of each task's rows, for items (id, term numbers)."""
    shared = rows.sparkSession.sparkContext.broadcast((corpus, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, items = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for whole in batches:
            for start in range(0, whole.num_rows, SEGMENT):
                batch = whole.slice(start, SEGMENT)
                lists = batch.column("terms")
                lengths = np.diff(lists.offsets.to_numpy())
                terms = lists.flatten().to_numpy()
                counts = batch.column("counts").flatten().to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                impacts = corpus.impacts(terms, counts, np.repeat(batch.column("n").to_numpy(), lengths))
                ids = batch.column("doc_id").to_pylist()
                segment = Segment(terms, owner, impacts, batch.num_rows)
                for k, (_, wanted) in enumerate(items):
                    best[k] = segment.search(wanted, ids, best[k], size)
        flat = [(item, doc, score) for (item, _), found in zip(items, best) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, size: int = BEST) -> DataFrame:
    """For each item the ``size`` documents with the highest scores above 0: item_id, rank, doc_id, score.

    Items (item_id, text) are taken in blocks of ``BLOCK_TERMS`` distinct (item, term) pairs, each against all documents;
    only a block's items, terms and weights come to the driver. Rows that repeat an item_id, also a null one, are one item
    with the terms of all. Null and empty texts have no terms: such items have no rows, such documents are never found and
    count for nothing. Every row of ``docs`` is a document of its own, also where it repeats a doc_id; equal scores rank by
    doc_id, rows without one last.
    """
    spark = docs.sparkSession
    wanted = cut_lineage(item_terms(items), "wanted")
    blocks = max(1, ceil(wanted.count() / BLOCK_TERMS))
    found = []
    for block in range(blocks):
        pairs = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        numbers = {term: k for k, term in enumerate(sorted({bytes(r["term"]) for r in pairs}))}
        rows = cut_lineage(term_rows(docs, numbers), "terms")
        sums = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        holding = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        weights = np.zeros(len(numbers), np.int64)
        for r in holding:
            weights[r["term"]] = weight(sums["docs"], r["df"])
        asked: dict[int | None, list[int]] = {}
        for r in pairs:
            number = numbers[bytes(r["term"])]
            if weights[number]:
                asked.setdefault(r["item_id"], []).append(number)
        block_items = [(item, np.array(sorted(terms))) for item, terms in asked.items()]
        found.append(best_of_tasks(rows, Corpus(sums["docs"], sums["length"] or 0, weights), block_items, size))
    everything = found[0]
    for part in found[1:]:
        everything = everything.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranks = everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranks.select("item_id", "rank", "doc_id", "score")
