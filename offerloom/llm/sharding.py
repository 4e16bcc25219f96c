"""Shards of near equal bytes by a minimax contiguous partition; DataFrame functions only.

Rows with equal texts form an atomic group. Groups stand in the order of a hash of their text, so every run of groups is a
mixed sample of the corpus. The capacity of a shard is the smallest one under which the ordered groups fit into the given
number of shards: it is found by binary search, each candidate being checked greedily (fill a shard as far as it goes, then
open the next). The cuts are then made inside what that capacity allows, as near as possible to an even split of the rest, so
a group larger than a shard's fair part doesn't leave other shards empty.

The running sums are two-level (bins of the hash, then rows of a bin, about the root of the row count each), and a group of
any size is dealt over parts by its doc_ids. The search needs the ends of groups, of which there are as many as groups; it
reads them as cells (least and greatest end of a range of bytes) and looks closer only where a cut may fall: ``CELLS`` rows
come to the driver at first, then ``FINER`` for each cell that a cut may fall into, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.session import cut_lineage

SHARDS = 8
#: Cells of the whole line at first, and how many times narrower those are that replace undecided ones.
CELLS, FINER = 4096, 64
LAW = "bytes"
KEY = ["bin", "h1", "h2", "size", "crc"]


def text_key(text: Column) -> dict[str, Column]:
    """What tells texts apart: two hashes of 64 bits, the size in bytes plus 1 and the CRC; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {
        "h1": F.xxhash64(text),
        "h2": F.xxhash64(F.lit(13), text),
        "size": F.octet_length(text).cast("bigint") + 1,
        "crc": F.crc32(text.cast("binary")),
    }


class Ends:
    """The ends of groups on the line of bytes, known as cells: the least and the greatest end of a range, none between cells."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.cells = sorted(cells)
        self._index()

    def _index(self) -> None:
        self.low = [a for a, _ in self.cells]
        self.high = [b for _, b in self.cells]

    def below(self, place: int) -> tuple[int, int]:
        """Bounds of the greatest end at or before a place; the line's start counts as an end."""
        k = bisect_right(self.low, place) - 1
        if k < 0:
            return 0, 0
        a, b = self.cells[k]
        return (b, b) if place >= b else (a, min(place, b))

    def above(self, place: int) -> tuple[int, int]:
        """Bounds of the least end at or after a place, which is not behind the last end."""
        if place <= 0:
            return 0, 0
        a, b = self.cells[bisect_left(self.high, place)]
        return (a, a) if place <= a else (place, b)

    def unknown(self, a: int, b: int) -> list[tuple[int, int]]:
        """Cells of several ends that meet the range."""
        found = self.cells[bisect_left(self.high, a) : bisect_right(self.low, b)]
        return [c for c in found if c[0] < c[1]]

    def replace(self, ranges: list[tuple[int, int]], new: list[tuple[int, int]]) -> None:
        """Takes new cells for all those in the ranges."""
        old = {c for a, b in ranges for c in self.cells[bisect_left(self.low, a) : bisect_right(self.high, b)]}
        self.cells = sorted(set(self.cells) - old | set(new))
        self._index()


def fill(ends: Ends, capacity: int, shards: int, side: int) -> list[int]:
    """Ends of greedily filled shards; side 0 takes the lower bound of every end, side 1 the upper one."""
    path = [0]
    for _ in range(shards):
        path.append(ends.below(path[-1] + capacity)[side])
    return path


def smallest(ends: Ends, total: int, shards: int, side: int) -> int:
    """The smallest capacity under which greedy filling reaches the end: exact if the ends are, else a bound of it."""
    low, high = ceil(total / shards), total
    while low < high:
        middle = (low + high) // 2
        if fill(ends, middle, shards, side)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def capacity(ends: Ends, total: int, shards: int, closer: Callable[[list[tuple[int, int]]], None]) -> int:
    """The smallest feasible capacity; ``closer`` divides the cells that it can't decide without."""
    while True:
        least, most = smallest(ends, total, shards, 1), smallest(ends, total, shards, 0)
        if least == most:
            return least
        ranges = zip(fill(ends, least, shards, 0), fill(ends, most, shards, 1))
        wanted = sorted({c for a, b in ranges for c in ends.unknown(a, b)})
        closer(wanted)


def even_cuts(ends: Ends, total: int, shards: int, most: int, closer: Callable[[list[tuple[int, int]]], None]) -> list[int]:
    """The inner cuts, each as near to an even split of what is left as the capacity ``most`` allows."""
    while True:
        asked: set[tuple[int, int]] = set()

        def sure(bounds: tuple[int, int]) -> int:
            if bounds[0] < bounds[1]:
                asked.update(ends.unknown(*bounds))
            return bounds[0]

        need = [total]
        for _ in range(shards - 1):
            need.append(sure(ends.above(need[-1] - most)))
        cuts = [0]
        for k, least in enumerate(reversed(need[1:])):
            goal = cuts[-1] + (total - cuts[-1]) // (shards - k)
            reach = sure(ends.below(cuts[-1] + most))
            near = min(sure(ends.below(goal)), sure(ends.above(goal)), key=lambda end: (abs(end - goal), end))
            cuts.append(max(least, min(near, reach)))
        if not asked:
            return cuts[1:]
        closer(sorted(asked))


def ranges_of(cells: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Neighbouring cells taken together, and the width of the cells that they are to be divided into."""
    widest = max(b - a + 1 for a, b in cells)
    out: list[tuple[int, int]] = []
    for a, b in cells:
        if out and a - out[-1][1] <= widest:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out, ceil(widest / FINER)


@dataclass(frozen=True)
class Layout:
    """Parts of groups in order: KEY, salt, n rows, rows and bytes before; for every cut its place, and for every shard its first row and key."""

    bins: int
    salts: int
    units: DataFrame
    parts: DataFrame
    cuts: list[int]
    first: dict[int, tuple[int, tuple]]

    def shard_at(self, start: Column) -> Column:
        return sum(((start >= c).cast("int") for c in self.cuts), F.lit(0))

    def shard_of(self, text: Column) -> Column:
        """The shard of a text, from the first keys of the shards alone."""
        key = text_key(text)
        mine = F.struct(F.pmod(key["h1"], F.lit(self.bins)).alias("bin"), *(key[c].alias(c) for c in KEY[1:]))
        keys = [F.struct(*(F.lit(x).cast("bigint").alias(c) for c, x in zip(KEY, first))) for _, (_, first) in sorted(self.first.items())]
        at = [s for s, _ in sorted(self.first.items())]
        return F.coalesce(*(F.when(mine >= k, s) for s, k in reversed(list(zip(at, keys)))))


def layout(docs: DataFrame, shards: int = SHARDS) -> Layout | None:
    """The partition of the documents' groups; None without documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(c.alias(n) for n, c in text_key(F.col("text")).items()))
    units = cut_lineage(rows.groupBy("doc_id", *KEY[1:]).agg(F.count("*").alias("n")), "units")
    whole = units.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    if not whole["n"]:
        return None
    bins, salts = isqrt(whole["n"]) + 1, isqrt(whole["n"]) // 4 + 1
    units = units.withColumn("bin", F.pmod("h1", F.lit(bins))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    parts = units.groupBy(*KEY, "salt").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("bin").orderBy(*KEY[1:], "salt")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    new_key = F.lead(F.struct(*KEY)).over(inside).eqNullSafe(F.struct(*KEY))
    own = F.col("n") * F.col("size")
    parts = parts.select("*", F.sum("n").over(before).alias("rows_in"), F.sum(own).over(before).alias("bytes_in"), (~new_key).alias("last"))
    totals = units.groupBy("bin").agg(F.sum("n").alias("t"), F.sum(own).alias("u"))
    over = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin: about the root of the rows
    totals = totals.select("bin", F.sum("t").over(over).alias("rows_off"), F.sum("u").over(over).alias("bytes_off"))
    zero = F.lit(0).cast("bigint")
    place = [(F.coalesce(f"{c}_in", zero) + F.coalesce(f"{c}_off", zero)).alias(c) for c in ("rows", "bytes")]
    parts = cut_lineage(parts.join(totals, "bin").select(*KEY, "salt", "n", "last", *place, (F.coalesce("bytes_in", zero) + F.coalesce("bytes_off", zero) + own).alias("end")), "parts")
    total = whole["bytes"]

    def cells(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
        inner = [F.col("end").between(a, b) for a, b in ranges]
        cell = F.coalesce(*(F.when(inside, F.struct(F.lit(k).alias("k"), F.expr(f"(end - {a}L) div {width}L").alias("c"))) for k, (inside, (a, _)) in enumerate(zip(inner, ranges))))
        found = parts.where(F.col("last") & reduce(Column.__or__, inner)).groupBy(cell.alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        return [(r["a"], r["b"]) for r in found]

    ends = Ends(cells([(1, total)], ceil(total / CELLS)))

    def closer(unknown: list[tuple[int, int]]) -> None:
        ranges, width = ranges_of(unknown)
        ends.replace(ranges, cells(ranges, width))

    most = capacity(ends, total, shards, closer)
    cuts = even_cuts(ends, total, shards, most, closer)
    shard = sum(((F.col("bytes") >= c).cast("int") for c in cuts), F.lit(0))
    first = parts.groupBy(shard.alias("shard")).agg(F.min("rows").alias("rows"), F.min(F.struct(*KEY)).alias("key")).collect()
    return Layout(bins, salts, units, parts, cuts, {r["shard"]: (r["rows"], tuple(r["key"])) for r in first})


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null: only the law ``key`` has one).

    ``size`` is the text's UTF-8 bytes plus 1. A null text has no bytes and stands in one group with empty texts; its CRC
    is that of no bytes. Rows with equal texts share a shard, also where they are more than a fair part of all bytes: the
    largest shard is then as large as that group, and no partition that keeps groups whole has a smaller one. Slots count
    a shard's rows from 0 in the order of the groups, by doc_id inside a part of a group, nulls first. Rows that repeat
    doc_id and text get a slot each. With fewer groups than shards some shards are empty. Without rows the result is empty.
    """
    plan = layout(docs, shards)
    law = [F.lit(LAW).alias("law")]
    if plan is None:
        none = docs.select(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("text_crc32"), *law)
        return none.where("false").select("*", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    shard = plan.shard_at(F.col("bytes"))
    base = F.coalesce(*(F.when(shard == s, F.lit(rows)) for s, (rows, _) in plan.first.items())).cast("bigint")
    parts = plan.parts.select(*KEY, "salt", shard.alias("shard"), (F.col("rows") - base).alias("base"))
    rows = plan.units.join(parts, [*KEY, "salt"])
    before = Window.partitionBy(*KEY, "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slot", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), *law, F.col("shard").cast("int"), (F.col("slot") + F.col("copy") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes whole rows to ``path`` as Parquet, a folder ``shard=k`` each. The first keys of the shards place every row in one
    pass, so texts aren't shuffled. A column ``shard`` of the input is replaced; without rows only the schema is written."""
    plan = layout(docs, shards)
    shard = plan.shard_of(F.col("text")) if plan else F.lit(0)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
