"""Near-duplicate documents by one-permutation MinHash.

Every document becomes the set of its word shingles (64-bit hashes). One permutation hashes each shingle once; its bin
keeps the smallest value, and empty bins are filled by optimal densification. Bins are read in bands, and documents with
equal bands share a bucket. Within a bucket only star-shaped candidate edges are made: one centre against the others, so
pairs grow with the bucket and not with its square. Each is confirmed on the full sets. Members that link with their
centre are in one component. Those that don't could still link with one another or with a member that does; as all of a
star's members are known by their differences from one centre, such links are found from these differences alone, and no
link between members is lost. Documents with equal sets form one class beforehand and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.graph import components
from offerloom.llm.workers import tidy
from offerloom.session import checked_broadcast, cut_lineage

MASK = (1 << 64) - 1
#: Outliers of a star that one task compares with the star's members.
STAR_PART = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of an odd base and of its inverse modulo 2^64 up to the longest batch seen, grown on demand.
_BASE = 0x9E3779B97F4A7C15
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word (run of bytes other than space, tab to carriage return) after lower-casing A-Z."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data))[: len(data)], out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return starts, _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """For runs of texts, the list of each text's sorted distinct hashes of its shingles; a text with fewer words gives its words as one."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):  # about 1 MB at a time
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 1_000_000, "right")) - 1)
        part = data[offsets[begin] : offsets[end]]
        cuts = offsets[begin : end + 1] - offsets[begin]
        # A text must not flow into the next one: words are hashed on a copy with a space between texts.
        spaced = np.full(len(part) + end - begin, 32, np.uint8)
        owner = np.repeat(np.arange(end - begin), np.diff(cuts))
        spaced[np.arange(len(part)) + owner] = part
        starts, hashes = word_hashes(spaced)
        first = np.searchsorted(starts, cuts + np.arange(end - begin + 1))
        joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                joined = joined * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + len(joined)]
        joined = _mix(joined)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                s = np.sort(joined[a : b - words + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                whole = 0
                for h in hashes[a:b].tolist():
                    whole = (whole * 0x9FB21C651E98DF25 + h) & MASK
                sets.append(_mix(np.array([(whole + b - a) & MASK], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield sets
        begin = end


@dataclass(frozen=True)
class MinHash:
    """Words in a shingle, bands, bins in a band, and the least similarity in percent."""

    words: int = 5
    bands: int = 40
    rows: int = 5
    percent: int = 80

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row per set with the minimum of every bin; an empty bin takes the value of the first full bin in its own
        random order, which depends on the bin alone."""
        k = self.bands * self.rows
        hashed = _mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
        bins = (((hashed >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        out = np.full(len(sets) * k, MASK, np.uint64)
        np.minimum.at(out, bins + np.repeat(np.arange(len(sets)) * k, [len(s) for s in sets]), hashed)
        full = out != np.uint64(MASK)
        empty, turn = np.flatnonzero(~full), 0
        filled = out.copy()
        while len(empty):
            turn += 1
            bin_ = empty % k
            other = _mix(bin_.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(turn)) % np.uint64(k)
            other = empty - bin_ + other.astype(np.int64)
            hit = full[other]
            filled[empty[hit]] = out[other[hit]]
            empty = empty[~hit]
        return filled.reshape(len(sets), k)

    def band_keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band keys for every set; none of the sets is empty."""
        parts = self.signatures(sets).reshape(len(sets), self.bands, self.rows)
        key = np.tile(np.arange(self.bands, dtype=np.uint64), (len(sets), 1))
        for r in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
        return key


def sketches(docs: DataFrame, how: MinHash) -> DataFrame:
    """Per row: doc_id, set size, two sums that tell sets apart, and the band keys (null for an empty set)."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            sizes, sums, keys = [], [], []
            for sets in shingle_sets(batch.column("text"), how.words):
                lengths = np.array([len(s) for s in sets])
                sizes.append(lengths)
                flat = np.append(np.concatenate(sets), np.uint64(0))
                ends = np.cumsum(lengths)
                both = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (flat, _mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                sums.append([(x[ends] - x[ends - lengths]).view(np.int64) for x in both])
                full = [s for s in sets if len(s)]
                found = iter(how.band_keys(full).view(np.int64) if full else [])
                keys += [next(found) if len(s) else None for s in sets]
            one, two = (np.concatenate([s[i] for s in sums] or [np.zeros(0, np.int64)]) for i in range(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)])), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "one", "two", "keys"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id bigint, n_shingles bigint, one bigint, two bigint, keys array<bigint>"
    )


def full_sets(docs: DataFrame, how: MinHash) -> DataFrame:
    """doc_id and the whole shingle set."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            sets = [s.view(np.int64) for part in shingle_sets(batch.column("text"), how.words) for s in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), "id bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether that is the document itself. Texts without
    words (null, empty, white space) link with nothing. Rows with a null doc_id can't be named by a component: they are
    returned with a null component and kept. Rows that repeat a doc_id link the sets of all of them;
    one of them without words names its own doc_id.
    """
    sk = cut_lineage(sketches(docs, how), "sketches")
    same = ["n_shingles", "one", "two"]
    full = sk.where("doc_id is not null and n_shingles > 0")
    classes = cut_lineage(full.groupBy(same).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "classes")
    placed = sk.drop("keys").join(classes.drop("keys"), same, "left")
    # A doc_id that several classes hold links them.
    several = placed.where("doc_id is not null and id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    given = placed.join(several.drop("z"), "doc_id").select("a", F.col("id").alias("b")).distinct()
    banded = classes.select("id", F.explode("keys").alias("key")).distinct()
    buckets = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut_lineage(banded.join(buckets, "key"), "members")
    # A small part of the documents shares a bucket; where their ids are few enough, no text is shuffled to find them.
    wanted = cut_lineage(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = cut_lineage(full_sets(docs.join(checked_broadcast(wanted), "doc_id", "left_semi"), how).distinct(), "sets")
    labels = confirm_stars(members, sets, given, how.percent)
    out = placed.join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def confirm_stars(members: DataFrame, sets: DataFrame, given: DataFrame, percent: int) -> DataFrame:
    """Components (id, component) of the members (key, id) of buckets under the ``given`` links (a, b) and confirmed ones.

    The first member of a bucket in a hash order is its centre; the other members are compared with it on the full sets.
    Two members that both link with the centre are in one component, so only members that don't (outliers) are left to
    compare with the others of their star. These pairs are decided from what each lacks of the centre and what it adds.
    """
    first = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("first"))
    stars = members.join(first.select("key", F.col("first.id").alias("centre")), "key").where("id <> centre").select("centre", "id").distinct()
    stars = cut_lineage(stars, "stars")
    tested = cut_lineage(_differences(stars, sets, percent), "tested")
    linked = F.col("weight") <= F.col("slack")
    nodes = members.select("id").distinct().unionByName(given.select(F.col("a").alias("id"))).unionByName(given.select(F.col("b").alias("id")))
    links = tested.where(linked).select(F.col("centre").alias("a"), F.col("id").alias("b")).unionByName(given.select("a", "b"))
    labels = cut_lineage(components(nodes.distinct(), links), "labels")
    return _relabelled(labels, _outlier_links(tested, labels, percent))


def _differences(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars (centre, id) with the elements that id lacks of its centre and those that it adds.

    With ``lacks`` and ``adds`` elements, weight is 100 * lacks + percent * adds and slack is (100 - percent) times the
    centre's size: id and centre are linked if weight <= slack. The elements are kept where a centre has several members.
    ``star`` and ``member`` tell apart the sets of an id that has several.
    """
    several = stars.groupBy("centre").agg((F.count("*") > 1).alias("several"))
    left = sets.select(F.col("id").alias("centre"), F.col("shingles").alias("x"))
    both = stars.join(several, "centre").join(left, "centre").join(sets, "id")
    out = both.select("centre", F.xxhash64("x").alias("star"), "id", F.xxhash64("shingles").alias("member"), "several", F.size("x").alias("of"), F.array_except("x", "shingles").alias("lack"), F.array_except("shingles", "x").alias("add"))
    weight = 100 * F.size("lack").cast("bigint") + percent * F.size("add").cast("bigint")
    kept = [F.when(F.col("several"), F.col(c)).alias(c) for c in ("lack", "add")]
    return out.select("centre", "star", "id", "member", weight.alias("weight"), ((100 - percent) * F.col("of").cast("bigint")).alias("slack"), *kept)


def _outlier_links(tested: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one star that lie in different components, of which one is an outlier.

    Two members share their centre's elements but for those that either lacks, those that both lack counting once, and
    the added elements that both add. So they are linked if (100 + percent) times the number of elements that both lack
    or both add reaches the sum of their weights less the slack. Elements that one member alone adds can't be shared;
    leaving them out bounds most pairs away by counts, and the others compare short arrays inside the join's condition.
    """
    own = labels.select("id", F.col("component").alias("own"))
    core = labels.select(F.col("id").alias("centre"), F.col("component").alias("core"))
    placed = tested.where("lack is not null").join(own, "id").join(core, "centre").withColumn("outlier", F.expr("own <> core"))
    spread = placed.groupBy("centre", "star").agg(F.count_if("outlier").alias("outliers"), F.min(F.expr("size(add) - size(lack)")).alias("least"), F.count("*").alias("n"))
    spread = spread.where("outliers > 0 and n > 1").drop("n")
    placed = cut_lineage(placed.join(spread, ["centre", "star"]), "placed")
    added = placed.select("centre", "star", "id", "member", F.explode("add").alias("e"))
    shared = added.groupBy("centre", "star", "e").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = added.join(shared, ["centre", "star", "e"]).groupBy("centre", "star", "id", "member").agg(F.collect_list("e").alias("add"))
    rows = placed.drop("add").join(shared, ["centre", "star", "id", "member"], "left").withColumn("add", F.coalesce("add", F.array().cast("array<bigint>")))
    rows = rows.withColumn("n_lack", F.size("lack")).withColumn("n_add", F.size("add"))
    rows = rows.withColumn("parts", F.ceil(F.col("outliers") / STAR_PART).cast("int")).drop("outliers", "core")
    # What both lack is at most what the partner lacks, so the shared additions must make up for the rest.
    hopeful = F.col("outlier") & ((100 + percent) * F.col("n_add") >= F.col("weight") - F.col("slack") + percent * F.col("least"))
    rows = cut_lineage(rows, "deltas")
    one = rows.where(hopeful).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    two = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = one.alias("x"), two.alias("y")
    asked = F.expr("x.weight + y.weight - x.slack")
    most = (100 + percent) * F.expr("least(x.n_lack, y.n_lack) + least(x.n_add, y.n_add)")
    adds = (100 + percent) * (F.expr("least(x.n_lack, y.n_lack)") + F.expr("size(array_intersect(x.add, y.add))"))
    exact = (100 + percent) * F.expr("size(array_intersect(x.lack, y.lack)) + size(array_intersect(x.add, y.add))")
    same = F.expr("x.centre = y.centre and x.star = y.star and x.part = y.part and x.own <> y.own")
    pairs = one.join(two, same & (most >= asked) & (adds >= asked) & (exact >= asked))
    return pairs.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after components that new links join have become one."""
    a, b = (labels.select(F.col("id").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
    edges = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges, "joins")
    if edges.isEmpty():
        return labels
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    moved = components(nodes, edges).select(F.col("id").alias("component"), F.col("component").alias("new"))
    return cut_lineage(labels.join(moved, "component", "left").select("id", F.coalesce("new", "component").alias("component")), "labels")
