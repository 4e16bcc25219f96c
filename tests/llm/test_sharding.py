"""Sharding against a plain partition of small lists, and the rows of small tables."""

import random
import zlib

import pytest

from offerloom.llm import sharding

DOCS = "doc_id bigint, text string, lang string, size string, bin string, shard string, n int"


def plain_capacity(sizes, shards):
    """Least largest sum of a contiguous partition, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        step = [0] * (len(sizes) + 1)
        for end in range(1, len(sizes) + 1):
            step[end] = min(max(best[start], sum(sizes[start:end])) for start in range(end + 1))
        best = step
    return best[-1]


def known(sizes, cells):
    """Ends of the sizes as cells, and a way to look closer, as the tables give them."""
    places, at = [], 0
    for size in sizes:
        at += size
        places.append(at)

    def read(ranges, width):
        out = {}
        for k, (a, b) in enumerate(ranges):
            for p in places:
                if a <= p <= b:
                    out.setdefault((k, (p - a) // width), []).append(p)
        return [(min(x), max(x)) for x in out.values()]

    ends = sharding.Ends(read([(1, at)], -(-at // cells)))

    def closer(unknown):
        ranges, width = sharding.ranges_of(unknown)
        ends.replace(ranges, read(ranges, width))

    return ends, at, closer


@pytest.mark.parametrize("seed", range(40))
def test_capacity_and_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, 40, rng.randint(1, 300)]) for _ in range(rng.randint(1, 60))]
    if seed % 4 == 0:
        sizes[len(sizes) // 2] += sum(sizes) // 2  # a group with a third of all bytes
    shards = rng.randint(1, 9)
    ends, total, closer = known(sizes, rng.choice([1, 2, 7, 64]))
    most = sharding.capacity(ends, total, shards, closer)
    assert most == plain_capacity(sizes, shards)
    cuts = [0, *sharding.even_cuts(ends, total, shards, most, closer), total]
    places = {0} | {sum(sizes[: k + 1]) for k in range(len(sizes))}
    assert len(cuts) == shards + 1 and cuts == sorted(cuts) and set(cuts) <= places
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= most


def test_long_lines():
    """Numbers as of a large corpus: few cells are read for them."""
    rng = random.Random(1)
    sizes = [rng.randint(1, 10**11) for _ in range(3000)]
    ends, total, closer = known(sizes, sharding.CELLS)
    most = sharding.capacity(ends, total, 8, closer)
    plain = [s for s in (most - 1, most)]
    fits = []
    for limit in plain:
        used, room = 1, limit
        for s in sizes:
            if s > room:
                used, room = used + 1, limit
            room -= s
        fits.append(used <= 8 and max(sizes) <= limit)
    assert fits == [False, True]


def rows_of(result):
    return sorted(map(tuple, result.collect()), key=str)


def check(result, docs, shards):
    rows = result.collect()
    want = []
    for d in docs:
        data = (d[1] or "").encode()
        want.append((d[0], len(data) + 1, zlib.crc32(data)))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(want, key=str)
    slots, homes = {}, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_rows(spark):
    texts = [None, "", "", "é🙂", "word " * 5000, "a", *["same"] * 300, *(f"text {i}" for i in range(200))]
    docs = [(i, t, None, "x", "y", "z", 1) for i, t in enumerate(texts)]
    docs += [docs[6], docs[6], docs[0], (None, "same", "en", None, None, None, None), (None, "same", "en", None, None, None, None), (None,) * 7]
    frame = spark.createDataFrame(docs, DOCS)
    for shards in (1, 8):
        check(sharding.assign(frame, shards), docs, shards)
    assert rows_of(sharding.assign(frame)) == rows_of(sharding.assign(frame.repartition(7)))


def test_even(spark):
    """No shard is further from an even share than a group."""
    rng = random.Random(5)
    docs = [(i, "x" * rng.randint(0, 400), None, None, None, None, None) for i in range(3000)]
    frame = spark.createDataFrame(docs, DOCS)
    sums = {}
    groups = {}
    for r in sharding.assign(frame).collect():
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        groups[r.size] = groups.get(r.size, 0) + r.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 2 * max(groups.values())


def test_empty_and_few(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.assign(none).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None, None, None)], DOCS)
    full = sharding.assign(one)
    assert [tuple(r) for r in full.collect()] == [(5, 1, 0, "bytes", 0, 0, None)] or full.first().shard < 8
    assert sharding.assign(none).schema.simpleString() == full.schema.simpleString()


def test_written_shards(spark, tmp_path):
    docs = [(i, None if i % 9 == 0 else f"{i % 50} text " * (i % 7), "en", "s", None, None, i) for i in range(500)]
    frame = spark.createDataFrame(docs, DOCS)
    sharding.write_shards(frame, str(tmp_path / "out"))
    got = {(r.doc_id, int(r.shard)) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard").collect()}
    assert got == {(r.doc_id, r.shard) for r in sharding.assign(frame).collect()}
    sharding.write_shards(frame.where("false"), str(tmp_path / "none"))
