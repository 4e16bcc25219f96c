"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are turned into the axes of their common principal components, so the leading dimensions carry the
most. Equal vectors form one class first. Classes fall into cells of the first components, as wide as two linked vectors
can lie apart, and cells into tiles of bounded size. Only tiles of the same or neighbouring cells meet. Two tiles are
compared dimension block by block: the sum so far plus the product of the suffix norms bounds the cosine, and a pair is
given up as soon as the bound is below the threshold. Survivors are confirmed on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.graph import components
from offerloom.session import cut_lineage

THRESHOLD = 0.98
#: Rows of a tile, components that make the cells, and dimensions of a block.
TILE, CELL_AXES, BLOCK = 512, 3, 16
#: Room for rounding in bounds, in cosine.
SLACK = 1e-9


def valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For every dimension count the principal axes (columns, strongest first) of the unit vectors.

    Each task sums outer products; only sums of dim x dim numbers come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                x = _unit(np.stack(part["v"].to_list()))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pd.DataFrame([(dim, i, row) for dim, m in sums.items() for i, row in enumerate(m)], columns=["dim", "row", "sums"])

    parts = vectors.select("v").mapInPandas(run, "dim int, row int, sums array<double>")
    summed = parts.select("dim", "row", F.posexplode("sums")).groupBy("dim", "row", "pos").agg(F.sum("col").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["row"], r["pos"]] = r["s"]
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of the pairs of unit vectors whose product may reach the threshold."""
    norms = [np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (a, b)]
    suffix = [np.concatenate((n, np.zeros((len(n), 1))), axis=1) for n in norms]
    end = min(BLOCK, a.shape[1])
    sums = a[:, :end] @ b[:, :end].T
    i, j = np.nonzero(sums + np.outer(suffix[0][:, end], suffix[1][:, end]) >= threshold - SLACK)
    sums = sums[i, j]
    while end < a.shape[1] and len(i):
        start, end = end, min(end + BLOCK, a.shape[1])
        sums = sums + np.einsum("nd,nd->n", a[i, start:end], b[j, start:end])
        keep = sums + suffix[0][i, end] * suffix[1][j, end] >= threshold - SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


def links(classes: DataFrame, axes: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Linked classes (a, b), a < b, out of rows (id, label, v) with distinct vectors."""
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len)
            for dim, part in batch.groupby(dims):
                turned = _unit(np.stack(part["v"].to_list())) @ shared.value[dim]
                lead = turned[:, :CELL_AXES]
                if lead.shape[1] < CELL_AXES:
                    lead = np.pad(lead, ((0, 0), (0, CELL_AXES - lead.shape[1])))
                cells = np.floor(lead / width).astype(int)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "cell": list(cells), "v": part["v"].to_list(), "turned": list(turned)})

    rows = classes.mapInPandas(turn, "id bigint, label int, dim int, cell array<int>, v array<double>, turned array<double>")
    rows = cut_lineage(rows, "turned")
    sizes = rows.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = rows.join(sizes, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    packed = rows.groupBy("label", "dim", "cell", "tile").agg(F.collect_list(F.struct("id", "v", "turned")).alias("rows"))
    packed = cut_lineage(packed.select("label", "dim", "cell", "tile", "rows"), "tiles")
    # Tile names alone are paired first: a neighbour cell differs by at most one in every axis, each pair once.
    names = packed.select("label", "dim", "cell", "tile")
    steps = F.array(*(F.array(*map(F.lit, (x, y, z))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)))
    left = names.select("label", "dim", F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.explode(steps).alias("step"))
    left = left.withColumn("cell", F.zip_with("cell_a", "step", lambda c, s: c + s))
    pairs = left.join(names, ["label", "dim", "cell"]).where((F.col("cell") != F.col("cell_a")) | (F.col("tile") >= F.col("tile_a")))
    a = packed.select("label", "dim", F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("rows").alias("rows_a"))
    met = pairs.join(a, ["label", "dim", "cell_a", "tile_a"]).join(packed, ["label", "dim", "cell", "tile"]).select("rows_a", "rows")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ida, va, ta), (idb, vb, tb) = (_unpack(batch.column(c)[k].values) for c in ("rows_a", "rows"))
                i, j = compare(ta, tb, threshold)
                ua, ub = _unit(va), _unit(vb)
                sure = np.einsum("nd,nd->n", ua[i], ub[j]) >= threshold
                x, y = ida[i[sure]], idb[j[sure]]
                keep = x != y
                lo, hi = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def _unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(rows)
    v, turned = (rows.field(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for name in ("v", "turned"))
    return rows.field("id").to_numpy(), v, turned


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing. Vectors of different lengths don't link. Equal vectors of one label link with each other. ``n_links`` counts
    rows. Rows that repeat a vec_id are rows of one node: each counts the links of its own vector. A null vec_id is kept,
    with a null component, and links with nothing.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), v.alias("v"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid(F.col("v")))
    good = rows.where("ok")
    # Rows of one class are found by a key of 128 bits over the components.
    key = [F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label")]
    keyed = rows.select("vec_id", "ok", *(F.when(F.col("ok"), k).alias(n) for k, n in zip(key, ("k1", "k2"))))
    classes = good.groupBy(key[0].alias("k1"), key[1].alias("k2")).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min(F.struct("label", "v")).alias("x"))
    classes = cut_lineage(classes.select("k1", "k2", "id", "n", "x.label", "x.v"), "classes")
    # Two classes may share their smallest vec_id if rows repeat it, so links run between numbers of their own.
    named = classes.withColumn("name", F.xxhash64("k1", "k2"))
    found = cut_lineage(links(named.select(F.col("name").alias("id"), "label", "v"), principal_axes(classes.select("v")), threshold), "links")
    small = named.select("name", "id", "n")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(small.select(F.col("name").alias("b"), "n"), "b").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("others"))
    counted = classes.select("k1", "k2", "id", "n").withColumn("name", F.xxhash64("k1", "k2")).join(degree, "name", "left")
    counted = counted.select("k1", "k2", "id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    full = cut_lineage(keyed.join(counted, ["k1", "k2"], "left"), "members")
    ids = found.join(small.select(F.col("name").alias("a"), F.col("id").alias("x")), "a").join(small.select(F.col("name").alias("b"), F.col("id").alias("y")), "b")
    edges = ids.select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = edges.unionByName(full.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    nodes = full.where("vec_id is not null").select(F.col("vec_id").alias("id")).distinct()
    out = full.drop("id").join(components(nodes, edges).withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
