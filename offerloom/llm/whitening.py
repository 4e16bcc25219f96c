"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X are never held in one place. A pass sums the Gram matrix of the current rows over all tasks, factors it on
the driver (dim x dim numbers) and turns the rows by a triangular solve: Q = X R^-1. The first factor is shifted by a small
multiple of the identity, so it exists however badly X is conditioned; later passes orthogonalise what is left until the Gram
matrix is the identity to rounding. The factors compose to one R with X = Q R, so the singular values and right singular
vectors of X are those of R: squared over n they are the eigenvalues and eigenvectors of the covariance, but found without
squaring the condition of X.

Vectors are first mapped to whole numbers, so means, centring and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.session import cut_lineage

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Entries beyond this many steps are held at it, so that whole numbers stay exact in double precision.
FAR = 1 << 52
MOST_PASSES = 8
#: Largest distance of the Gram matrix from the identity at which passes end, in units of rounding per row of it.
ROUND = 16 * np.finfo(float).eps
#: Standard deviations below this share of the largest are rounding, not variance.
FLAT = 1e-12


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; null if the vector is null or has a null, infinite or undefined entry."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    step = F.transform(v, lambda c: (F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(FAR))), F.lit(float(FAR)))) + OFFSET).cast("bigint"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), step)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def parts_by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        if dim:
            yield int(dim), batch.filter(pa.array(lengths == dim))


def turned(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows (R_k ... R_1)^-1 by one triangular solve for each factor."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


@dataclass
class Centre:
    """Rows of a fit list and their sums, exact."""

    n: int
    sums: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as whole numbers; of Python's where 64 bits are too few."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(int(s)) for s in self.sums), default=0))
        if largest >= 1 << 62:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, null where it takes more than 64 bits."""
        d = self.deviations(x)
        if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 1 << 63:
            exact = [sum(int(c) ** 2 for c in row) for row in d]
            return [s if s < 1 << 63 else None for s in exact]
        return (d * d).sum(axis=1).tolist()


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct vector of whole numbers once (column x), written to the shared folder."""
    return cut_lineage(vectors.where("x is not null and size(x) > 0").select("x").distinct(), "fit")


def centres(fit: DataFrame) -> dict[int, Centre]:
    """For every length of vectors the number of rows and the sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in parts_by_length(batch):
                x = matrix(part.column("x"), dim)
                counts[dim] = counts.get(dim, 0) + len(x)
                # High and low halves apart, so that no sum of a task leaves 64 bits.
                halves = np.stack(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))
                sums[dim] = sums.get(dim, 0) + halves
        flat = [(dim, counts[dim], j, int(h), int(w)) for dim in sums for j, (h, w) in enumerate(sums[dim].T)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(5)], ["dim", "n", "j", "high", "low"])

    parts = fit.mapInArrow(run, "dim bigint, n bigint, j bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out: dict[int, Centre] = {}
    for r in parts.groupBy("dim", "j").agg(F.sum("n").alias("n"), *wide).collect():
        centre = out.setdefault(r["dim"], Centre(r["n"], np.zeros(r["dim"], object)))
        centre.sums[r["j"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def gram(fit: DataFrame, centres: dict[int, Centre], turns: dict[int, list[np.ndarray]], axes: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For every length the Gram matrix of the centred rows after the triangular solves ``turns``, or of centred rows times ``axes``.

    Each task adds its rows up; the sums meet by row of the matrix, and dim rows of dim numbers come to the driver.
    """
    shared = fit.sparkSession.sparkContext.broadcast((centres, turns, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turns, axes = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in parts_by_length(batch):
                rows = centres[dim].centred(matrix(part.column("x"), dim))
                rows = turned(rows, turns.get(dim, [])) if axes is None else rows @ axes[dim]
                sums[dim] = sums.get(dim, 0) + rows.T @ rows
        flat = [(dim, j, row.tobytes()) for dim, g in sums.items() for j, row in enumerate(g)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["dim", "j", "sums"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in rows:
            for dim, j, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "j", "sums"))):
                sums[dim, j] = sums.get((dim, j), 0) + np.frombuffer(data)
        columns = [pa.array([d for d, _ in sums], pa.int64()), pa.array([j for _, j in sums], pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "j", "sums"])

    schema = "dim bigint, j bigint, sums binary"
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in fit.mapInArrow(run, schema).repartition("dim", "j").mapInArrow(add, schema).collect():
        found.setdefault(r["dim"], {})[r["j"]] = np.frombuffer(r["sums"])
    return {dim: np.stack([rows[j] for j in sorted(rows)]) for dim, rows in found.items()}


def factor(g: np.ndarray, rows: int, first: bool) -> np.ndarray:
    """Upper R with R^T R = G, or G + sI on the first pass and wherever G is not positive to rounding."""
    dim = len(g)
    eps = np.finfo(float).eps
    shift = 11 * eps * dim * (rows + dim + 1) * max(np.trace(g), np.finfo(float).tiny) / dim
    shift = min(shift, 1e-6 * max(np.trace(g), np.finfo(float).tiny))  # a bound beyond which later passes would only grow
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass
class Whitening:
    """Unit components (columns) by falling eigenvalue, and what each explains; ``error`` is measured on the fit list."""

    centre: Centre
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.eigenvalues)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """For every length of vectors in the fit list its whitening."""
    middle = centres(fit)
    turns: dict[int, list[np.ndarray]] = {dim: [] for dim in middle}
    open_ = set(middle)
    for step in range(MOST_PASSES):
        found = gram(fit.where(F.size("x").isin(sorted(open_))), middle, turns)
        for dim in sorted(open_):
            g = (found[dim] + found[dim].T) / 2
            if step and np.abs(g - np.eye(dim)).max() <= ROUND * dim:
                open_.discard(dim)
            else:
                turns[dim].append(factor(g, middle[dim].n, not step))
        if not open_:
            break
    out = {}
    for dim, factors in turns.items():
        r = np.eye(dim)
        for f in factors:
            r = f @ r
        _, sigma, vt = np.linalg.svd(r)
        kept = (sigma > FLAT * sigma[0]) & (sigma * sigma * middle[dim].n > FLAT)
        eigenvalues = sigma * sigma / middle[dim].n
        kept &= np.arange(dim) < components
        out[dim] = Whitening(middle[dim], vt.T[:, kept], eigenvalues[kept], eigenvalues[kept] / max(eigenvalues.sum(), np.finfo(float).tiny))
    for dim, g in gram(fit, middle, {}, {dim: w.scaled() for dim, w in out.items()}).items():
        if len(g):
            out[dim].error = float(np.abs(g / out[dim].centre.n - np.eye(len(g))).max())
    return out


def whitened(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """Rows (vec_id, x) projected: vec_id, n, deviation, and the whitened values with what each component explains."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for dim, part in parts_by_length(batch):
                model = models[dim]
                x = matrix(part.column("x"), dim)
                values = model.centre.centred(x) @ model.scaled()
                count, width = values.shape
                if not width:
                    continue
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(count), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, model.centre.n), pa.int64()),
                    pa.array(model.centre.squares(x), pa.int64()).take(pa.array(np.repeat(np.arange(count), width))),
                    pa.array(values.ravel()),
                    pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * width, model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null, infinite or undefined entry go; so do empty vectors, which have no component.
    The fit list has each distinct vector of whole numbers once; repeated rows and rows with a null vec_id are projected
    like all others. Vectors of different lengths are fitted apart (few lengths are assumed: dim^2 numbers of each come to
    the driver). A component without variance is left out, as it can't be scaled to 1: where all vectors are equal there is
    none. Entries beyond 2^52 steps of 1/64 are held at that, and a deviation beyond 64 bits is null.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint"), whole_numbers(F.col("embedding")).alias("x")).where("x is not null and size(x) > 0")
    return whitened(rows, fit_whitening(fit_list(rows), components))
