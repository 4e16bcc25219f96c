"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams of a text's lower-case letters with one space between words, hashed into buckets. For a bounded
sample of labelled rows, the share of toxic and of other texts that hold a bucket gives its log-count ratio r; the
buckets with the most telling ratios are kept. A text's feature values are r where it holds the bucket, and a logistic
regression with an L2 penalty is fitted on them. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.langid import letters, remainder
from offerloom.session import cut_lineage

#: Lengths of the n-grams, and buckets that they are hashed into (a power of two).
LENGTHS, BUCKETS = (4, 5, 6), 1 << 20
#: Bound of the training sample: labelled rows of each class, and the buckets that are kept.
SAMPLE_ROWS, FEATURES = 3_000, 2_000
#: Texts of the sample that a bucket must occur in.
LEAST_TEXTS = 5
#: Weight of the penalty and of the smoothing.
PENALTY, SMOOTHING = 0.2, 1.0
THRESHOLD = 0.7


def gram_buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of the letters (code points), in no certain order."""
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    out, code = [], points
    with np.errstate(over="ignore"):
        for n in range(2, max(LENGTHS) + 1):
            if len(points) < n:
                break
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            if n in LENGTHS:
                mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(44)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Model:
    """Kept buckets with their weight (ratio times coefficient), and the offset."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, offset: float):
        self.index = np.full(BUCKETS, -1, np.int16)
        self.index[buckets] = np.arange(len(buckets))
        self.weights, self.offset = weights, offset

    def score(self, text: str) -> float:
        found = self.index[gram_buckets(letters(text))]
        found = np.unique(found[found >= 0])
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.weights[found].sum(), -40, 40))))


def fit(held: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, ratio: np.ndarray) -> Model:
    """Model from the places (in ``kept``) that every sample text holds, its label, and the kept buckets' ratios."""
    if not len(kept) or not labels.any() or labels.all():
        base = (labels.sum() + SMOOTHING) / (len(labels) + 2 * SMOOTHING)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    x = np.zeros((len(held), len(kept)), np.float32)
    for row, places in enumerate(held):
        x[row, places] = ratio[places]
    coefficients, offset = _logistic(x, labels.astype(np.float32))
    return Model(kept, coefficients * ratio, offset)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient descent; deterministic."""
    n, width = x.shape
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    balance = balance.astype(np.float32)
    w, b, look_w, look_b = np.zeros(width, np.float32), 0.0, np.zeros(width, np.float32), 0.0
    norm, v = 0.0, np.full(width, width**-0.5, np.float32)
    for _ in range(15):  # the largest curvature, by power iteration
        v = x.T @ (balance * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= norm or 1
    lipschitz, penalty = 0.25 * (norm + 1) + PENALTY / n, PENALTY / n
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look_w + look_b, -40, 40)))
        gap = balance * (p - y)
        new_w, new_b = look_w - (x.T @ gap + penalty * look_w) / lipschitz, look_b - gap.sum() / lipschitz
        speed = k / (k + 3)
        look_w, look_b = new_w + speed * (new_w - w), new_b + speed * (new_b - b)
        w, b = new_w, new_b
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from up to ``SAMPLE_ROWS`` labelled documents of each class, the first in a hash order.

    Rows teach if their doc_id's remainder is not 1 and their label is 0 or 1; of several labels of one doc_id the
    largest counts. The sample's bound is fixed, so what comes to the driver does not grow with the tables.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = known.where(remainder() != 1).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE_ROWS)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(gram_buckets(letters(text or ""))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], ["doc_id", "toxic", "held"])

    held = cut_lineage(sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, held array<int>"), "grams")
    sizes = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = held.select(F.explode("held").alias("bucket"), "toxic").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    share = [(n + SMOOTHING) / (sizes.get(c, 0) + 2 * SMOOTHING) for c, n in enumerate((F.col("n") - F.col("n1"), F.col("n1")))]
    rated = counts.where(F.col("n") >= LEAST_TEXTS).withColumn("ratio", F.log(share[1] / share[0]))
    # How telling a bucket is: its ratio times the root of the texts that hold it.
    rated = rated.orderBy(F.desc(F.abs("ratio") * F.sqrt("n")), "bucket").limit(FEATURES).select("bucket", "ratio").collect()
    kept, ratio = np.array([r["bucket"] for r in rated], np.int64), np.array([r["ratio"] for r in rated])
    chosen = F.array(*map(F.lit, kept.tolist())).cast("array<int>")
    rows = held.select("doc_id", "toxic", F.array_intersect("held", chosen).alias("held")).orderBy("doc_id", "toxic").collect()
    place = {bucket: i for i, bucket in enumerate(kept.tolist())}
    return fit([np.array([place[b] for b in r["held"]], np.int64) for r in rows], np.array([r["toxic"] for r in rows], np.int64), kept, ratio)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts hold no features and score the model's offset. Without labels of both classes every text scores
    the smoothed share of toxic labels. A null doc_id is never held out. Every row is scored whole and kept; repeated
    doc_ids are scored row by row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(text or "") for text in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
