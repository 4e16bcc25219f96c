"""Language identification by cross-parsing entropy.

For every language one suffix automaton is built over a bounded sample of labelled text. A document is parsed against
each: a phrase is the longest match that starts where the phrase before it ended, and the language whose text explains
the document in the fewest phrases wins. Phrases are normalised by the letters parsed, so scores compare across lengths.

Texts are parsed in windows of ``WINDOW`` characters, each of which starts a new phrase; windows of many documents step
through the automaton together as array operations. Every window of the whole text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.workers import tidy
from offerloom.session import checked_broadcast, cut_lineage

WINDOW = 256
#: Bound of the training sample of a language: documents, and characters of each in spans spread over the whole text.
SAMPLE_DOCS, SAMPLE_CHARS, SPANS = 24, 1_000, 4
#: Characters of a language whose transitions lie in a dense table, the most frequent ones of its sample; those of all others lie
#: in a sorted list. That changes the time of a step and no result.
DENSE = 63
#: Rows that a worker takes at once, and characters that are parsed at once (a longer text is parsed alone).
BATCH_ROWS, BATCH_CHARS = 2_000, 500_000
NO_LANGUAGE = "und"


def _lowered() -> np.ndarray:
    """For every code point its lower case, or a space if it is no letter."""
    global _LOWERED
    if _LOWERED is None:
        _LOWERED = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                _LOWERED[code] = ord(c.lower()) if len(c.lower()) == 1 else code
    return _LOWERED


_LOWERED = None


def letters(text: str) -> np.ndarray:
    """The form that is parsed, as code points: lower-case letters, and one space for each run of other characters."""
    points = _lowered()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    return points[keep]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class Table:
    """Transitions of one language, by its own symbols: its sample's characters from the most frequent on, then one for all others.

    ``dense`` (state x symbol, -1 for none) has the first ``DENSE`` symbols and a last column without transitions; the others
    are in ``keys`` (state * symbols + symbol, sorted) with the states ``ends``. The state after the last one is where every
    symbol starts a new phrase; ``first`` leads there where a symbol matches nothing.
    """

    def __init__(self, text: np.ndarray, alphabet: np.ndarray):
        points, counts = np.unique(text, return_counts=True)
        ordered = points[np.lexsort((points, -counts))]
        self.symbols = len(ordered) + 1
        #: Symbol of each character of the common alphabet, whose last entry stands for characters outside it.
        self.of = np.full(len(alphabet) + 1, len(ordered), np.int32)
        self.of[np.searchsorted(alphabet, ordered)] = np.arange(len(ordered))
        nexts = suffix_automaton(self.of[np.searchsorted(alphabet, text)])
        width = min(DENSE, len(ordered))
        self.dense = np.full((len(nexts) + 1, width + 1), -1, np.int32)
        rest = {}
        for state, out in enumerate(nexts):
            for c, to in out.items():
                if c < width:
                    self.dense[state, c] = to
                else:
                    rest[state * self.symbols + c] = to
        self.keys = np.array(sorted(rest), np.int64)
        self.ends = np.array([rest[k] for k in self.keys.tolist()], np.int32)
        self.first = np.full(self.symbols, len(nexts), np.int32)
        self.first[list(nexts[0])] = list(nexts[0].values())

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where there is none."""
        width = self.dense.shape[1]
        to = self.dense.ravel()[state.astype(np.int64) * width + np.minimum(symbol, width - 1)]
        if len(self.keys):
            rare = np.flatnonzero((symbol >= width - 1) & (symbol < self.symbols - 1))
            if len(rare):
                asked = state[rare].astype(np.int64) * self.symbols + symbol[rare]
                at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
                to[rare] = np.where(self.keys[at] == asked, self.ends[at], -1)
        return to


class Model:
    """Suffix automata of the languages; ``plane`` maps code points to the common alphabet of all samples, however large."""

    def __init__(self, samples: dict[str, str]):
        texts = {lang: letters(text) for lang, text in samples.items()}
        alphabet = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]))
        self.plane = np.full(0x110000, len(alphabet), np.uint16 if len(alphabet) < 1 << 16 else np.uint32)
        self.plane[alphabet] = np.arange(len(alphabet))
        self.languages = sorted(texts)
        self.tables = [Table(texts[x], alphabet) for x in self.languages]


def phrases(tables: list[Table], windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of every window (a row of characters of the common alphabet, ``lengths`` of them used) against every table.

    A symbol without a transition ends the phrase and starts the next one; where it matches nothing at all it is a
    phrase of its own.
    """
    order = np.argsort(-lengths, kind="stable")
    windows, lengths = np.ascontiguousarray(windows[order].T), lengths[order]
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, windows.shape[0] + 1), "left")
    counts = np.zeros((len(tables), len(lengths)), np.int32)
    for k, table in enumerate(tables):
        state, count = table.first[table.of[windows[0]]], counts[k]
        for t, n in enumerate(alive.tolist()[1:], 1):
            if not n:
                break
            symbol = table.of[windows[t, :n]]
            to = table.step(state[:n], symbol)
            miss = to < 0
            count[:n] += miss
            state[:n] = np.where(miss, table.first[symbol], to)
        count += 1  # the phrase that is open at the end
    out = np.empty_like(counts)
    out[:, order] = counts
    return out


def predict_batch(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    names, scores, begin = [], [np.zeros(0)], 0
    while begin < len(texts):
        end, chars = begin + 1, len(texts[begin])
        while end < len(texts) and chars + len(texts[end]) <= BATCH_CHARS:
            chars += len(texts[end])
            end += 1
        found, score = _predict(texts[begin:end], model)
        names += found
        scores.append(score)
        begin = end
    return names, np.concatenate(scores)


def _predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    languages, tables, plane = model.languages, model.tables, model.plane
    rows, owners, lengths = [], [], []
    for i, text in enumerate(texts):
        points = letters(text)
        if not len(points) or (len(points) == 1 and points[0] == 32):
            continue
        n = -(-len(points) // WINDOW)
        padded = np.zeros(n * WINDOW, plane.dtype)
        padded[: len(points)] = plane[points]
        rows.append(padded.reshape(n, WINDOW))
        owners.append(np.full(n, i))
        lengths.append(np.minimum(len(points) - np.arange(n) * WINDOW, WINDOW))
    score, names = np.zeros(len(texts)), [NO_LANGUAGE] * len(texts)
    if not rows or not languages:
        return names, score
    owner, length = np.concatenate(owners), np.concatenate(lengths)
    counted = phrases(tables, np.concatenate(rows), length)
    per_text = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in counted])
    best = per_text.argmin(axis=0)
    ranked = np.sort(per_text, axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        margin = 1 - ranked[0] / ranked[1] if len(languages) > 1 else np.ones(len(texts))
    for i in np.unique(owner).tolist():
        names[i] = languages[best[i]]
        score[i] = margin[i]
    return names, score


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``BATCH_ROWS``, which bounds what a worker holds at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(begin, BATCH_ROWS)


def remainder() -> Column:
    """crc32 of the doc_id as text modulo 3; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def spread_spans(text: Column) -> Column:
    """A text of up to ``SAMPLE_CHARS`` characters, of longer ones that many in ``SPANS`` spans from its start to its end."""
    size = SAMPLE_CHARS // SPANS
    start = lambda k: (F.floor((F.length(text) - size) * k / (SPANS - 1)) + 1).cast("int")
    spans = F.concat_ws(" ", *(F.substring(text, start(k), F.lit(size)) for k in range(SPANS)))
    return F.when(F.length(text) > SAMPLE_CHARS, spans).otherwise(text)


def train(docs: DataFrame) -> Model:
    """Model from ``SAMPLE_DOCS`` documents of every language, the first distinct texts in a hash order.

    Rows teach if their doc_id's remainder is not 1 and neither lang nor text is null. Texts of up to 100 characters are
    taken only where longer ones run out. What comes to the driver is bounded per language, and no text is shuffled to
    choose or to fetch it (but the spans of a sample, where there are so many languages that the choice is no small table).
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 1))
    rows = rows.select("lang", "text", (F.length("text") <= 100).alias("short"), F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("short", "h")
    picked = rows.select("lang", "short", "h").distinct().withColumn("turn", F.row_number().over(order))
    picked = cut_lineage(picked.where(F.col("turn") <= SAMPLE_DOCS).select("lang", "short", "h"), "picked")
    spans = rows.select("lang", "short", "h", spread_spans(F.col("text")).alias("text"))
    chosen = spans.join(checked_broadcast(picked), ["lang", "short", "h"]).groupBy("lang", "short", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["short"], r["h"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model({lang: " ".join(texts) for lang, texts in samples.items()})


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    ``score`` is 1 - (phrases of the best language / phrases of the second), 0 for a tie. ``lang_pred`` is ``und`` with
    score 0 if the text is null or has no letter, or if no row could teach. Ties go to the first language by code point.
    A null doc_id counts as not held out. Long texts are parsed whole. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, score = predict_batch(batch.column("text").fill_null("").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, shared) -> DataFrame:
    """The rows with ``lang`` set to the predicted language; all other columns stay. ``shared`` is a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, _ = predict_batch(batch.column("text").fill_null("").to_pylist(), shared.value)
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
