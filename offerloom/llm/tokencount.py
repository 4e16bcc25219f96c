"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; a Viterbi pass over their ends carries the best score
and the number of pieces on that path, nothing else. The rules are those of unigram tokenizers: spaces become the mark
``\\u2581`` with one in front, a path's score is the sum of its pieces' scores, of equally good paths into a place the one
whose last piece starts first wins, and a character that is no piece of its own may be unknown, at the lowest score less
10, and counts as its UTF-8 bytes (byte fallback).

A text is cut where no piece can cross: before a run of spaces, and around line ends. Equal parts have equal counts, so a
worker keeps the counts it has worked out, up to ``KEPT_PARTS``; that changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_PARTS = 1_000_000
PARTS = re.compile(r"\x20*[^\x20\n]+|\x20+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, control and byte pieces left out."""

    scores: dict[str, float]

    @staticmethod
    def read(path: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids})


class Counter(dict):
    """Counts by part of a text, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        scores = vocabulary.scores
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in scores):
            raise ValueError("pieces that cross a space or a line end need another way to cut texts")
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.single = {piece for piece in scores if len(piece) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, part: str) -> int:
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[part] = count = self.viterbi(part.replace(" ", MARK))
        return count

    def viterbi(self, text: str) -> int:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for last, match in self.automaton.iter(text):
                ends[last].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            best, pieces = None, 0
            for length, value in sorted(ends[i], reverse=True):  # the longest starts first
                reached = score[i + 1 - length] + value
                if best is None or reached > best:
                    best, pieces = reached, count[i + 1 - length] + 1
            if text[i] not in self.single:
                reached = score[i] + self.unknown
                if best is None or reached > best:
                    best, pieces = reached, count[i] + len(text[i].encode("utf-8", "surrogatepass"))
            score[i + 1], count[i + 1] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, PARTS.findall(" " + text))) if text else 0


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: doc_id, n_chars (code points), n_tokens.

    Null and empty texts have no tokens. Every text is counted whole; rows are kept as they are, with repeated and null
    doc_ids; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.count(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")
