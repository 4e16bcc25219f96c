"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern on the JVM side. Every batch of documents reduces its pieces to the
distinct ones, ``fold`` merges each of those once over its byte array by the rank map, and the batch is then spelled out
as ids and decoded again from the binary pieces. Nothing is shuffled: a piece is folded in the batch that holds it, so
neither a frequent piece nor a huge source gathers rows. A worker keeps the pieces that it has folded, up to
``KEPT_PIECES``; that changes no result.

``merge_fold`` is the same fold as one Spark expression of higher-order functions over a literal rank map. It gives equal
ids but takes about 130 microseconds of CPU a piece, twenty times the batch fold, so the query does not use it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.langid import small
from offerloom.llm.workers import tidy

#: Folded pieces that a worker keeps before it starts again with none.
KEPT_PIECES = 100_000
#: Pieces up to so many bytes are folded by a plain scan, longer ones with a heap.
SHORT = 40
#: Slots of the rank map (a power of two) and the factors of its two hash functions.
SLOTS, HASHES = 1 << 18, ((40_503, 1), (92_821, 7_919))
NO_MERGE = 2_147_483_647
#: Letters and numbers of Unicode 14 to 16. The tokenizer's library knows them, the JVM's patterns (Unicode 13 in Java 17) do not.
NEWER_LETTERS = (
    r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}"
    r"\x{1C89}-\x{1C8A}\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}\x{A7C0}-\x{A7C1}\x{A7CB}-\x{A7CD}\x{A7D0}-\x{A7D1}"
    r"\x{A7D3}\x{A7D5}-\x{A7DC}\x{A7F2}-\x{A7F4}\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}"
    r"\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}"
    r"\x{105C0}-\x{105F3}\x{10780}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}\x{10D4A}-\x{10D65}"
    r"\x{10D6F}-\x{10D85}\x{10EC2}-\x{10EC4}\x{10F70}-\x{10F81}\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}"
    r"\x{11380}-\x{11389}\x{1138B}\x{1138E}\x{11390}-\x{113B5}\x{113B7}\x{113D1}\x{113D3}\x{11740}-\x{11746}"
    r"\x{11AB0}-\x{11ABF}\x{11BC0}-\x{11BE0}\x{11F02}\x{11F04}-\x{11F10}\x{11F12}-\x{11F33}\x{12F90}-\x{12FF0}"
    r"\x{1342F}\x{13441}-\x{13446}\x{13460}-\x{143FA}\x{16100}-\x{1611D}\x{16A70}-\x{16ABE}\x{16D40}-\x{16D6C}"
    r"\x{18CFF}\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}"
    r"\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}"
    r"\x{1E5D0}-\x{1E5ED}\x{1E5F0}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}\x{1E7ED}-\x{1E7EE}\x{1E7F0}-\x{1E7FE}"
    r"\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{2EBF0}-\x{2EE5D}\x{31350}-\x{323AF}"
)
NEWER_NUMBERS = (
    r"\x{10D40}-\x{10D49}\x{116D0}-\x{116E3}\x{11BF0}-\x{11BF9}\x{11F50}-\x{11F59}\x{16130}-\x{16139}"
    r"\x{16AC0}-\x{16AC9}\x{16D70}-\x{16D79}\x{1CCF0}-\x{1CCF9}\x{1D2C0}-\x{1D2D3}\x{1E4F0}-\x{1E4F9}"
    r"\x{1E5F1}-\x{1E5FA}"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with Unicode white space in ``\\s`` and ``\\S`` and letters and numbers of Unicode 16, as its own library reads it."""
    for name, newer in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
        # The outer range keeps the list of newer ranges away from most characters.
        pattern = pattern.replace(name, rf"[{name}[\x{{870}}-\x{{323AF}}&&[{newer}]]]")
    return "(?U)" + pattern


class Merger:
    """Folds ranked merges over byte arrays and remembers the pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.kept: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        found = self.kept.get(piece)
        if found is None:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            found = self.kept[piece] = self.fold(piece.encode())
        return found

    def fold(self, data: bytes) -> list[int]:
        """Token ids: the leftmost pair of the lowest rank is merged until no neighbouring pair has a rank."""
        parts = [self.single[b] for b in data]
        return self._heap(parts) if len(parts) > SHORT else self._scan(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NO_MERGE:
            at = ranks.index(low)
            parts[at : at + 2] = [low]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], low), NO_MERGE)
            if at < len(ranks):
                ranks[at] = get((low, parts[at + 1]), NO_MERGE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (new := get((rank, parts[after[i]]))) is not None:
                    heapq.heappush(heap, (new, i))
            if before[i] >= 0 and (new := get((parts[before[i]], rank))) is not None:
                heapq.heappush(heap, (new, before[i]))
        return [p for p in parts if p >= 0]


def encode_batches(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id and pieces in; doc_id, ids (packed little-endian int32) and the decoded bytes' digest columns out."""
    merger = Merger(ranks)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    names = [str(i) for i in range(len(tokens))]
    for batch in batches:
        pieces = batch.column("pieces")
        coded = pieces.flatten().dictionary_encode()  # of a slice, ``values`` would be those of the whole batch
        folded = [merger.ids(piece) for piece in coded.dictionary.to_pylist()]
        codes, offsets = coded.indices.to_numpy(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        counts, shas, decoded = [], [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ids = [i for code in codes[begin:end].tolist() for i in folded[code]]
            counts.append(len(ids))
            shas.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, sha-256 of the decimal ids joined by commas, and of the bytes decoded from them.

    A null text counts as empty: no tokens, and the digests of the empty string. Rows are kept as they are, repeated
    doc_ids and null ones included; other columns are ignored.
    """
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        yield from encode_batches(small(batches), shared.value)

    return docs.select(F.col("doc_id").cast("bigint"), pieces.alias("pieces")).mapInArrow(
        tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The rank map as a cuckoo table: each pair of ids lies in one of two slots, packed as first, second and merged id."""
    slots = [-1] * SLOTS
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                _place(slots, (((left << 16) | right) << 16) | rank)
    return slots


def _place(slots: list[int], entry: int) -> None:
    at = -1
    for _ in range(1000):
        left, right = entry >> 32, (entry >> 16) & 0xFFFF
        one, two = ((left * a + right * b) % SLOTS for a, b in HASHES)
        at = two if at == one else one
        if slots[one] < 0 or slots[two] < 0:
            at = one if slots[one] < 0 else two
        slots[at], entry = entry, slots[at]
        if entry < 0:
            return
    raise ValueError("the rank map does not fit its slots; raise SLOTS")


def literal(values: list[int], kind: str) -> Column:
    """A constant array; the optimizer folds it into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_fold(piece: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids (array of int) of a piece given as a string that is not empty.

    ``parts`` starts as the ids of the single bytes, ``ranks`` as the rank of every neighbouring pair. Every turn merges
    the leftmost pair of the lowest rank and looks up the two pairs that are new. A piece of n bytes needs n - 1 turns
    at most; a turn after the last merge hands the parts on.
    """
    table = literal(pair_table(ranks), "array<bigint>")
    single = literal([ranks[bytes([b])] for b in range(256)], "array<int>")
    return let(table, lambda t: let(single, lambda s: _fold(piece, t, s)))


def _fold(piece: Column, table: Column, single: Column) -> Column:
    def rank(left: Column, right: Column) -> Column:
        left, right = left.cast("bigint"), right.cast("bigint")
        entries = [F.get(table, ((left * a + right * b) % SLOTS).cast("int")) for a, b in HASHES]
        key, low = left * 65_536 + right, F.lit(65_535)
        hits = F.when(F.shiftright(entries[0], 16) == key, entries[0]).when(F.shiftright(entries[1], 16) == key, entries[1])
        return F.coalesce(hits.bitwiseAND(low).cast("int"), F.lit(NO_MERGE))

    def state(parts: Column, pairs: Column) -> Column:
        return let(pairs, lambda p: F.struct(parts.alias("parts"), p.alias("pairs"), F.array_min(p).alias("low")))

    def turn(acc: Column, _: Column) -> Column:
        return F.when(F.coalesce(acc["low"], F.lit(NO_MERGE)) == NO_MERGE, acc).otherwise(let(F.array_position(acc["pairs"], acc["low"]).cast("int"), lambda at: merge(acc["parts"], acc["pairs"], acc["low"], at)))

    def merge(parts: Column, pairs: Column, low: Column, at: Column) -> Column:
        size, none = F.size(parts), F.array().cast("array<int>")
        before = F.when(at > 1, F.array(rank(F.get(parts, at - 2), low))).otherwise(none)
        after = F.when(at + 1 < size, F.array(rank(low, F.get(parts, at + 1)))).otherwise(none)
        return state(
            F.concat(F.slice(parts, F.lit(1), at - 1), F.array(low), F.slice(parts, at + 2, size)),
            F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(pairs, at + 2, size)),
        )

    chars = F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(chars, lambda c: F.get(single, F.ascii(c)))
    begin = let(start, lambda p: state(p, F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), rank)))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(piece)), begin, turn, lambda acc: acc["parts"])
