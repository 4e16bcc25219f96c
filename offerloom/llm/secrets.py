"""Secrets in texts: fixed patterns, and guess costs of values in a credential context.

Base spans come from three patterns. The method then looks at every value that stands in a credential context (a wider
set of names than the base pattern has, and the password part of a URL) and works out how many guesses it would take:
the cheapest segmentation into common words (fixed ones and the most frequent words of the table), marks, dates, repeats,
keyboard walks, sequences and brute-force spans, found by dynamic programming over the whole value. Values that take ``LEAST_GUESSES`` or more are spans of kind ``guess``; cheap ones such as
``password=changeme`` are placeholders and add none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.langid import small
from offerloom.llm.workers import tidy

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")

#: Names before a value that make it a credential, and the password of a URL. A value ends at whitespace or its quote.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|bearer|api[_-]?key|(?:private|access|client|auth|signing|secret|encryption|session)[_-]?(?:access[_-]?)?(?:key|token|secret))"""
    r"""["']?\x20*(?:[:=]\x20*|\bis\x20)|authorization["']?\x20*[:=]\x20*["']?(?:bearer|basic|token)\x20+)"""
    r"""(?:"(?P<double>[^\s"]+)|'(?P<single>[^\s']+)|(?P<bare>[^\s"']\S*))"""
    r"""|(?<![a-z0-9+.-])[0-9+.-]*[a-z][a-z0-9+.-]*://[^\s:/@"']*:(?P<url>[^\s/"'<>]+)@""",
    re.I | re.A,
)
CONTEXT_HINT = re.compile(r"[:=]|\bis ", re.A)

LEAST_GUESSES = 1e8
#: A value in prose ("the token is well-established") has letters, hyphens and closing marks only.
PROSE = re.compile(r"""[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\]"'*]*""")
BEFORE_PROSE = re.compile(r"""\bis\x20["']?\Z""", re.I | re.A)
#: An address without a user's part, and what stands between its pieces.
ADDRESS = re.compile(r"(?:https?|ftp)://[^\s@]+", re.I | re.A)
PIECES = re.compile(r"[/?&=.,:;#)+-]+|%[0-9A-Fa-f]{2}")
#: Marks between the parts of a value, and log10 of the guesses for one of them.
MARKS, MARK_COST = "-_./, ", 0.8

#: Common words of passwords and placeholders, most common first (fixed values).
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login secret changeme example sample dummy test"
    " default user root guest null none true false token value your here my pass key api server client house love"
    " summer winter spring autumn football baseball shadow sunshine princess iloveyou hello world abc test123 company"
    " demo temp temporary placeholder redacted hidden private public access account db data base prod dev stage"
).split()
RANK = {word: i + 1 for i, word in enumerate(WORDS)}
#: Bounds of the words taken from a table: their number, their length, and the rows of a word at least.
TABLE_WORDS, LONGEST, LEAST_ROWS = 10_000, 24, 3
TABLE_WORD = r"(?<![\p{L}\p{N}_])\p{L}{2,24}(?![\p{L}\p{N}_])"
LEET = str.maketrans("@4301!$57", "aaeoiissT".lower())
#: Rows of a keyboard, read both ways (fixed values).
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
NEXT_KEY = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def common_words(docs: DataFrame) -> dict[str, int]:
    """Ranks of words: the fixed ones, then up to ``TABLE_WORDS`` of the table by the number of rows that hold them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TABLE_WORD), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    found = counts.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).collect()
    return {row["word"]: len(WORDS) + i + 1 for i, row in enumerate(found)} | RANK


def _charset(text: str) -> int:
    size = 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 10 * any(c.isdigit() for c in text)
    return max(10, size + 33 * any(not c.isalnum() for c in text))


def _segments(text: str, rank_of: dict[str, int] = RANK) -> Iterator[tuple[int, int, float]]:
    """Cheap segments (start, end, log10 of guesses) of a part."""
    low, n = text.lower(), len(text)
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 0.7)):
                if (rank := rank_of.get(form[i:j])) is not None:
                    upper = 0.0 if text[i:j].islower() or not any(c.isupper() for c in text[i:j]) else 0.5
                    yield i, j, math.log10(rank) + extra + upper
                    break
        if text[i] in MARKS:
            yield i, i + 1, MARK_COST
        if (m := DATE.match(text, i)) is not None:
            yield i, m.end(), 2.1 if m.end() - i == 4 else 4.6
    for start, same in ((0, _repeats), (0, _walk), (0, _sequence)):
        begin = start
        for i in range(1, n + 1):
            if i == n or not same(low, i):
                if i - begin >= 3:
                    yield begin, i, 1.3 + math.log10(i - begin)
                begin = i
    for unit in range(2, 9):  # a repeated unit costs its first copy and the count
        i = 0
        while i + 2 * unit <= n:
            k = 1
            while low[i + k * unit : i + (k + 1) * unit] == low[i : i + unit]:
                k += 1
            if k > 1:
                yield i, i + k * unit, unit * math.log10(_charset(text[i : i + unit])) + math.log10(k)
                i += (k - 1) * unit
            i += 1


def _repeats(text: str, i: int) -> bool:
    return text[i] == text[i - 1]


def _walk(text: str, i: int) -> bool:
    return (text[i - 1], text[i]) in NEXT_KEY


def _sequence(text: str, i: int) -> bool:
    return abs(ord(text[i]) - ord(text[i - 1])) == 1


def guess_cost(value: str, rank_of: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of the whole value takes; 0 for an empty value.

    A segmentation costs the sum over its segments and the log of the orders of its segments; characters outside cheap
    segments cost log10 of the value's character set each. The dynamic program keeps the best cost by end, in time
    proportional to the value's length.
    """
    ends: list[list[tuple[int, float]]] = [[] for _ in range(len(value) + 1)]
    for i, j, cost in _segments(value, rank_of):
        ends[j].append((i, cost))
    brute = math.log10(_charset(value))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = min([best[j - 1] + brute, *(best[i] + cost + 0.3 for i, cost in ends[j])])
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by kind and place. Offsets count code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = LONG_HEX.search(text)
    if at:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, at.start()) if m.end() - m.start() >= 24]
    return found


def guessed_spans(text: str, rank_of: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """Values in a credential context that are costly to guess.

    After "is" a value of letters and hyphens alone is prose and no credential. An address without a user's part is priced by
    its costliest piece, so only one that carries a key counts.
    """
    if not CONTEXT_HINT.search(text):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastgroup)
        value = text[a:b]
        if PROSE.fullmatch(value) and BEFORE_PROSE.search(text, max(0, a - 5), a):
            continue
        pieces = PIECES.split(value) if ADDRESS.fullmatch(value) else [value]
        if max(guess_cost(p, rank_of) for p in pieces) >= math.log10(LEAST_GUESSES):
            found.append((a, b, "guess"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    Every row is scanned whole and kept, with repeated and null doc_ids. A null text counts as empty: no spans, and the
    digest of the empty string. Other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts: list[list[int]] = [[], [], [], []]
            shas, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = guessed_spans(text or "", ranks.value)
                for kind, out in zip(KINDS, counts):
                    out.append(sum(s[2] == kind for s in (more if kind == "guess" else base)))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their text replaced by ``mark``; all columns stay, null texts stay null.

    Overlapping spans are replaced as one.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if text is None else _replaced(text, mark, ranks.value) for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def _replaced(text: str, mark: str, rank_of: dict[str, int]) -> str:
    out, last = [], 0
    for a, b, _ in sorted(base_spans(text) + guessed_spans(text, rank_of)):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])
