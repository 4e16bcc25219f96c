"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A text is cut into pieces: paragraphs (lines), and these at sentence ends. Every piece hashes to a wide vector with a value
of up to 56 bits in each of ``LANES`` lanes, by one seeded hash a lane. The fingerprint is the sum of the vectors modulo
2^56 in each lane. Sums don't depend on order, so texts with the same pieces are equal whatever their order, and a piece
is inserted or deleted by adding or subtracting its vector (``add``, ``subtract``), also on stored sums.

The low ``SIGN_BITS`` bits of a lane's value are +1 or -1 by the hash, those above are random. So the low bits of a sum hold
a random projection of the piece counts, and two sums tell the cosine of the counts of their texts (``likeness``), with a
standard error of 1 / sqrt(``LANES``) or less for texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 128
#: Lane sums are taken modulo this power of two.
MODULUS_BITS = 56
#: Low bits of a lane that hold a signed sum; texts of up to 2^23 pieces fit.
SIGN_BITS = 24
PIECE_END = r"\n+|(?<=[.!?])\s+"
#: Ranges of doc_id that an approximate quantile cuts, rows that a range is divided for, and the quantile's accuracy.
QUANTILES, ROWS_PER_PART = 64, 2_000


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << MODULUS_BITS) - 1))


def pieces(text: Column) -> Column:
    """Non-empty pieces of a text; none for null or white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PIECE_END), lambda p: F.length(F.trim(p)) > 0)


def vector(text: Column) -> Column:
    """Vector of a text: the sums of all lanes, zeros for a text without pieces."""
    # Random bits above the signed part, and its second bit; less one for each piece, that bit is +1 or -1.
    used = F.lit((1 << MODULUS_BITS) - (1 << SIGN_BITS) + 2)
    lanes = F.array(*(F.lit(lane) for lane in range(LANES)))
    # The lane comes first and so seeds the hash of the piece: pieces that collide in one lane don't in the others.
    total = lambda ps, lane: F.aggregate(ps, F.lit(0).cast("bigint"), lambda acc, p: _low(acc + F.xxhash64(lane, p).bitwiseAND(used)))
    return let(pieces(text), lambda ps: F.transform(lanes, lambda lane: _low(total(ps, lane) - F.size(ps))))


def add(left: Column, right: Column) -> Column:
    """Vector of the pieces of both: insertion."""
    return F.zip_with(left, right, lambda a, b: _low(a + b))


def subtract(left: Column, right: Column) -> Column:
    """Vector of the left pieces without the right ones: deletion."""
    return F.zip_with(left, right, lambda a, b: _low(a - b))


def digest(vec: Column) -> Column:
    """sha-256 of a vector as lowercase hex, one string for equal multisets of pieces."""
    return F.sha2(F.array_join(F.transform(vec, lambda v: F.hex(v)), ","), 256)


def likeness(left: Column, right: Column) -> Column:
    """Estimated cosine of the piece counts, 0 to 1; two texts without pieces are alike (1), one without is unlike (0)."""
    signed = lambda v: F.transform(v, lambda x: F.shiftright(F.shiftleft(x, 64 - SIGN_BITS), 64 - SIGN_BITS).cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def cosine(p: Column) -> Column:
        both = dot(p["l"], p["l"]) * dot(p["r"], p["r"])
        shared = F.when(both > 0, dot(p["l"], p["r"]) / F.sqrt(both)).otherwise(0.0)
        return F.when(p["same"], 1.0).otherwise(F.least(F.greatest(shared, F.lit(0.0)), F.lit(1.0)))

    return let(F.struct(signed(left).alias("l"), signed(right).alias("r"), (left == right).alias("same")), cosine)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending doc_id; after the last, the first row's.

    Rows are cut into ranges of doc_id, with a range's rows ordered within it and only its first row handed to the range
    above it. Null doc_ids come last; ties are ordered by text. A single row is its own next. Null texts count as empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, cuts = rows.agg(F.count("doc_id"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()
    cuts = sorted(set(cuts or []))
    # Within two cuts, ranges of equal width; as many as hold some ROWS_PER_PART rows each where ids are even.
    parts = max(1, n // (QUANTILES * ROWS_PER_PART))
    bounds = F.array(*(F.lit(c).cast("bigint") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    slot = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    low, high = (F.get(bounds, F.col("slot") - k).cast("double") for k in (1, 0))
    inner = F.when(low.isNull() | high.isNull(), 0).otherwise(F.floor((F.col("doc_id") - low) * parts / (high - low)))
    rows = rows.withColumn("slot", F.when(F.col("doc_id").isNull(), -1).otherwise(slot))
    rows = rows.withColumn("part", F.col("slot").cast("bigint") * parts + F.coalesce(inner, F.lit(0)))
    within = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    paired = rows.select("doc_id", "text", "part", F.lead("text").over(within).alias("next_text"), F.row_number().over(within).alias("place"))
    # A part's last row goes on with the first row of the next part below that has rows. That order has one row a part.
    ids = rows.select("part").distinct()
    below = F.lead("part").over(Window.orderBy(F.desc("part")))
    highest = ids.agg(F.max("part")).first()[0]
    ids = ids.select(F.col("part").alias("p"), F.coalesce(below, F.lit(highest)).alias("below"))
    heads = paired.where("place = 1").select(F.col("part").alias("below"), F.col("text").alias("head"))
    after = ids.join(heads, "below").select("p", "head")
    last = paired.where("next_text is null").join(after, F.col("part") == F.col("p")).select("doc_id", "text", F.col("head").alias("next_text"))
    return paired.where("next_text is not null").select("doc_id", "text", "next_text").unionByName(last)


def edited(text: Column, other: Column) -> Column:
    """The last third (rounded down) of the characters replaced by as many first characters, or all, of the other text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lanes, edited_lanes.

    ``lanes`` and ``edited_lanes`` are the sums that the fingerprints digest; pieces are inserted and deleted there. Null and empty texts have the fingerprint of no pieces; they are alike (1) to each other and unlike (0) all others.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    vectors = F.struct(vector(F.col("text")).alias("own"), vector(F.col("edited")).alias("edited"), vector(F.col("next_text")).alias("next"))
    known = let(
        vectors,
        lambda v: F.struct(
            digest(v["own"]).alias("fingerprint"),
            digest(v["edited"]).alias("edited_fingerprint"),
            likeness(v["own"], v["edited"]).alias("near_edited"),
            likeness(v["own"], v["next"]).alias("near_next"),
            v["own"].alias("lanes"),
            v["edited"].alias("edited_lanes"),
        ),
    )
    out = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), known.alias("k"))
    return out.select("doc_id", "n_chars", "edited_sha256", "k.fingerprint", "k.edited_fingerprint", "k.near_edited", "k.near_next", "k.lanes", "k.edited_lanes")
