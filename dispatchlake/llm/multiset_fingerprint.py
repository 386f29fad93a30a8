"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs: lines, cut further after sentence
ends and every 512 code points, so that a text without either has parts too. Each paragraph hashes to a wide vector, and a fingerprint is the sum of
the vectors, each lane modulo 2^62. Order does not matter, and adding or
subtracting one paragraph's vector inserts or deletes it.

Lanes: the number of paragraphs; 8 lanes of 62 hash bits, which decide
equality; 63 lanes that hold three counters of 21 bits each, every counter the
number of paragraphs with a certain hash bit. Two texts' counters differ by a
random walk over the paragraphs they do not share, so the mean square of the
differences estimates how many those are, within about 10 % for 189 counters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARAGRAPH = r"\n|(?<=[.!?])\x20"
PIECE = "(?s).{1,512}"
EQUAL_LANES = 8
COUNT_HASHES = 3
COUNT_LANES = 21 * COUNT_HASHES
LANES = 1 + EQUAL_LANES + COUNT_LANES
MODULUS_MASK = (1 << 62) - 1
FIELDS = 1 | 1 << 21 | 1 << 42  # one bit in each of three counters
FIELD = (1 << 21) - 1
BUCKET_ROWS = 512
MAX_BUCKETS = 65_536


def paragraphs(text: Column) -> Column:
    """The non-empty paragraphs of a text; none for null."""
    cut = F.split(F.coalesce(text, F.lit("")), PARAGRAPH)
    return F.flatten(F.transform(cut, lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))))


def vector(paragraph: Column) -> Column:
    """The lanes that one paragraph adds."""
    hashes = F.transform(
        F.array(F.sha2(paragraph, 256)),
        lambda d: F.array(*[F.xxhash64(d, F.lit(k)) for k in range(EQUAL_LANES + COUNT_HASHES)]),
    )
    mask, fields = F.lit(MODULUS_MASK), F.lit(FIELDS)

    def counters(hash_: Column) -> Column:
        places = F.array(*[F.lit(j) for j in range(21)])
        bits = lambda j: F.call_function("shiftrightunsigned", hash_, j)
        return F.transform(places, lambda j: bits(j).bitwiseAND(fields))

    def lanes(h: Column) -> Column:
        equal = F.transform(F.slice(h, 1, EQUAL_LANES), lambda x: x.bitwiseAND(mask))
        more = [counters(F.element_at(h, EQUAL_LANES + 1 + k)) for k in range(COUNT_HASHES)]
        return F.concat(F.array(F.lit(1).cast("long")), equal, *more)

    return F.element_at(F.transform(hashes, lanes), 1)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LANES)


def insert(fingerprint: Column, vec: Column) -> Column:
    """Fingerprint with a paragraph's vector, or another fingerprint, added."""
    return F.zip_with(fingerprint, vec, lambda a, b: (a + b).bitwiseAND(F.lit(MODULUS_MASK)))


def delete(fingerprint: Column, vec: Column) -> Column:
    """Fingerprint without a paragraph (or text) that it holds."""
    return F.zip_with(fingerprint, vec, lambda a, b: (a - b).bitwiseAND(F.lit(MODULUS_MASK)))


def fingerprint(text: Column) -> Column:
    """Array of LANES longs; all zero for a null or empty text."""
    vectors = F.transform(paragraphs(text), vector)
    return F.aggregate(vectors, zero(), insert)


def as_text(lanes: Column) -> Column:
    """Lower-case hex of the lanes."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.hex(x)), "."))


def likeness(a: Column, b: Column) -> Column:
    """1 - (paragraphs not shared) / (paragraphs of both), estimated; 1 for equal ones.

    Counter differences are taken as signs: twice the difference less that of
    the numbers of paragraphs is a sum of +1 and -1 per paragraph not shared.
    """
    n, m = F.element_at(a, 1), F.element_at(b, 1)
    width, field = F.lit(21), F.lit(FIELD)

    def square(x: Column, y: Column) -> Column:
        d = (x - y) * 2 - (n - m)
        return (d * d).cast("double")

    def squares(x: Column, y: Column) -> Column:
        x1, y1 = F.call_function("shiftright", x, width), F.call_function("shiftright", y, width)
        return (
            square(x.bitwiseAND(field), y.bitwiseAND(field))
            + square(x1.bitwiseAND(field), y1.bitwiseAND(field))
            + square(F.call_function("shiftright", x1, width), F.call_function("shiftright", y1, width))
        )

    first = EQUAL_LANES + 2
    per_lane = F.zip_with(F.slice(a, first, COUNT_LANES), F.slice(b, first, COUNT_LANES), squares)
    mean = F.aggregate(per_lane, F.lit(0.0), lambda s, x: s + x) / F.lit(3.0 * COUNT_LANES)
    share = F.greatest(F.lit(0.0), F.lit(1.0) - mean / (n + m))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def with_next(docs: DataFrame, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add next_<column> of the document that follows in descending doc_id.

    After the smallest doc_id comes the largest. Equal ids follow their texts;
    null ids come after all others. Buckets are ranges of doc_id between actual
    ids, so each row moves once; the document at a bucket's upper bound also goes
    to the bucket above, where it follows the last row.
    """
    n = max(1, min(MAX_BUCKETS, -(-docs.count() // bucket_rows)))
    cuts = [F.lit((k + 1) / n) for k in range(n)]
    found = docs.agg(
        F.percentile_approx("doc_id", F.array(*cuts), F.lit(max(10_000, 10 * n)))
    ).first()[0]
    bounds = sorted(set(found or [0]))
    step = math.isqrt(len(bounds)) + 1

    def listed(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    coarse = listed(bounds[step - 1 :: step] or [bounds[-1]])
    below = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step
    near = F.slice(listed(bounds), below + 1, F.lit(step))
    bucket = below + F.size(F.filter(near, lambda b: b < F.col("doc_id")))
    placed = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    at_bound = F.col("doc_id") == F.element_at(listed(bounds), F.col("_bucket") + 1)
    above = F.when(F.col("_bucket") == len(bounds) - 1, 0).otherwise(F.col("_bucket") + 1)
    copies = F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("extra")),
        F.when(at_bound, F.struct(above.alias("b"), F.lit(True).alias("extra"))),
    )
    dealt = placed.select(
        "*", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("_copy")
    ).withColumns({"_bucket": F.col("_copy.b"), "_extra": F.col("_copy.extra")})
    order = Window.partitionBy("_bucket").orderBy(
        "_extra", F.col("doc_id").desc_nulls_last(), "text"
    )
    following = {f"next_{c}": F.lead(c).over(order) for c in carried}
    return dealt.withColumns(following).where("not _extra").drop("_bucket", "_copy", "_extra")


def fingerprint_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of `docs` (doc_id, text), of an edit of each, and their likeness.

    The edit replaces the last half of a text (rounded down, code points) by the
    first as many, or all, of the next document's in descending doc_id. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty; repeated rows follow each other; a table of
    one row is its own next; an empty table gives no rows; other columns are
    ignored. Counters overflow into each other beyond two million paragraphs in a
    text: equality still holds then, likeness does not.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("lanes", fingerprint(F.col("text")))
    paired = with_next(own, ["text", "lanes"], bucket_rows)
    # a lone null id has nobody after it but itself
    paired = paired.withColumns(
        {
            "next_text": F.coalesce("next_text", "text"),
            "next_lanes": F.coalesce("next_lanes", "lanes"),
            "n_chars": F.length("text").cast("long"),
        }
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = paired.withColumn(
        "edited", F.concat(kept, F.substring("next_text", F.lit(1), half))
    ).withColumn("edited_lanes", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
