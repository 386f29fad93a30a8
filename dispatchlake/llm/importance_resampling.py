"""Importance resampling towards a target corpus, by hashed n-gram features.

A document's features are its runs of 1 to `grams` words, hashed to buckets.
A bucket's gain is its log ratio of smoothed frequencies, target over source;
a document's weight is the floored mean of its features' gains. Gumbel noise
from a hash of the id turns the largest scores into a draw without replacement
in proportion to the weights.

Features are counted by batch: the texts of a batch are joined with a sentinel
between them, one pass of a regular expression finds all words, searchsorted on
the documents' offsets gives each word its document and masks n-grams that go
over a sentinel, and bincount sums. Two passes over the texts (corpus counts,
then weights) and one range shuffle of (doc_id, score); the driver gets two
numbers per bucket.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import small_batches
from dispatchlake.operators.ranking import ranked
from dispatchlake.session import stage

BUCKETS = 10_000
SEED = 2024
# letters in lower case, digits and all bytes beyond ASCII
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# bytes of texts that are joined at once, or one longer text
JOIN_BYTES = 1 << 20
SENTINEL = b"\n"


def joined(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Batches of texts: number of the first, the joined bytes, where each text begins."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = text.as_py()
        parts.append(raw.encode() if raw else b"")
        size += len(parts[-1]) + 1
        if size >= JOIN_BYTES:
            yield _join(first, parts)
            first, parts, size = k + 1, [], 0
    if parts:
        yield _join(first, parts)


def _join(first: int, parts: list[bytes]) -> tuple[int, bytes, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + len(SENTINEL)
    return first, SENTINEL.join(parts).translate(LOWER), np.cumsum(lengths) - lengths


def features(raw: bytes, begins: np.ndarray, grams: int, buckets: int):
    """Document and bucket of every feature of a joined batch, and words per document."""
    found = list(WORD.finditer(raw))
    words = [m.group() for m in found]
    starts = np.fromiter((m.start() for m in found), np.int64, len(found))
    doc = np.searchsorted(begins, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(begins))
    hashes = np.fromiter(map(crc32, words), np.int64, len(words))
    docs, found_buckets = [doc], [hashes % buckets]
    spaced = [b" " + w for w in words] if grams > 1 else []
    for n in range(1, grams):
        # crc32 goes on from the hash of the words before: the bytes of "a b" in one value
        hashes = np.fromiter(map(crc32, spaced[n:], hashes[: len(words) - n].tolist()), np.int64)
        inside = doc[n:] == doc[: len(doc) - n]
        docs.append(doc[n:][inside])
        found_buckets.append(hashes[inside] % buckets)
    return np.concatenate(docs), np.concatenate(found_buckets), counts


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of `texts` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, begins in joined(batch.column(0)):
                total += np.bincount(features(raw, begins, grams, buckets)[1], minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"]
        )

    parts = texts.where("text is not null").select("text").mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    # at most one row per bucket
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed frequencies), per bucket."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    out = []
    for s, t in zip(source.tolist(), target.tolist(), strict=True):
        ratio = ((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets))
        out.append(math.floor(1000 * math.log(ratio)))
    return np.array(out, np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * standard Gumbel), fixed by the id; a null id is an empty string."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, grams: int = 1, seed: int = SEED) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_features, weight, score."""
    small_batches(docs)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, begins in joined(batch.column(1)):
                ids = batch.column(0).slice(first, len(begins))
                doc, bucket, n_words = features(raw, begins, grams, buckets)
                n = np.bincount(doc, minlength=len(begins))
                # sums of whole numbers below 2^53 are exact in doubles
                sums = np.bincount(doc, weights=gain[bucket], minlength=len(begins))
                weight = np.where(n > 0, sums.astype(np.int64) // np.maximum(n, 1), 0)
                luck = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, (n_words, n, weight, weight + luck))],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (10, 100),
    least_words: int = 20,
    grams: int = 2,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Draw a share of `docs` (doc_id, text) so that it resembles `target` (text).

    Per row of `docs`: doc_id, n_words, n_features, weight, score, rank. Of the
    rows with `least_words` words or more, floor(share * their number) with the
    highest scores are drawn and ranked from 1; the rank of the others is null.
    Equal scores rank by doc_id (null last), then by n_features and weight, so
    rows that repeat a doc_id are rows of their own. Null and empty texts have
    no features and weight 0. Texts of any length are taken whole. Without
    `docs` there are no rows; without `target` all target counts are 0. Other
    columns are ignored.
    """
    small_batches(docs)
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    scored = stage(weigh(docs, gain, grams, seed), "resampling-scores")
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    most = share[0] * n // share[1]
    order = {
        "_by_score": -F.col("score"),
        "_no_id": F.col("doc_id").isNull(),
        "_row": F.monotonically_increasing_id(),
    }
    by = ["_by_score", "_no_id", "doc_id", "n_features", "weight", "_row"]
    eligible = ranked(scored.where(enough).withColumns(order), [], by, "_rank")
    place = F.col("_rank") + 1
    drawn = eligible.withColumn("rank", F.when(place <= most, place)).drop("_rank", *order)
    others = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others)
