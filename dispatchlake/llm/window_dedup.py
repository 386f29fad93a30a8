"""Substring removal by Rabin-Karp hashes of every fixed-length word window.

A window is removed when its word sequence also starts in a document with a
smaller doc_id. Each map task hashes the windows of its documents and sends
every distinct window once, under the smallest doc_id it saw; larger ones of the
same task are known to be repeats without a shuffle, so a passage in a third of
all documents costs one row per task. Rows are sorted by hash, and the first of
each run is the owner. Only repeated windows travel back to their documents.

A window is known by 96 bits: a 64-bit and an independent 32-bit polynomial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm import packed
from dispatchlake.llm.common import byte_words, keep_only, small_batches

WINDOW = 13
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd
# cached words and the longest of them, in bytes
CACHE_WORDS, CACHE_LENGTH = 250_000, 64
# windows that a map task compares at once before it sends them
MAP_WINDOWS = 3_000_000

_hashes: dict[bytes, bytes] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit numbers per word, one row for each."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    if not _hashes:
        keep_only("hashes", _hashes.clear)
    long = {}
    for word in set(words).difference(_hashes):
        digest = hashlib.blake2b(word, digest_size=16).digest()
        (_hashes if len(word) <= CACHE_LENGTH else long)[word] = digest
    of = _hashes.__getitem__ if not long else lambda w: _hashes.get(w) or long[w]
    return np.frombuffer(b"".join(map(of, words)), "<u8").reshape(-1, 2).T


def window_hashes(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of the window at each word: 64 bits, and 32 bits more.

    H(i) = sum of w(i+j) * base^(window-1-j) modulo 2^64, evaluated by Horner's
    rule for all windows of a document at once.
    """
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second = (
        _rolled(values, base, window)
        for values, base in zip(word_hashes(words), BASES, strict=True)
    )
    return first.view(np.int64), (second >> np.uint64(32)).astype(np.int64)


def first_hashes(words: list[bytes], window: int) -> np.ndarray:
    """The 64 bits of `window_hashes` alone."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    return _rolled(word_hashes(words)[0], BASES[0], window).view(np.int64)


def _rolled(values: np.ndarray, base: np.uint64, window: int) -> np.ndarray:
    values = np.ascontiguousarray(values)
    n = len(values) - window + 1
    total = values[:n].copy()
    for j in range(1, window):
        total *= base
        total += values[j : j + n]
    return total


def _pack(
    batch: int, docs: list[tuple[int, np.ndarray, np.ndarray]], blocks: int
) -> Iterator[pd.DataFrame]:
    """Distinct windows of these documents by block, and the repeats already known here."""
    ids = np.concatenate([np.full(len(h), d, np.int64) for d, h, _ in docs])
    first = np.concatenate([h for _, h, _ in docs]).view(np.uint64)
    second = np.concatenate([g for _, _, g in docs])
    order = np.lexsort((ids, second, first))
    ids, first, second = ids[order], first[order], second[order]
    new = np.ones(len(ids), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    owner = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    late = ids != owner
    for chosen, done in ((new, False), (late, True)):
        if not chosen.any():
            continue
        own, hashes, more = ids[chosen], first[chosen], second[chosen]
        order = np.argsort(own, kind="stable")
        own, hashes, more = own[order], hashes[order], more[order]
        if done:
            block = batch % blocks  # any task may pass them on
            row = (block, batch, *packed.by_doc(own, hashes), True)
            yield pd.DataFrame([row], columns=packed.NAMES)
        else:
            yield packed.rows_by_block(batch, own, more % blocks, hashes, blocks)


def sent_windows(docs: DataFrame, window: int, map_windows: int, blocks: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n, number = [], 0, 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                first, second = window_hashes(byte_words(text), window)
                if len(first):
                    waiting.append((int(doc_id), first, second))
                    n += len(first)
                if n >= map_windows:
                    yield from _pack(packed.batch_key(number), waiting, blocks)
                    waiting, n, number = [], 0, number + 1
        if waiting:
            yield from _pack(packed.batch_key(number), waiting, blocks)

    return (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", "text")
        .mapInPandas(run, packed.ROW)
    )


def late_windows(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Entries whose hash a smaller doc_id also has."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    least = np.minimum.reduceat(ids[order], np.nonzero(new)[0])
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > least[np.cumsum(new) - 1]
    return out


def repeated_windows(docs: DataFrame, window: int, map_windows: int) -> DataFrame:
    """doc_id and the hashes of its windows that a smaller doc_id also has, in pieces."""
    # words are a blank and more; blocks need their number only roughly
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = packed.n_blocks(total // 6)
    sent = sent_windows(docs, window, map_windows, blocks)
    return packed.marked(sent, blocks, 8, late_windows, send_hashes=True)


def removal_mask(words: list[bytes], repeated: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """True for words that a repeated window covers."""
    first, _ = window_hashes(words, window)
    starts = np.nonzero(np.isin(first, repeated))[0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, end exclusive."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, map_windows: int = MAP_WINDOWS
) -> DataFrame:
    """Cut repeated windows out of `docs` (doc_id, text).

    Per row: doc_id, n_words, n_removed, removed (array of word intervals, end
    exclusive, merged to maximal ones), kept_text (kept words joined by one
    blank). Null and empty texts have no words. Rows that share a doc_id are one
    document to the rule: they do not remove each other's windows, but each loses
    what a smaller doc_id has. A null doc_id is neither smaller nor larger than
    any: its rows stay whole and remove nothing. An empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = repeated_windows(docs, window, map_windows).withColumnRenamed("hashes", "known")
    # at most one list per document, no longer than its text
    repeated = pieces.groupBy("doc_id").agg(F.collect_list("known").alias("known"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, known in frame.itertuples(index=False):
                words = byte_words(text)
                spans: list[tuple[int, int]] = []
                n_removed, kept = 0, words
                if known is not None and len(known):
                    mask = removal_mask(words, np.frombuffer(b"".join(known), "<i8"), window)
                    spans, n_removed = intervals(mask), int(mask.sum())
                    kept = [w for w, gone in zip(words, mask, strict=True) if not gone]
                joined = b" ".join(kept).decode()
                known_id = None if pd.isna(doc_id) else int(doc_id)
                spans = [{"start": a, "end": b} for a, b in spans]
                out.append((known_id, len(words), n_removed, spans, joined))
            names = ["doc_id", "n_words", "n_removed", "removed", "kept_text"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return (
        docs.join(repeated, "doc_id", "left")
        .select("doc_id", "text", "known")
        .mapInPandas(
            run,
            "doc_id long, n_words long, n_removed long,"
            " removed array<struct<start: long, end: long>>, kept_text string",
        )
    )
