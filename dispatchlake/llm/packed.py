"""Exchange of hashes in packed blocks: to their owners by hash, and back by batch.

A map task packs the distinct hashes of a batch of documents, one row per block
of hash space. A block's task marks the hashes of each row and sends the marks
back under the row's batch, where they are gathered per document. Rows number
blocks times batches, whatever the documents; a hash that a third of all
documents hold comes once per batch if the packer merges it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# batch of hashes that only witness: their marks go to nobody
WITNESS = -1

# hashes that a map task packs at once, and that one block gets
MAP_HASHES = 1_000_000
BLOCK_HASHES = 2_000_000

ROW = "block int, batch long, docs binary, counts binary, hashes binary, done boolean"
NAMES = ["block", "batch", "docs", "counts", "hashes", "done"]


def n_blocks(total: int) -> int:
    return max(1, -(-total // BLOCK_HASHES))


def batch_key(number: int) -> int:
    """A key that no other batch of the stage has; repeated tasks get theirs again."""
    return TaskContext.get().partitionId() << 32 | number


def rows_by_block(
    batch: int, ids: np.ndarray, blocks: np.ndarray, hashes: np.ndarray, n: int
) -> pd.DataFrame:
    """One row per block; `ids` are sorted, one per hash."""
    order = np.argsort(blocks, kind="stable")
    ends = np.searchsorted(blocks[order], np.arange(n + 1))
    rows = []
    for b in np.nonzero(np.diff(ends))[0]:
        own = order[ends[b] : ends[b + 1]]
        rows.append((int(b), batch, *by_doc(ids[own], hashes[own]), False))
    return pd.DataFrame(rows, columns=NAMES)


def by_doc(ids: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Document ids, hashes of each, and the hashes; equal ids stand together."""
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    starts = np.nonzero(new)[0]
    counts = np.diff(np.append(starts, len(ids))).astype("<u4")
    return ids[starts].astype("<i8").tobytes(), counts.tobytes(), hashes.tobytes()


def entries(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document id and hash of every entry of a packed row."""
    counts = np.frombuffer(row.counts, "<u4")
    return np.repeat(np.frombuffer(row.docs, "<i8"), counts), np.frombuffer(row.hashes, f"<u{width}")


def marked(
    packed: DataFrame,
    blocks: int,
    width: int,
    mark: Callable[[np.ndarray, np.ndarray], np.ndarray],
    send_hashes: bool,
) -> DataFrame:
    """doc_id, n and hashes of the entries that `mark(ids, hashes)` chooses in their block.

    One block is held at a time, then one batch. Rows that are `done` pass as they are.
    """

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(rows: list) -> pd.DataFrame:
            parts = [entries(r, width) for r in rows]
            chosen = mark(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            out, at = [], 0
            for row, (ids, hashes) in zip(rows, parts, strict=True):
                own = chosen[at : at + len(ids)]
                at += len(ids)
                if own.any():
                    docs, counts, data = by_doc(ids[own], hashes[own])
                    out.append((row.batch, docs, counts, data if send_hashes else b""))
            return pd.DataFrame(out, columns=["batch", "docs", "counts", "hashes"])

        held, at = [], None
        for frame in frames:
            passed = frame["done"].to_numpy(bool)
            if passed.any():
                yield frame.loc[passed, ["batch", "docs", "counts", "hashes"]]
            for row in frame[~passed].itertuples(index=False):
                if row.block != at and held:
                    yield judged(held)
                    held = []
                at = row.block
                held.append(row)
        if held:
            yield judged(held)

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def gathered(rows: list) -> pd.DataFrame:
            ids = np.concatenate([np.frombuffer(r.docs, "<i8") for r in rows])
            counts = np.concatenate([np.frombuffer(r.counts, "<u4") for r in rows]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            docs, starts = np.unique(ids[order], return_index=True)
            sums = np.add.reduceat(counts[order], starts)
            data: list = [None] * len(docs)
            if send_hashes:
                flat = np.concatenate([np.frombuffer(r.hashes, f"<u{width}") for r in rows])
                each = np.split(flat, np.cumsum(counts)[:-1])
                ends = np.append(starts[1:], len(order))
                data = [
                    b"".join(each[k].tobytes() for k in order[a:b])
                    for a, b in zip(starts, ends, strict=True)
                ]
            return pd.DataFrame({"doc_id": docs, "n": sums, "hashes": data})

        held, at = [], None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.batch != at and held:
                    yield gathered(held)
                    held = []
                at = row.batch
                held.append(row)
        if held:
            yield gathered(held)

    back = (
        packed.repartition(blocks, "block")
        .sortWithinPartitions("block")
        .mapInPandas(judge, "batch long, docs binary, counts binary, hashes binary")
        .where(F.col("batch") != WITNESS)
    )
    return (
        back.repartition("batch")
        .sortWithinPartitions("batch")
        .mapInPandas(gather, "doc_id long, n long, hashes binary")
    )
