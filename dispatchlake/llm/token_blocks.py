"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of many documents as one stream, cut into blocks of 128.
A block stores its minimum; differences to it are packed at the width that a
percentile of them needs, and wider ones go whole into an exception list.

File, all little-endian: MAGIC; segments (up to 8192 blocks each); a directory
(per document: null flag u1, doc_id i8, ids u4; per segment: place u8); length
of the directory u8, documents u8, segments u8; MAGIC. A segment: ids u8,
blocks u4, exceptions u4; per block: start of its packed words u4, minimum u4,
first exception u4, width u1; packed words u4; per exception: value (u2 if the
segment's largest fits, else u4), place u1. The ids' top bit marks u4 values. Block starts give random access: `read_ids` decodes only the blocks asked.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.llm.common import file_system, slices, small_batches
from dispatchlake.llm.tokens import default_path, encoder
from dispatchlake.session import scratch_path, stage

MAGIC = b"PFORTOK1"
BLOCK = 128
SEGMENT_IDS = BLOCK * 8192
END_ID = 1


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs (0 for 0)."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Bytes of one segment of at most SEGMENT_IDS ids."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(n_blocks, BLOCK)
    least = grid.min(axis=1)
    delta = grid - least[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    widths = _bits(np.partition(delta, rank, axis=1)[:, rank])
    outlier = _bits(delta) > widths[:, None]
    row, place = np.nonzero(outlier)
    values = delta[row, place]
    delta[row, place] = 0
    first = np.searchsorted(row, np.arange(n_blocks)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(4 * widths.astype(np.uint32))]).astype(np.uint32)
    words = np.zeros(int(starts[-1]), np.uint32)
    for width in np.unique(widths[widths > 0]):
        width = int(width)
        blocks = np.nonzero(widths == width)[0]
        lanes = np.ascontiguousarray(delta[blocks].T).astype(np.uint64)
        packed = np.zeros((4 * width + 1, len(blocks)), np.uint64)
        for k in range(BLOCK):
            word, shift = divmod(k * width, 32)
            packed[word] |= lanes[k] << np.uint64(shift)
            if shift + width > 32:
                packed[word + 1] |= lanes[k] >> np.uint64(32 - shift)
        at = starts[blocks][:, None] + np.arange(4 * width)
        words[at] = (packed[: 4 * width] & np.uint64(0xFFFFFFFF)).T.astype(np.uint32)
    wide = int(len(values) > 0 and int(values.max()) > 0xFFFF)
    parts = [
        struct.pack("<QII", len(ids) | (wide << 63), n_blocks, len(values)),
        starts[:-1].tobytes(),
        least.astype("<u4").tobytes(),
        first.tobytes(),
        widths.tobytes(),
        words.astype("<u4").tobytes(),
        values.astype("<u4" if wide else "<u2").tobytes(),
        place.astype(np.uint8).tobytes(),
    ]
    return b"".join(parts)


def decode_segment(data: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids `begin` to `end` of a segment; only their blocks are unpacked."""
    n_ids, n_blocks, n_exceptions = struct.unpack_from("<QII", data)
    size = 4 if n_ids >> 63 else 2
    n_ids &= (1 << 63) - 1
    end = n_ids if end is None else min(end, n_ids)
    if begin >= end:
        return np.zeros(0, np.uint32)
    at = 16
    starts = np.frombuffer(data, "<u4", n_blocks, at)
    least = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_blocks)
    first = np.frombuffer(data, "<u4", n_blocks, at + 8 * n_blocks)
    widths = np.frombuffer(data, np.uint8, n_blocks, at + 12 * n_blocks)
    at += 13 * n_blocks
    n_words = int(4 * widths.astype(np.int64).sum())
    words = np.frombuffer(data, "<u4", n_words, at)
    values = np.frombuffer(data, f"<u{size}", n_exceptions, at + 4 * n_words)
    places = np.frombuffer(data, np.uint8, n_exceptions, at + 4 * n_words + size * n_exceptions)
    low, high = begin // BLOCK, -(-end // BLOCK)
    grid = np.zeros((high - low, BLOCK), np.uint32)
    own = widths[low:high]
    for width in np.unique(own[own > 0]):
        width = int(width)
        blocks = np.nonzero(own == width)[0]
        packed = words[starts[low:high][blocks][:, None] + np.arange(4 * width)]
        packed = np.ascontiguousarray(packed.T).astype(np.uint64)
        lanes = np.empty((BLOCK, len(blocks)), np.uint32)
        mask = np.uint64((1 << width) - 1)
        for k in range(BLOCK):
            word, shift = divmod(k * width, 32)
            lane = packed[word] >> np.uint64(shift)
            if shift + width > 32:
                lane = lane | (packed[word + 1] << np.uint64(32 - shift))
            lanes[k] = (lane & mask).astype(np.uint32)
        grid[blocks] = lanes.T
    from_, to = int(first[low]), int(first[high]) if high < n_blocks else n_exceptions
    row = np.searchsorted(first, np.arange(from_, to), side="right") - 1 - low
    grid[row, places[from_:to]] = values[from_:to]
    grid += least[low:high, None]
    return grid.reshape(-1)[begin - low * BLOCK : end - low * BLOCK]


class TokenWriter:
    """Writes one file; holds one segment of ids and the document directory."""

    def __init__(self, sink, percentile: float = 0.9):
        self.sink, self.percentile = sink, percentile
        self.sink.write(MAGIC)
        self.place, self.waiting, self.n_waiting, self.n_ids = len(MAGIC), [], 0, 0
        self.docs: list[tuple[int | None, int]] = []
        self.segments: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= SEGMENT_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= SEGMENT_IDS or (last and at < len(ids)):
            data = encode_segment(ids[at : at + SEGMENT_IDS], self.percentile)
            self.segments.append(self.place)
            self.sink.write(data)
            self.place += len(data)
            at += SEGMENT_IDS
        self.waiting = [ids[at:]] if at < len(ids) else []
        self.n_waiting = max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(True)
        missing = np.array([d is None for d, _ in self.docs], np.uint8)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        counts = np.array([n for _, n in self.docs], "<u4")
        places = np.array(self.segments, "<u8")
        listing = missing.tobytes() + ids.tobytes() + counts.tobytes() + places.tobytes()
        self.sink.write(listing)
        self.sink.write(struct.pack("<QQQ", len(listing), len(ids), len(places)) + MAGIC)
        self.sink.close()


class TokenFile:
    """Reads one file: its directory at once, its segments as they are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(32, size - 32)
        if tail[24:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        length, n_docs, n_segments = struct.unpack_from("<QQQ", tail)
        self.end = size - 32 - length
        listing = source.read_at(length, self.end)
        self.missing = np.frombuffer(listing, np.uint8, n_docs).astype(bool)
        self.doc_ids = np.frombuffer(listing, "<i8", n_docs, n_docs)
        self.counts = np.frombuffer(listing, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        self.places = np.frombuffer(listing, "<u8", n_segments, 13 * n_docs).astype(np.int64)

    def segment(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        stop = self.places[k + 1] if k + 1 < len(self.places) else self.end
        data = self.source.read_at(int(stop - self.places[k]), int(self.places[k]))
        return decode_segment(data, begin, end)

    def read_ids(self, start: int, n: int) -> np.ndarray:
        """Any `n` ids from `start` on, by the block index."""
        parts = [np.zeros(0, np.uint32)]
        while n > 0 and start // SEGMENT_IDS < len(self.places):
            k, begin = divmod(start, SEGMENT_IDS)
            part = self.segment(k, begin, min(begin + n, SEGMENT_IDS))
            parts.append(part)
            if not len(part):
                break
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; one segment and one document in memory."""
        rest, k = np.zeros(0, np.uint32), 0
        for n in self.counts:
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.segment(k))
                have, k = have + len(parts[-1]), k + 1
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            yield ids[:n]
            rest = ids[n:]


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    percentile: float = 0.9,
    file_ids: int = 1 << 28,
) -> DataFrame:
    """Tokenise whole texts and write them in ascending doc_id order; the list of files.

    One range shuffle orders the documents; each task writes files of at most
    about `file_ids` ids under names of its own, and only files that committed
    tasks report are listed, so lost or repeated tasks leave no wrong file behind
    in the list. Null texts are empty, null ids come first, equal ids follow
    their texts. Columns: shard, part (their order is the order of the ids),
    path, n_docs, n_ids.
    """
    small_batches(docs)
    path = tokenizer_path or default_path()
    folder = scratch_path(docs.sparkSession, "token-files")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        shard, part, writer, name = TaskContext.get().partitionId(), 0, None, ""
        end = np.array([end_id], np.uint32)

        def done() -> pd.DataFrame:
            writer.close()
            row = (shard, part, name, len(writer.docs), writer.n_ids)
            return pd.DataFrame([row], columns=["shard", "part", "path", "n_docs", "n_ids"])

        for frame in frames:
            for piece in slices(frame, "text", 8 << 20):
                found = encoder(path).encode(piece["text"].tolist())
                for doc_id, ids in zip(piece["doc_id"], found, strict=True):
                    if writer is not None and writer.n_ids >= file_ids:
                        yield done()
                        writer, part = None, part + 1
                    if writer is None:
                        name = f"{base}/{shard:06d}-{part:04d}-{uuid.uuid4().hex}.pfor"
                        writer = TokenWriter(system.open_output_stream(name), percentile)
                    known = None if pd.isna(doc_id) else int(doc_id)
                    writer.add(known, np.concatenate([ids, end]))
        if writer is not None:
            yield done()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    schema = "shard int, part int, path string, n_docs long, n_ids long"
    return stage(ordered.mapInPandas(write, schema), "token-list"), folder


def read_token_files(files: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Per document of the listed files: its place among all ids, length and checksum."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        for frame in frames:
            for row in frame.itertuples():
                source = TokenFile(system.open_input_file(row.path))
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in source.documents()]
                ends = np.cumsum(source.counts)
                out = pd.DataFrame(
                    {
                        "doc_id": pd.array(source.doc_ids, dtype="Int64"),
                        "start": row.before + ends - source.counts,
                        "n_tokens": source.counts,
                        "ids_crc32": np.array(crcs, np.int64),
                    }
                )
                out.loc[source.missing, "doc_id"] = pd.NA
                yield out

    # one row per file: the running sum over the whole list is small
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = tasks or max(1, min(files.count(), 20_000))
    return placed.repartition(n, "path").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_blocks(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write `docs` (doc_id, text) as token files, read them back, report per document.

    An empty table gives no rows; other columns of `docs` are ignored.
    """
    files, folder = write_token_files(docs, tokenizer_path)
    return read_token_files(files, folder)
