"""WARC archives with revisit records in place of repeated payloads.

First every page goes into an archive as a response record. Headers are then
read back from the archives and shuffled by payload digest; of equal payloads
one record is the original, and the others are joined to it as revisits. Last,
each archive is rewritten with fresh headers, revisits without their payload.

Archives are gzip members, one per record, in a folder that all executors
share. A task writes files under names of its own, and only files listed by
committed tasks are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import file_system, small_batches
from dispatchlake.session import scratch_path, stage

MIN_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
LEVEL = 2  # of deflate
# fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:uuid:"


def record_id(archive: str, place: int, page_id: int | None) -> str:
    return f"<{RECORD}{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{place}/{page_id}')}>"


def make_record(fields: dict[str, object], payload: bytes) -> bytes:
    """One record: version line, header fields, blank line, payload, two line ends."""
    lines = [VERSION]
    for name, value in fields.items():
        if value is not None:
            clean = re.sub(r"[\r\n]+", " ", str(value))
            lines.append(f"{name}: {clean}".encode())
    lines.append(f"Content-Length: {len(payload)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record length does not fit its payload")
    return fields, rest[:length]


class ArchiveWriter:
    """Appends gzip members; knows the place and length of each."""

    def __init__(self, system, path: str):
        self.path, self.place = path, 0
        self.sink = system.open_output_stream(path, compression=None)

    def add(self, record: bytes) -> tuple[int, int]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.sink.write(member)
        at, self.place = self.place, self.place + len(member)
        return at, len(member)


def read_records(source) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Every record of an archive in turn: place, length, fields, payload."""
    place, buffered = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not buffered:
                buffered = source.read(1 << 20)
                if not buffered:
                    if parts or used:
                        raise ValueError("archive is cut off")
                    return
            parts.append(unpacker.decompress(buffered))
            used += len(buffered) - len(unpacker.unused_data)
            buffered = unpacker.unused_data
        yield place, used, *parse_record(b"".join(parts))
        place += used


def new_name(folder: str, kind: str, task: int, part: int) -> str:
    return f"{folder}/{kind}-{task:06d}-{part:04d}-{uuid.uuid4().hex}.warc.gz"


def number(value: object) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def write_responses(pages: DataFrame, folder: str, date: str, archive_bytes: int) -> DataFrame:
    """A response record per row of `pages`; the table of archives written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task, writer, part = TaskContext.get().partitionId(), None, 0
        rows = 0
        for frame in frames:
            for page_id, url, html in frame.itertuples(index=False):
                if writer is not None and writer.place >= archive_bytes:
                    writer.sink.close()
                    yield pd.DataFrame({"archive": [writer.path], "records": [rows]})
                    writer, part, rows = None, part + 1, 0
                if writer is None:
                    writer = ArchiveWriter(system, new_name(base, "first", task, part))
                payload = html.encode() if isinstance(html, str) else b""
                known = number(page_id)
                fields = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": record_id(f"{task}-{part}", writer.place, known),
                    "WARC-Target-URI": url if isinstance(url, str) else None,
                    "WARC-Date": date,
                    "WARC-Payload-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}",
                    "X-Page-Id": known,
                    "Content-Type": "text/html; charset=utf-8",
                }
                writer.add(make_record(fields, payload))
                rows += 1
        if writer is not None:
            writer.sink.close()
            yield pd.DataFrame({"archive": [writer.path], "records": [rows]})

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stage(picked.mapInPandas(run, "archive string, records long"), "warc-list")


def tasks_for(archives: DataFrame) -> int:
    """About one task per archive: rows are few, but each stands for a whole file."""
    return max(1, min(archives.count(), 20_000))


def spread_archives(archives: DataFrame) -> DataFrame:
    return archives.repartition(tasks_for(archives), "archive")


def read_headers(archives: DataFrame, folder: str) -> DataFrame:
    """Header fields and places of every record in the listed archives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        for frame in frames:
            for archive in frame["archive"]:
                rows = []
                with system.open_input_stream(archive, compression=None) as source:
                    for place, used, fields, payload in read_records(source):
                        rows.append(
                            (
                                archive,
                                place,
                                used,
                                number(fields.get("X-Page-Id")),
                                int(fields.get("X-Payload-Bytes", len(payload))),
                                fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                fields["WARC-Type"],
                                fields["WARC-Record-ID"],
                                fields.get("WARC-Target-URI"),
                                number(fields.get("X-Refers-To-Page-Id")),
                            )
                        )
                names = [c.split(" ")[0] for c in HEADER.split(", ")]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return spread_archives(archives).mapInPandas(run, HEADER)


HEADER = (
    "archive string, place long, length long, page_id long, payload_bytes long,"
    " payload_digest string, record_type string, record_id string, url string, refers_to long"
)


def resolve(headers: DataFrame, min_bytes: int) -> DataFrame:
    """`headers` with the original record of each revisit, null for responses.

    Only digests that occur twice or more are joined back; they are stored first,
    so that a digest with many records is split over tasks by the adaptive join.
    """
    rank = F.struct("page_id", "archive", "place")
    originals = stage(
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), F.max(F.struct(rank.alias("rank"), "record_id", "url")).alias("o"))
        .where("n > 1")
        .select(
            "payload_digest",
            "payload_bytes",
            F.col("o.rank").alias("o_rank"),
            F.col("o.record_id").alias("o_record_id"),
            F.col("o.url").alias("o_url"),
        ),
        "originals",
    )
    joined = headers.drop("refers_to").join(originals, ["payload_digest", "payload_bytes"], "left")
    is_revisit = F.col("o_rank").isNotNull() & (F.col("o_rank") != rank)
    return joined.select(
        "archive",
        "place",
        "length",
        "page_id",
        "url",
        F.when(is_revisit, F.col("o_rank.page_id")).alias("o_page_id"),
        F.when(is_revisit, F.col("o_record_id")).alias("o_record_id"),
        F.when(is_revisit, F.col("o_url")).alias("o_url"),
    )


def rewrite(resolved: DataFrame, folder: str, date: str, tasks: int) -> DataFrame:
    """Fresh archives, one per old one; records keep their order. The list of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        task, at, source, writer, part, rows = TaskContext.get().partitionId(), None, None, None, 0, 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.archive != at:
                    if writer is not None:
                        writer.sink.close()
                        yield pd.DataFrame({"archive": [writer.path], "records": [rows]})
                    at, part, rows = r.archive, part + 1, 0
                    source = system.open_input_file(at)
                    writer = ArchiveWriter(system, new_name(base, "fresh", task, part))
                data = source.read_at(int(r.length), int(r.place))
                old, payload = parse_record(zlib.decompress(data, 31))
                known, original = number(r.page_id), number(r.o_page_id)
                fields = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": record_id(f"fresh/{task}-{part}", writer.place, known),
                    "WARC-Target-URI": old.get("WARC-Target-URI"),
                    "WARC-Date": date,
                    "WARC-Payload-Digest": old["WARC-Payload-Digest"],
                    "X-Page-Id": known,
                }
                if isinstance(r.o_record_id, str):
                    fields |= {
                        "WARC-Type": "revisit",
                        "WARC-Profile": PROFILE,
                        "WARC-Refers-To": r.o_record_id,
                        "WARC-Refers-To-Target-URI": r.o_url if isinstance(r.o_url, str) else None,
                        "WARC-Refers-To-Date": date,
                        "X-Refers-To-Page-Id": original,
                        "X-Payload-Bytes": len(payload),
                    }
                    payload = b""
                else:
                    # kept, so that revisits can name it
                    fields["WARC-Record-ID"] = old["WARC-Record-ID"]
                    fields["Content-Type"] = old["Content-Type"]
                writer.add(make_record(fields, payload))
                rows += 1
        if writer is not None:
            writer.sink.close()
            yield pd.DataFrame({"archive": [writer.path], "records": [rows]})

    # a fixed number: the small rows must not be merged into one task
    dealt = resolved.repartition(tasks, "archive").sortWithinPartitions("archive", "place")
    return stage(dealt.mapInPandas(run, "archive string, records long"), "warc-fresh-list")


def deduplicate(
    pages: DataFrame,
    min_bytes: int = MIN_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> tuple[DataFrame, str]:
    """Write, resolve and rewrite; the list of fresh archives and their folder."""
    small_batches(pages)
    folder = scratch_path(pages.sparkSession, "warc")
    first = write_responses(pages, folder, date, archive_bytes)
    headers = stage(read_headers(first, folder), "warc-headers")
    return rewrite(resolve(headers, min_bytes), folder, date, tasks_for(first)), folder


def resolve_revisits(
    pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """What the fresh archives of `pages` (page_id, url, html) say of every record.

    Of records with equal payloads of at least `min_bytes` bytes, the one with the
    largest page_id is the response (of equal or null ones, the one written last),
    the others are revisits of it; smaller payloads are all responses. Columns:
    page_id, payload_bytes and payload_digest (of the full payload), record_type,
    refers_to (page_id), url. Null html is an empty payload; a null url or page_id
    is left out of the header; an empty table gives no rows; other columns are
    ignored.
    """
    fresh, folder = deduplicate(pages, min_bytes, archive_bytes=archive_bytes)
    return read_headers(fresh, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
