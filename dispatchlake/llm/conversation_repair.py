"""Repair of conversation structure by the cheapest audit of edits.

Rows are ranged over (conversation, turn) and sorted, so a task sees whole
conversations one after another and repairs them there (`audit_paths`). The first
and the last conversation of a task may go on elsewhere, and one may be as large
as you like: their rows are handed on in chunks of at most `CHUNK_ROWS`. Each chunk
finds its cheapest audits between all states; the conversation then takes the
cheapest way through its chunks, at one small row each; duplicates are found by
digest over all chunks. Only the repaired text's SHA-256, a chain by its
definition, runs through one task per such conversation, as a stream of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispatchlake.llm.audit_paths import (
    DELETE,
    LETTERS,
    chunk_choice,
    chunk_paths,
    edits,
    whole_path,
)
from dispatchlake.llm.common import small_batches
from dispatchlake.session import stage

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
# rows of a conversation that a task repairs at once, or that make a chunk
CHUNK_ROWS = 4_096
OUT_ROWS = 1_000

RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)
PART = "block long, pos long, turn long, role string, text string, present boolean"
CHUNK = ["conv_id", "block", "chunk"]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage, by the crc32 of `conv_id:turn` modulo 20.

    0 drops the row (it stays with `present` false and no role and text), 1
    empties its text, 2 removes `.!?` from it, 3 repeats it, 4 makes its role user.
    Nulls, also in the key, are one blank; a null turn stays null.
    """
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    there = kind != 0
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").when(there, role).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .when(there, text)
        .alias("text"),
        there.alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")


def _fault(text: str, seen: bool) -> str:
    """A row's first fault: blank, duplicate, truncated or none."""
    bare = text.rstrip(SPACES)
    if not bare:
        return "blank"
    return "duplicate" if seen else "" if bare.endswith(ENDS) else "truncated"


def _marks(initials: list[str], faults: list[str]) -> list[tuple[bool, bool, str]]:
    return [
        (f in ("blank", "duplicate"), f == "truncated", i)
        for i, f in zip(initials, faults, strict=True)
    ]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def repair_conversation(rows: list[tuple]) -> tuple:
    """The result of one conversation from its ordered rows (turn, role, text)."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(_fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = whole_path(_marks(initials, faults))
    lines, at = [], 0
    for before, edit, role in edits(audit, initials):
        lines += [f"{r}:" for r in before]
        if edit not in (DELETE, LETTERS.index("I")):
            lines.append(f"{role or rows[at][1]}:{rows[at][2]}")
        at += 1
    return (
        _gaps({t for t, _, _ in rows if t is not None}),
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        _illegal(initials),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(frame: DataFrame, columns: str) -> StructType:
    """`conv_id` in its own type, and these columns."""
    own = StructType([frame.schema["conv_id"]])
    return StructType(own.fields + StructType.fromDDL(columns).fields)


def _repair_or_pass(ordered: DataFrame, chunk_rows: int) -> DataFrame:
    """Results of conversations that lie inside a task; rows of the others (`block` set)."""
    schema = _schema(ordered, f"{RESULT}, {PART}")
    n_result = len(StructType.fromDDL(RESULT).fields)
    n_part = len(StructType.fromDDL(PART).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        block = TaskContext.get().partitionId()
        out: list[tuple] = []
        waiting: list[tuple] = []  # rows of the conversation in hand
        current, number, passing, pos = None, 0, True, 0

        def pass_on() -> None:
            nonlocal pos
            for row in waiting:
                out.append((current, *[None] * n_result, block, pos, *row))
                pos += 1
            waiting.clear()

        def close(last: bool) -> None:
            nonlocal passing
            if passing or last:
                pass_on()
            elif number:
                there = [r[:3] for r in waiting if r[3]]
                out.append((current, *repair_conversation(there), *[None] * n_part))
                waiting.clear()
            passing = False

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not number or conv != current:
                    if number:
                        close(last=False)
                    passing = not number  # the first may have begun in another task
                    current, number = conv, number + 1
                waiting.append(tuple(row))
                if passing or len(waiting) >= chunk_rows:
                    passing = True
                    pass_on()
                if len(out) >= OUT_ROWS:
                    yield _batch(out, arrow)
                    out.clear()
        close(last=True)
        yield _batch(out, arrow)

    return ordered.mapInArrow(run, schema)


def _marked_chunks(parts: DataFrame) -> DataFrame:
    """One row per chunk with its rows' marks in order."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    facts = parts.select(
        *CHUNK,
        "pos",
        "turn",
        "present",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("empty"),
        F.substring(bare, -1, 1).isin(*ENDS).alias("ended"),
        # the length tells role and text apart
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("same"),
    )
    first = (
        facts.where("present")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"))
        .agg(F.min(F.struct("block", "pos")).alias("_first"))
    )
    met = facts.join(
        first, facts.conv_id.eqNullSafe(first._conv) & (facts.same == first._same), "left"
    )
    seen = F.struct("block", "pos") != F.col("_first")
    fault = (
        F.when(F.col("empty"), "blank")
        .when(seen, "duplicate")
        .when(F.col("ended"), "")
        .otherwise("truncated")
    )
    mark = F.struct("pos", "turn", "present", "initial", fault.alias("fault"))
    return met.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(mark)).alias("marks"))


SUMMARY = (
    "block long, chunk long, counts array<long>, turns array<long>, ends array<string>,"
    " costs array<long>, places array<int>, audits array<string>, initials array<string>,"
    " positions array<long>"
)


def _summaries(chunks: DataFrame) -> DataFrame:
    """Per chunk: fault counts, turns, initials, and its cheapest audits between states.

    counts: blank, duplicate, truncated, illegal pairs inside; turns: least, largest,
    different ones; ends: first and last initial.
    """
    schema = _schema(chunks, SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for conv, block, chunk, marks in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                there = [m for m in marks if m["present"]]
                faults = [m["fault"] for m in there]
                initials = [m["initial"] for m in there]
                turns = {m["turn"] for m in there if m["turn"] is not None}
                paths = chunk_paths(_marks(initials, faults))
                flat = [p for of_start in paths for p in of_start]
                places = [
                    sorted(p[1] for p in of_start if p).index(one[1]) if one else None
                    for of_start in paths
                    for one in of_start
                ]
                counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
                row = (
                    conv,
                    block,
                    chunk,
                    [*counts, _illegal(initials)],
                    [min(turns), max(turns), len(turns)] if turns else None,
                    [initials[0], initials[-1]] if initials else None,
                    [p and p[0] for p in flat],
                    places,
                    [p and p[1] for p in flat],
                    initials,
                    [m["pos"] for m in there],
                )
                yield _batch([row], arrow)

    return chunks.mapInArrow(run, schema)


CHOSEN = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " closing int, path array<struct<block: long, chunk: long, entry: int, exit: int>>"
)


def _choices(summaries: DataFrame) -> DataFrame:
    """Per conversation its numbers and the way through its chunks."""
    # numbers of a chunk only: one entry for up to `CHUNK_ROWS` rows
    entry = F.struct("block", "chunk", "counts", "turns", "ends", "costs", "places")
    chunks = summaries.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("chunks"))
    schema = _schema(summaries, CHOSEN)

    def one(chunks: list[dict]) -> tuple:
        counts = [sum(c["counts"][k] for c in chunks) for k in range(4)]
        ends = [c["ends"] for c in chunks if c["ends"]]
        counts[3] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
        turns = [c["turns"] for c in chunks if c["turns"]]
        different = sum(t[2] for t in turns)
        different -= sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        gaps = turns[-1][1] - turns[0][0] + 1 - different if turns else 0
        cost, path, closing = chunk_choice([(c["costs"], c["places"]) for c in chunks])
        steps = [
            {"block": c["block"], "chunk": c["chunk"], "entry": a, "exit": b}
            for c, (a, b) in zip(chunks, path, strict=True)
        ]
        return gaps, *counts, cost, closing, steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for conv, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([(conv, *one(chunks))], arrow)

    return chunks.mapInArrow(run, schema)


STEPS = "block long, pos long, before array<string>, kept boolean, new_role string"


def _row_edits(taken: DataFrame) -> DataFrame:
    """Edits of rows that stay or have inserts before them, from the chunks' audits."""
    schema = _schema(taken, STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for conv, block, audit, entry, initials, positions in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                steps = edits(audit, initials, entry)
                rows = [
                    (conv, block, pos, before, edit != DELETE, role)
                    for pos, (before, edit, role) in zip(positions, steps, strict=True)
                    if before or edit != DELETE
                ]
                yield _batch(rows, arrow)

    columns = ["conv_id", "block", "audit", "entry", "initials", "positions"]
    return taken.select(*columns).mapInArrow(run, schema)


def _digests(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's lines, streamed in order."""
    schema = _schema(lines, "repaired_sha256 string")
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        current, digest, out = None, None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "before", "line")]
            for conv, before, line in zip(*columns, strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest, gap = conv, hashlib.sha256(), b""
                for text in [*(f"{r}:" for r in before), *([line] if line is not None else [])]:
                    digest.update(gap + text.encode())
                    gap = b"\n"
        if digest is not None:
            out.append((current, digest.hexdigest()))
        yield _batch(out, arrow)

    return ordered.select("conv_id", "before", "line").mapInArrow(run, schema)


def _across_tasks(parts: DataFrame, chunk_rows: int) -> DataFrame:
    """Results of conversations whose rows were passed on, by chunks."""
    parts = parts.withColumn("chunk", F.floor(F.col("pos") / chunk_rows))
    summaries = stage(_summaries(_marked_chunks(parts)), "conversation-chunks")
    chosen = stage(_choices(summaries), "conversation-paths")
    steps = chosen.select(F.col("conv_id").alias("_conv"), F.explode("path").alias("_step"))
    same = (
        summaries.conv_id.eqNullSafe(F.col("_conv"))
        & (summaries.block == F.col("_step.block"))
        & (summaries.chunk == F.col("_step.chunk"))
    )
    at = F.col("_step.entry") * 4 + F.col("_step.exit")
    taken = summaries.join(steps, same).select(
        *CHUNK,
        F.element_at("audits", at + 1).alias("audit"),
        F.col("_step.entry").alias("entry"),
        "initials",
        "positions",
    )
    piece = F.array_sort(F.collect_list(F.struct("block", "chunk", "audit")))
    audits = taken.groupBy("conv_id").agg(
        F.array_join(F.transform(piece, lambda p: p.audit), "").alias("audit")
    )
    row_edits = _row_edits(taken)
    of_row = [parts.conv_id.eqNullSafe(row_edits.conv_id)]
    of_row += [parts[c] == row_edits[c] for c in ("block", "pos")]
    line = F.concat_ws(":", F.coalesce(row_edits.new_role, parts.role), parts.text)
    lines = parts.join(row_edits, of_row).select(
        parts.conv_id, parts.block, parts.pos, "before", F.when(F.col("kept"), line).alias("line")
    )
    # a conversation ends with an assistant; what is missing follows its last row
    closing = F.slice(F.array(F.lit("user"), F.lit("assistant")), 3 - F.col("closing"), 2)
    last = F.element_at("path", -1)
    ends = chosen.where("closing > 0").select(
        "conv_id",
        last.block.alias("block"),
        F.lit((1 << 63) - 1).alias("pos"),
        closing.alias("before"),
        F.lit(None).cast("string").alias("line"),
    )
    digests = _digests(lines.unionByName(ends))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = chosen.join(audits, chosen.conv_id.eqNullSafe(audits.conv_id), "left").select(
        chosen.conv_id,
        *numbers,
        F.concat("audit", F.repeat(F.lit("I"), F.col("closing"))).alias("audit"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(digests, whole.conv_id.eqNullSafe(digests.conv_id), "left").select(
        whole.conv_id,
        *numbers,
        "audit",
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cheapest repair of each conversation in `rows` (conv_id, turn, role, text).

    Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (SHA-256 of the repaired `role:text` lines). Rows stand by turn,
    nulls first; rows of one turn by role, by the first 64 characters of both, then
    by hash. Rows equal in all are each a row: the later ones are duplicates. A null
    conv_id is one conversation of its own; null roles and texts are one blank. An
    optional column `present` marks rows that only name their conversation (false);
    without present rows it has zeros, an empty audit and the digest of the empty
    text. Texts are never cut. An empty table gives no rows; other columns are
    ignored.
    """
    small_batches(rows)
    there = F.col("present") if "present" in rows.columns else F.lit(True)
    blank = F.lit(" ")
    clean = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(there, F.coalesce("role", blank)).alias("role"),
        F.when(there, F.coalesce("text", blank)).alias("text"),
        there.alias("present"),
    )
    order = {
        "_role": F.substring("role", 1, 64),
        "_text": F.substring("text", 1, 64),
        "_hash": F.xxhash64("role", "text"),
        "_row": F.monotonically_increasing_id(),
    }
    by = ["conv_id", "turn", *order]
    ordered = clean.withColumns(order).repartitionByRange(*by).sortWithinPartitions(*by)
    met = stage(_repair_or_pass(ordered.drop(*order), chunk_rows), "conversations")
    result = ["conv_id", *(f.name for f in StructType.fromDDL(RESULT).fields)]
    inside = met.where("block is null").select(*result)
    part = ["conv_id", *(f.name for f in StructType.fromDDL(PART).fields)]
    across = _across_tasks(met.where("block is not null").select(*part), chunk_rows)
    return inside.unionByName(across.select(*result))
