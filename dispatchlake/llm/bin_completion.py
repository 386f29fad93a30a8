"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters to a packing, and there are at
most `capacity` lengths. So the driver plans on that histogram, whatever the
size of the corpus: a pattern is one filling of a sequence with the number of
times it is used. A step of the search uses a filling for half of what its
lengths allow, so steps grow with the logarithm of the corpus. Pieces then take
their slots by their rank within their length, which tasks work out from
per-task counts.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.llm.common import slices, small_batches
from dispatchlake.llm.tokens import default_path, encoder
from dispatchlake.session import stage

CAPACITY = 2048
END_ID = 0
OPEN_LEVELS = 64  # of a search path, with half a megabyte of sums each

log = logging.getLogger(__name__)

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def sums_below(counts: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths up to `room`, how many of each can be used, and for every prefix of
    these lengths the sums up to `room` that it can make, as the bits of an integer."""
    lengths = np.nonzero(counts[: room + 1])[0].tolist()
    times = [min(int(counts[x]), room // x) for x in lengths]
    mask, sums = (2 << room) - 1, [1]
    for length, most in zip(lengths, times, strict=True):
        bits, have = sums[-1], 0
        while have < most:
            more = min(have + 1, most - have)
            bits |= bits << (length * more)
            have += more
        sums.append(bits & mask)
    return lengths, times, sums


def dominated(chosen: Filling, left: np.ndarray, waste: int) -> bool:
    """Whether a remaining piece could replace some chosen ones and fill at least as much.

    The pieces that it replaces fit where it would have been, so a packing with
    the other filling is no larger.
    """
    single, several, used = 0, 0, dict(chosen)
    for length, times in chosen:
        for _ in range(times):
            several |= (several | single) << length
            single |= 1 << length
    rest = 0
    for length in np.nonzero(left)[0].tolist():
        if left[length] > used.get(length, 0):
            rest |= 1 << length
    if rest & ((2 << waste) - 1) or several & rest:
        return True
    reach = single | several
    return any((reach << more) & rest for more in range(1, waste + 1))


def fillings(
    counts: np.ndarray, capacity: int, most_waste: int
) -> Iterator[tuple[Filling, int, bool]]:
    """Fillings of one bin around the largest remaining length, their waste, if dominated.

    Least waste first, up to `most_waste`; of equal wastes the one with the larger
    pieces first. Sums that the smaller lengths can make guide the enumeration, so
    that each branch ends in a filling; the next one is looked for when asked for.
    """
    largest = int(np.nonzero(counts)[0][-1])
    left = counts.copy()
    left[largest] -= 1
    room = capacity - largest
    lengths, times, sums = sums_below(left, room)

    def walk(upto: int, target: int) -> Iterator[Filling]:
        if not target:
            yield ()
            return
        k = min(upto, bisect_right(lengths, target))
        while k and sums[k] >> target & 1:
            k -= 1
            for n in range(min(times[k], target // lengths[k]), 0, -1):
                rest = target - n * lengths[k]
                if sums[k] >> rest & 1:
                    for tail in walk(k, rest):
                        yield ((lengths[k], n), *tail)

    for waste in range(min(room, most_waste) + 1):
        if sums[-1] >> (room - waste) & 1:
            for chosen in walk(len(lengths), room - waste):
                worse = dominated(chosen, left, waste)
                if chosen and chosen[0][0] == largest:
                    yield ((largest, chosen[0][1] + 1), *chosen[1:]), waste, worse
                else:
                    yield ((largest, 1), *chosen), waste, worse


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the histogram: bins of equal content move together."""
    open_bins: dict[Filling, int] = {}
    rooms: list[list[Filling]] = [[] for _ in range(capacity + 1)]
    for length in np.nonzero(counts)[0][::-1].tolist():
        todo = int(counts[length])
        while todo:
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                each = capacity // length
                full, rest = divmod(todo, each)
                parts = [(((length, each),), full), (((length, rest),), 1 if rest else 0)]
                todo = 0
            else:
                old = rooms[room].pop()
                many = open_bins.pop(old)
                each = room // length
                used = min(many, max(1, todo // each))
                each = min(each, todo)
                if used < many:
                    open_bins[old] = many - used
                    rooms[room].append(old)
                parts = [(((*old, (length, each))), used)]
                todo -= each * used
            for filling, times in parts:
                if times:
                    free = capacity - sum(x * k for x, k in filling)
                    if filling not in open_bins:
                        rooms[free].append(filling)
                    open_bins[filling] = open_bins.get(filling, 0) + times
    return list(open_bins.items())


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing uses fewer bins: what the tokens fill, and what pieces over half a bin need.

    Pieces over half a bin lie in bins of their own, and the room beside one stays
    empty but for the largest sum that other pieces can make there. For each
    `small`, pieces longer than `capacity - small` share with none of at least
    `small`, and the rest of those has to fit beside other pieces or in new bins.
    """
    lengths = np.arange(capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    half, empty = capacity // 2, 0
    sums = sums_below(counts, capacity - half - 1)[2][-1]
    for length in (np.nonzero(counts[half + 1 :])[0] + half + 1).tolist():
        room = capacity - length
        empty += int(counts[length]) * (room + 1 - (sums & ((2 << room) - 1)).bit_length())
    best = -(-(int(tokens[-1]) + empty) // capacity)
    for small in range(1, half + 1):
        alone = int(number[-1] - number[capacity - small])
        big = int(number[capacity - small] - number[half])
        middle = int(tokens[capacity - small] - tokens[small - 1])
        best = max(best, alone + max(big, -(-middle // capacity)))
    return best


Plan = list[tuple[Filling, int]]


def bins_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def complete(counts: np.ndarray, capacity: int, most: int, lower: int, patience: int) -> Plan | None:
    """Branch and bound: the smallest plan found with at most `most` bins, else None.

    Completes a bin at a time around the largest remaining length and uses the
    filling half as often as the counts allow, so that later bins have a choice;
    coming back, ever fewer times, down to once, then takes the next filling. A
    branch ends when its waste is more than `most` bins leave. The search ends at
    `lower`, when all is tried, or when `patience` fillings were tried or found
    dominated since the last better plan.
    """
    counts = counts.copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    found: Plan | None = None
    path: Plan = []
    waste, idle = 0, 0

    def choices(after: tuple[Filling, int] | None = None) -> Iterator[tuple[Filling, int, int]]:
        """What to try at this point of the path, from behind `after` on."""
        nonlocal idle
        spare = most * capacity - total - waste
        for filling, room, worse in fillings(counts, capacity, spare):
            if after and filling != after[0]:
                continue
            if after:
                n, after = after[1] // 2, None
            else:
                n = int(min(counts[x] // k for x, k in filling))
                n = min(n, spare // room) if room else n
                n = 0 if worse else n
                idle += not n
            while n and idle < patience:
                n = (n + 1) // 2
                yield filling, n, room * n
                n //= 2
                idle += 1
            if idle >= patience:
                return

    levels: list[Iterator[tuple[Filling, int, int]] | None] = [choices()]
    last: tuple[Filling, int] | None = None
    while levels and most >= lower and idle < patience:
        level = levels[-1]
        if level is None:
            level = levels[-1] = choices(last)
        filling, n, room = next(level, ((), 0, 0))
        if not n:
            levels.pop()
            if path:
                last = path.pop()
                waste -= last[1] * (capacity - sum(x * k for x, k in last[0]))
                for length, k in last[0]:
                    counts[length] += k * last[1]
            continue
        if waste + room > most * capacity - total:  # `most` fell since
            continue
        waste += room
        path.append((filling, n))
        for length, k in filling:
            counts[length] -= k * n
        if counts.any():
            levels.append(choices())
            if len(levels) > OPEN_LEVELS:  # its sums are made again if the search comes back
                levels[-OPEN_LEVELS - 1] = None
        else:
            found, idle = list(path), 0
            most = bins_of(found) - 1
            levels.append(iter(()))
    return found


def plan_bins(
    histogram: dict[int, int], capacity: int = CAPACITY, patience: int | None = None, rounds: int = 12
) -> Plan:
    """Patterns and how often each is used, for pieces of the given lengths.

    Best-fit decreasing is the first incumbent, and the answer where it meets
    `lower_bound`. Else `complete` looks for fewer bins over all pieces, and then,
    `rounds` times, over the worst bins of the incumbent with a share of the full
    ones beside them, a larger share each time. `patience`, by default 1 000
    fillings and two per distinct length, is how long a search goes on without a better
    plan: the gap to the bound ends the work, or that.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    if not counts.any():
        return []
    lower = lower_bound(counts, capacity)
    plan = best_fit(counts, capacity)
    first = bins_of(plan)
    patience = patience or 1000 + 2 * int((counts > 0).sum())
    if first > lower:
        plan = complete(counts, capacity, first - 1, lower, patience) or plan
    rng = np.random.default_rng(0)
    for k in range(rounds):
        if bins_of(plan) <= lower:
            break
        rooms = [capacity - sum(x * t for x, t in f) for f, _ in plan]
        # bins with room are all opened again, of each full pattern a random part
        share = rng.random(len(plan)) * (k + 1) / rounds
        opened = [n if r else int(n * s) for (_, n), r, s in zip(plan, rooms, share, strict=True)]
        part = np.zeros_like(counts)
        for (filling, _), n in zip(plan, opened, strict=True):
            for length, times in filling:
                part[length] += times * n
        least = lower_bound(part, capacity)
        better = complete(part, capacity, sum(opened) - 1, least, patience)
        if better:
            rest = [(f, n - m) for (f, n), m in zip(plan, opened, strict=True) if n > m]
            plan = rest + better
    log.info("bins: at least %d, best fit %d, plan %d", lower, first, bins_of(plan))
    return plan


class Slots:
    """For each length, ranks in order of the patterns that use it."""

    def __init__(self, plan: list[tuple[Filling, int]], capacity: int):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        base, given = 0, {}
        for filling, times in plan:
            offset = 0
            for length, k in filling:
                first = given.get(length, 0)
                found.setdefault(length, []).append((first, base, k, offset))
                given[length] = first + k * times
                offset += k * length
            base += times
        self.by_length = {n: np.array(v, np.int64).T for n, v in found.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, each, offset = self.by_length[length]
        at = np.searchsorted(first, ranks, side="right") - 1
        nth, slot = np.divmod(ranks - first[at], each[at])
        return base[at] + nth, offset[at] + slot * length


def cut_pieces(
    docs: DataFrame, tokenizer_path: str | None, capacity: int, end_id: int
) -> DataFrame:
    """Tokenise and cut; `task` and `nth` number the pieces of a length inside each task."""
    path = tokenizer_path or default_path()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for frame in frames:
            for part in slices(frame, "text", 8 << 20):
                rows = []
                found = encoder(path).encode(part["text"].tolist())
                for doc_id, ids in zip(part["doc_id"], found, strict=True):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    known = None if pd.isna(doc_id) else int(doc_id)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        n = len(own)
                        crc = zlib.crc32(own.tobytes())
                        rows.append((known, k, start, n, crc, task, seen[n]))
                        seen[n] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long",
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack all `docs` (doc_id, text) into few sequences of at most `capacity` tokens.

    One row per piece. Null and empty texts are one piece of the end id; equal
    rows are pieces of their own; an empty table gives no rows; other columns are
    ignored. The driver gets one number per length.
    """
    small_batches(docs)
    pieces = stage(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        counts.select(
            "task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
        ),
        "piece-offsets",
    )
    histogram = offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = plan_bins({r["length"]: r["n"] for r in histogram}, capacity)
    slots = Slots(plan, capacity)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros((2, len(frame)), np.int64)
            for length, rows in frame.groupby("length").indices.items():
                sequence[rows], offset[rows] = slots.place(
                    int(length), frame["rank"].to_numpy()[rows]
                )
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = pieces.join(offsets.drop("n"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInPandas(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    )
