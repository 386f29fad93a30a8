"""Mixing sources to target weights by pivotal dependent rounding.

A document's share of its source's target is a number of copies, mostly not
whole. Pivotal rounding takes two such documents and moves words from one to
the other, at random and without changing either's expectation, until one of
them has a whole number of copies. The words of the pair stay the same, so a
source misses its target by less than one document, however many it has.

Blocks of a source round in parallel; each leaves at most one document with a
fraction, and those meet again in coarser blocks, up to one per source.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import WORD
from dispatchlake.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2.0
BLOCK_ROWS = 4_000
FAN_IN = 64
SEED = 20_240_607
EDGE = 1e-9  # a fraction this near a whole number is one


def targets(sizes: list[tuple[str | None, int]], share: float, ceiling: float) -> dict:
    """Target words per source: weight times a common level, at most `ceiling` times its size.

    The weights 3, 1, 2 repeat over the sources by code point, null last. What
    a full source cannot take is shared among the others by weight again, until
    none is above its limit. Sums over sources only, so it runs on the driver.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, (s, _) in enumerate(order)}
    limit = {s: ceiling * n for s, n in order}
    left = min(share * sum(n for _, n in order), sum(limit.values()))
    out: dict = {}
    free = [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > limit[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: limit[s] for s in full}
        left -= sum(limit[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def draw(seed: int, *marks: object) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    data = "\x1f".join(map(str, (seed, *marks))).encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "big") / 2**56


def whole(copies: float) -> bool:
    return abs(copies - round(copies)) <= EDGE


def settle(a: float, size_a: int, b: float, size_b: int, u: float) -> tuple[float, float]:
    """Move words between two fractional documents until one has whole copies.

    a * size_a + b * size_b does not change, nor does either's expectation.
    """
    up = min((math.ceil(a) - a) * size_a, (b - math.floor(b)) * size_b)
    down = min((a - math.floor(a)) * size_a, (math.ceil(b) - b) * size_b)
    words = up if u < down / (up + down) else -down
    a, b = a + words / size_a, b - words / size_b
    return (float(round(a)) if whole(a) else a), (float(round(b)) if whole(b) else b)


def rounded(docs: DataFrame, block_rows: int, fan_in: int, seed: int) -> DataFrame:
    """Whole copies for every row of (row_key, doc_id, source, size, copies)."""
    n_blocks = max(1, -(-docs.count() // block_rows))
    schema = "doc_id long, source string, size long, copies double, spread long, open boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams rows sorted by block; one document of the current block is held."""
        at, held = None, None
        for frame in frames:
            out = []
            for doc_id, source, size, copies, spread, block in frame.itertuples(index=False):
                source = None if pd.isna(source) else source
                key = (source, block)
                if key != at:
                    if held is not None:
                        out.append((*held, True))
                    at, held = key, None
                known = None if pd.isna(doc_id) else int(doc_id)
                row = (known, source, int(size), float(copies), int(spread))
                if size == 0 or whole(copies):
                    out.append((*row[:3], float(round(copies)), row[4], False))
                elif held is None:
                    held = row
                else:
                    u = draw(seed, held[0], held[4], row[0], row[4])
                    x, y = settle(held[3], held[2], row[3], row[2], u)
                    first, second = (*held[:3], x, held[4]), (*row[:3], y, row[4])
                    held = None
                    for one in (first, second):
                        if whole(one[3]):
                            out.append((*one, False))
                        else:
                            held = one
            names = ["doc_id", "source", "size", "copies", "spread", "open"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        if held is not None:
            out = pd.DataFrame([(*held, True)], columns=names)
            yield out.astype({"doc_id": "Int64"})

    left, done = docs, []
    while True:
        block = F.pmod("spread", F.lit(n_blocks)).alias("block")
        dealt = (
            left.select("doc_id", "source", "size", "copies", "spread", block)
            .repartition("source", "block")
            .sortWithinPartitions("source", "block", "spread", "doc_id", "size")
        )
        level = stage(dealt.mapInPandas(run, schema), "rounding")
        done.append(level.where("not open"))
        left = level.where("open")
        if n_blocks == 1:
            break
        n_blocks = max(1, n_blocks // fan_in)
    chance = F.udf(lambda d, s: draw(seed, d, s), "double")
    last = left.withColumn("u", chance("doc_id", "spread"))  # one row per source at most
    base = F.floor("copies").cast("double")
    last = last.withColumn(
        "copies", base + F.when(F.col("u") < F.col("copies") - base, 1.0).otherwise(0.0)
    ).drop("u")
    out = last
    for level in done:
        out = out.unionByName(level)
    return out.drop("open")


def mix(
    docs: DataFrame,
    share: float = SHARE,
    ceiling: float = CEILING,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of every document of `docs` (doc_id, source, text) in the mix.

    Columns: doc_id, source, size (words of the whole text), source_size, target
    (of its source), copies (whole, 0 to `ceiling` rounded up), taken (size times
    copies), spread (hash of text, doc_id and the columns `also`). Null and empty texts have size 0 and no
    copies; a null source is a source of its own; equal rows are rounded apart
    and may swap their copies. The result depends on the rows and `seed`, not on
    their partitions. An empty table gives no rows; other columns are ignored.
    The driver gets one row per source.
    """
    sized = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text", "doc_id", *also).alias("spread"),
        ),
        "sizes",
    )
    sums = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    aims = targets(sums, share, ceiling)
    rows = [(s, n, float(aims[s])) for s, n in sums]
    aim = docs.sparkSession.createDataFrame(
        rows, "aim_source string, source_size long, target double"
    )
    # as many rows as sources, which the driver has just held
    shared = sized.join(F.broadcast(aim), sized["source"].eqNullSafe(aim["aim_source"])).drop(
        "aim_source"
    )
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole_rows = rounded(shared.withColumn("copies", copies), block_rows, fan_in, seed)
    out = whole_rows.join(
        F.broadcast(aim), whole_rows["source"].eqNullSafe(aim["aim_source"])
    )
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("copies").cast("long").alias("copies"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        "spread",
    )
