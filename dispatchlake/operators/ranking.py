"""Exact ordered rank inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.session import stage

# monotonically_increasing_id: partition number above these bits, row number below
ROW_BITS = 33


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on all `names`."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Store the rows in ranges of (keys, order), with `_block` and `_pos`.

    One range shuffle and a sort inside partitions; a hot key is cut into as
    many blocks as its size asks for. `_pos` is the row's place in its block.
    The rows are stored because block bounds come from sampling and may differ
    when a plan runs again.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    stored = stage(ranged.withColumn("_place", F.monotonically_increasing_id()), "blocks")
    return stored.withColumns(
        {
            "_block": F.shiftright("_place", ROW_BITS).cast("int"),
            "_pos": F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
        }
    ).drop("_place")


def block_offsets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and block: the key's first place, its rows in earlier blocks and in all.

    Stored, so that its true size decides between a broadcast and a shuffled
    join. It has at most one row per block plus one per key.
    """
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = blocks.groupBy(*keys, "_block").agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_first")
    )
    offsets = counts.select(
        *keys,
        "_block",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    return stage(offsets, "offsets")


def rank_in_blocks(
    blocks: DataFrame, keys: list[str], out: str, total: str | None = None
) -> DataFrame:
    """Add the 0-based rank `out` inside each key to rows of `ordered_blocks`.

    With `total`, also the number of rows of the key.
    """
    offsets = block_offsets(blocks, keys)
    rank = F.col("_before") + F.col("_pos") - F.col("_first")
    return blocks.join(offsets, same(blocks, offsets, [*keys, "_block"])).select(
        *[blocks[c] for c in blocks.columns if c != "_pos"],
        rank.alias(out),
        *([F.col("_total").alias(total)] if total else []),
    )


def ranked(
    df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None
) -> DataFrame:
    """0-based rank of every row inside `keys`, ordered by `order` columns.

    `order` must be unique inside a key (de-duplicate at-least-once feeds
    first). No task holds a whole group, so the group size does not matter.
    """
    return rank_in_blocks(ordered_blocks(df, keys, order), keys, out, total).drop("_block")
