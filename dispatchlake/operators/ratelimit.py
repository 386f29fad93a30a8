"""Sliding-window rate limit: at most N sends per channel in any second, FIFO.

The k-th message of a channel leaves at
    release(k) = max(arrive(k), release(k - N) + 1 s),
which unrolls to floor(k/N) s plus a running maximum of
    v(i) = arrive(i) - floor(i/N) s    over i <= k with i = k (mod N).
So the recursion becomes a rank and a running maximum. Both are taken inside
range-partitioned blocks and carried across blocks, hence one channel can hold
most of the rows and still be processed by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions.times import SECOND
from dispatchlake.operators.ranking import ordered_blocks, rank_in_blocks, same
from dispatchlake.session import stage


def rate_limit(
    df: DataFrame,
    cap: Column | int,
    at: str = "requested_at",
    key: str = "channel",
    order: list[str] | None = None,
    window_us: int = SECOND,
) -> DataFrame:
    """Add `release_at`; nothing is dropped, excess messages are delayed.

    `cap` is the number of sends per window: a number, or a column over `key`.
    `order` must be unique per channel (default: arrival, id). Without a cap
    (null) a message leaves at arrival; a cap under 1 is an error.
    """
    order = order or [at, "tx_id"]
    size = F.lit(cap) if isinstance(cap, int) else cap
    size = F.when(size < 1, F.raise_error(F.lit("a cap is 1 at least"))).otherwise(size)
    blocks = ordered_blocks(df, [key], order)
    with_rank = rank_in_blocks(blocks, [key], "_k")
    slot = F.floor(F.col("_k") / F.col("_cap")).cast("bigint") * window_us
    rows = with_rank.withColumn("_cap", size.cast("bigint")).withColumns(
        {
            "_lane": F.col("_k") % F.col("_cap"),
            "_slot": slot,
            "_v": F.unix_micros(F.col(at)) - slot,
        }
    )
    lane = [key, "_lane"]
    earlier = Window.partitionBy(*lane).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(
        rows.groupBy(*lane, "_block")
        .agg(F.max("_v").alias("_top"))
        .withColumn("_carry", F.max("_top").over(earlier))
        .drop("_top"),
        "carried",
    )
    inside = (
        Window.partitionBy(key, "_block", "_lane")
        .orderBy("_k")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_best", F.max("_v").over(inside))
    release = F.timestamp_micros(F.greatest("_best", "_carry") + F.col("_slot"))
    release = F.when(F.col("_cap").isNull(), local[at]).otherwise(release)
    return local.join(carried, same(local, carried, [key, "_block", "_lane"])).select(
        *[local[c] for c in df.columns], release.alias("release_at")
    )


def rate_limit_after(
    df: DataFrame, before: DataFrame, cap: Column | int, at: str, unique: str, key: str = "channel"
) -> DataFrame:
    """`rate_limit` of rows that follow earlier sends: `before` holds the last `cap`
    releases per key (key, `unique`, `at` = their release), see `last_releases`."""
    rows = df.withColumn("_new", F.lit(1))
    earlier = before.select(key, unique, at, F.lit(0).alias("_new"))
    rows = rows.unionByName(earlier, allowMissingColumns=True)
    limited = rate_limit(rows, cap, at, key, order=["_new", at, unique])
    return limited.where("_new = 1").drop("_new")


def last_releases(
    limited: DataFrame,
    before: DataFrame,
    cap: Column | int,
    at: str,
    unique: str,
    key: str = "channel",
    most: int | None = None,
) -> DataFrame:
    """The last `cap` releases per key among these rows and `before`.

    Keys without a cap (null) keep none. With a `cap` column, `most` is its largest
    value: a number bounds the rows before the shuffle too.
    """
    released = limited.select(key, unique, F.col("release_at").alias(at))
    latest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(unique))
    most = cap if isinstance(cap, int) else most
    numbered = (
        released.unionByName(before.select(key, unique, at))
        .withColumn("_r", F.row_number().over(latest))
    )
    if most is not None:
        numbered = numbered.where(F.col("_r") <= most)
    bound = F.lit(cap) if isinstance(cap, int) else cap
    return numbered.where(F.col("_r") <= bound).drop("_r")


def delayed(df: DataFrame, at: str = "requested_at") -> DataFrame:
    """Per channel: messages, delayed messages and the longest delay."""
    wait = F.unix_micros("release_at") - F.unix_micros(F.col(at))
    return df.groupBy("channel").agg(
        F.count("*").alias("n"),
        F.count_if(wait > 0).alias("n_delayed"),
        F.max(wait).alias("max_wait_us"),
    )
