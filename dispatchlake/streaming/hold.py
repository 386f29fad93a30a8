"""Hold records until their due time, in a log of segments with one manifest.

A micro-batch has one time, its clock. Rows that are due leave at once; the others
are written as a segment, ranged by due time. The batch then releases the stored
rows that became due since the clock before it; the manifest's ranges of due time
name the files that may hold some. A row is stored with a due time after its own
batch's clock, so it falls between two clocks once: it leaves once, not early, and
within one trigger. Waiting rows, released rows and the clock are one commit
(`commits`), so an attempt that dies leaves no trace, its clock included.

Files that hold only past due times are forgotten; segments are merged by levels,
without the rows that have left. So the files opened by a trigger are those of the
time that has passed, however many rows wait.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispatchlake.streaming.commits import Commits, Layout

TICK = "_tick"
DUE = "_due_us"
TABLES = {"held": Layout(index=DUE), "released": Layout()}


def with_ticks(stream: DataFrame) -> DataFrame:
    """Add a row of nulls per second, so that triggers fire without new data."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    seconds = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    ticks = seconds.select(*blank, F.lit(True).alias(TICK))
    return stream.withColumn(TICK, F.lit(False)).unionByName(ticks)


def release(batch: DataFrame, batch_id: int, path: str, due: str, at: str | None = None) -> None:
    """One micro-batch: store the rows that wait, write those that leave.

    Rows marked as ticks only drive the clock.
    """
    commits = Commits(batch.sparkSession, path, TABLES)
    writer = commits.batch(batch_id)
    if writer is None:
        return
    rows = batch.where(~F.col(TICK)).drop(TICK).persist()
    try:
        before = commits.state.get("now_us", 0)
        if at is None:
            now = time.time_ns() // 1000
        else:
            now = rows.agg(F.max(F.unix_micros(at))).first()[0] or before
        now = max(before, now)
        due_us = F.unix_micros(due)
        waits = F.coalesce(due_us > now, F.lit(False))
        ready = commits.read("held", rows.withColumn(DUE, due_us).schema, before, now)
        ready = ready.where((F.col(DUE) > before) & (F.col(DUE) <= now)).select(*rows.columns)
        leaving = rows.where(~waits).unionByName(ready).withColumns(
            {
                "released_at": F.timestamp_micros(F.lit(now)),
                "batch_id": F.lit(batch_id).cast("bigint"),
            }
        )
        writer.append("released", leaving)
        writer.append("held", rows.where(waits).withColumn(DUE, due_us))
        writer.drop("held", now)
        writer.merge("held", F.col(DUE) > now)
        writer.merge("released")
        writer.state["now_us"] = now
        writer.commit()
    finally:
        rows.unpersist()


def released(spark: SparkSession, path: str) -> DataFrame:
    """Rows that have left, with `released_at` and `batch_id`; none before the first commit."""
    return Commits(spark, path).read("released")


def held(spark: SparkSession, path: str, schema: StructType, due: str) -> DataFrame:
    """Rows that still wait, in the columns of `schema`."""
    commits = Commits(spark, path)
    now = commits.state.get("now_us", 0)
    waiting = commits.read("held", StructType(list(schema.fields)).add(DUE, "long"), now)
    return waiting.where(F.col(DUE) > now).select(*schema.names)
