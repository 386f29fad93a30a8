"""Starting stream jobs: triggers, checkpoints, idempotent micro-batches.

One query with its own checkpoint per channel feed keeps channels independent:
a feed that fails or falls behind stops only its own query. After a restart a
query goes on from its checkpoint; sinks here tolerate a repeated micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dispatchlake.codes import CHANNELS, DISPATCH_FEED
from dispatchlake.operators.history import latest_status
from dispatchlake.operators.ratelimit import last_releases, rate_limit_after
from dispatchlake.operators.routing import route_requests, route_results
from dispatchlake.session import configure_streaming, scratch_scope
from dispatchlake.sources.feeds import read_feed
from dispatchlake.streaming.commits import Batch, Layout, in_one_commit, stored
from dispatchlake.streaming.hold import TICK, release, with_ticks
from dispatchlake.streaming.jobs import retry_steps


def _start(spark: SparkSession, writer: object, every: str | None) -> StreamingQuery:
    """Process what is there and stop, or run on with a trigger interval.

    A stream keeps the session's number of shuffle partitions, and so of state
    stores, for life: set it before the first start.
    """
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()


def to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    by: list[str] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once."""
    spark = configure_streaming(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return _start(spark, writer.partitionBy(*by) if by else writer, every)


def for_each(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    spark = configure_streaming(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).foreachBatch(step)
    return _start(spark, writer.option("checkpointLocation", checkpoint), every)


def updates_to_table(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Store every micro-batch of an update-mode stream under its `batch_id`."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_each(stream, step, checkpoint, "update", every)


def route_stream(
    stream: DataFrame, kind: str, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Route requests or results. One partitioned write per micro-batch serves
    all routes, so the batch is neither cached nor evaluated per sink."""
    route = route_requests if kind == "request" else route_results

    def step(batch: DataFrame, batch_id: int) -> None:
        route(batch).write.mode("overwrite").partitionBy("route").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return for_each(stream, step, checkpoint, every=every)


def history_stream(
    stages: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append stage events (PENDING, SENT, result). `current_history` reads them."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_each(stages, step, checkpoint, every=every)


def current_history(spark: SparkSession, path: str) -> DataFrame:
    """State of every message from the stored stage events."""
    return latest_status(spark.read.parquet(path))


LIMITED = {"rows": Layout(), "state": Layout()}


def rate_limit_stream(
    stream: DataFrame,
    cap: int,
    path: str,
    checkpoint: str,
    at: str = "requested_at",
    unique: str = "tx_id",
    every: str | None = None,
) -> StreamingQuery:
    """Sliding-window limit across micro-batches, exact for channels of any size.

    Each batch runs the distributed batch operator. The last `cap` releases per
    channel are the whole state; they stand before the next batch's arrivals and are
    one commit with its rows. Tables staged on the way are deleted.
    """
    release = StructType([stream.schema[c] for c in ("channel", unique, at)])

    def step(rows: DataFrame, batch: Batch) -> None:
        with scratch_scope(rows.sparkSession):
            before = batch.commits.read("state", release)
            limited = rate_limit_after(rows, before, cap, at, unique)
            written = batch.written("rows", batch.append("rows", limited))
            batch.replace("state", last_releases(written, before, cap, at, unique))

    return for_each(stream, in_one_commit(path, LIMITED, step), checkpoint, every=every)


def limited_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a `rate_limit_stream` with their `release_at`."""
    return stored(spark, path, "rows")


def hold_until(
    stream: DataFrame,
    due: str,
    path: str,
    checkpoint: str,
    at: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Release each row at the first trigger after its `due` time (null: at once).

    The clock is the machine's time; for a replayed feed name its time column
    `at`, then the clock is the latest such time seen. With `every` the job
    runs on and also releases while nothing arrives. `hold.released` and
    `hold.held` read the result. A path belongs to one checkpoint.
    """
    live = every and at is None
    marked = with_ticks(stream) if live else stream.withColumn(TICK, F.lit(False))

    def step(batch: DataFrame, batch_id: int) -> None:
        release(batch, batch_id, path, due, at)

    return for_each(marked, step, checkpoint, every=every)


def retry_stream(
    res: DataFrame, path: str, checkpoint: str, at: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Resends when their back-off has passed; dead letters and errors at once."""
    return hold_until(retry_steps(res), "due_at", path, checkpoint, at, every)


def hold_stream(
    req: DataFrame, path: str, checkpoint: str, at: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Scheduled requests when their time has come; all others at once."""
    return hold_until(req, "scheduled_at", path, checkpoint, at, every)


def channel_streams(
    spark: SparkSession,
    job: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    location: str | None = None,
    servers: str | None = None,
    channels: list[str] | None = None,
    every: str | None = None,
) -> dict[str, StreamingQuery]:
    """One query and checkpoint per channel feed."""
    started = {}
    for channel in channels or CHANNELS:
        feed = f"{DISPATCH_FEED}.{channel.lower()}"
        stream = job(read_feed(spark, feed, location, servers))
        started[channel] = to_table(
            stream, f"{path}/channel={channel}", f"{checkpoint}/{channel}", every=every
        )
    return started


