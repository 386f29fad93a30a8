"""Streaming twins of the batch operators. They share the column expressions.

Late data: every job takes a watermark delay (default ten minutes). What comes
later than that is not in the stream's output; `reconcile` on the stored tables
counts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import SUCCESS_FLOOR
from dispatchlake.functions import status, txid
from dispatchlake.operators.metrics import latency_bin, metric_columns
from dispatchlake.operators.routing import classify_failure, plan_retries

DELAY = "10 minutes"


def stream_minute_metrics(res: DataFrame, delay: str = DELAY) -> DataFrame:
    """Closed delivery minutes, with the columns of `minute_metrics` (append mode).

    The 95th percentile runs over `latency_bin`s, so that the state of a minute
    is bounded: exact below 2048 ms, within 0.05 % above.
    """
    minute = F.window("delivered_at", "1 minute")
    return (
        res.withWatermark("delivered_at", delay)
        .groupBy(
            minute.alias("w"),
            "channel",
            txid.method_code(F.col("tx_id")).alias("send_method_code"),
        )
        .agg(*metric_columns(), F.percentile(latency_bin(F.col("elapsed_ms")), 0.95).alias("_p95"))
        .select(
            F.col("w.start").alias("metric_time"),
            "channel",
            "send_method_code",
            "total_count",
            "success_count",
            "fail_count",
            "retry_count",
            "dlq_count",
            F.round("_avg").cast("int").alias("avg_latency_ms"),
            F.round("_p95").cast("int").alias("p95_latency_ms"),
            F.round("_p95", 3).alias("p95_exact"),
        )
    )


def stream_success_alert(
    res: DataFrame, delay: str = DELAY, floor: float = SUCCESS_FLOOR
) -> DataFrame:
    """Success rate over the last minute, every ten seconds (update mode).

    Every changed window is emitted with its `alert` flag, so an alert that
    clears is seen too.
    """
    rate = F.col("success") / F.col("total")
    return (
        res.withWatermark("delivered_at", delay)
        .groupBy(F.window("delivered_at", "1 minute", "10 seconds").alias("w"), "channel")
        .agg(
            F.count("*").alias("total"),
            F.count_if(status.is_success(F.col("result_code"))).alias("success"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "channel",
            "total",
            "success",
            rate.alias("rate"),
            (rate <= floor).alias("alert"),
        )
    )


def current_windows(updates: DataFrame) -> DataFrame:
    """The last state of each window among stored updates (column `batch_id`)."""
    keys = ["window_start", "window_end", "channel"]
    state = F.struct("total", "success", "rate", "alert")
    return (
        updates.groupBy(*keys).agg(F.max_by(state, F.col("batch_id")).alias("s")).select(*keys, "s.*")
    )


def stream_dedup(res: DataFrame, delay: str = DELAY, at: str = "delivered_at") -> DataFrame:
    """Each attempt once, although the feed delivers at least once.

    Rows with a bad id are copies only if they are equal in all columns.
    """
    marked = txid.with_record(res.withWatermark(at, delay))
    return marked.dropDuplicatesWithinWatermark(txid.ATTEMPT).drop(txid.RECORD)


RETRY_COLUMNS = [
    "tx_id",
    "channel",
    "send_channel",
    "decision",
    "reason",
    "next_retry_count",
    "delivered_at",
    "due_at",
]


def retry_steps(res: DataFrame) -> DataFrame:
    """Every failure with its decision: resends with `due_at`, dead letters and errors without.

    Feed it de-duplicated results; `runs.retry_stream` holds the resends.
    """
    final = (
        classify_failure(res)
        .where("decision in ('DLQ', 'ERROR')")
        .withColumns(
            {
                "send_channel": F.lit(None).cast("string"),
                "next_retry_count": F.lit(None).cast("int"),
                "due_at": F.lit(None).cast("timestamp"),
            }
        )
        .select(*RETRY_COLUMNS)
    )
    return plan_retries(res).select(*RETRY_COLUMNS).unionByName(final)
