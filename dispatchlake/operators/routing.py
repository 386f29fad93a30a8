"""Routing: which path a request or result takes, and on which lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import ADAPTER_VERSION, BAD_RECEIVER, DISPATCH_FEED, TEXT_BAD_TXID
from dispatchlake.functions import status, txid
from dispatchlake.operators.ids import txid_validate
from dispatchlake.operators.intake import attach_trace
from dispatchlake.operators.ranking import ranked


def route_requests(df: DataFrame, node: str = "spark", received_at: Column | None = None) -> DataFrame:
    """Valid ids go to the request feed with trace columns, the rest to rejects."""
    traced = attach_trace(txid_validate(df), "REQUEST_RECEIVED", node, received_at)
    return traced.withColumn("route", F.when(F.col("tx_valid"), "request").otherwise("reject"))


def route_results(df: DataFrame) -> DataFrame:
    """Add `route` (success, retry, failed, error; first match wins) and `level`."""
    route = status.result_route(F.col("tx_id"), F.col("result_code"))
    return df.withColumns({"route": route, "level": status.log_level(route)})


def derive_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", status.status_of(F.col("result_code")))


def build_result(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Request rows with an outcome to the 13 result columns.

    Needs `result_code`, `error_detail` and `elapsed_ms`. A request with a bad
    id always fails with 40001, whatever the outcome column says.
    """
    moment = now if now is not None else F.current_timestamp()
    valid = txid.is_valid(F.col("tx_id"))
    code = F.when(valid, F.col("result_code")).otherwise(BAD_RECEIVER)
    empty = F.lit("")
    tx = F.when(F.coalesce(F.col("tx_id"), empty) == "", "INVALID_TX_ID").otherwise(F.col("tx_id"))
    sent_at = F.col("dispatched_at") if "dispatched_at" in df.columns else F.lit(None)
    return df.select(
        tx.alias("tx_id"),
        "channel",
        F.coalesce("receiver", empty).alias("receiver"),
        F.coalesce("sender", empty).alias("sender"),
        status.status_of(code).alias("status"),
        code.alias("result_code"),
        F.when(valid, F.col("error_detail")).otherwise(TEXT_BAD_TXID).alias("error_detail"),
        F.coalesce(F.col("meta.retryCount"), F.lit(0)).alias("retry_count"),
        F.coalesce("source", empty).alias("source"),
        F.coalesce(sent_at.cast("timestamp"), moment).alias("dispatched_at"),
        moment.alias("delivered_at"),
        F.when(valid, F.col("elapsed_ms")).otherwise(0).alias("elapsed_ms"),
        F.lit(ADAPTER_VERSION).alias("adapter_version"),
    )


def build_retry(df: DataFrame) -> DataFrame:
    """Requests whose outcome is 5xxxx, with the code as `retry_result_code`."""
    return df.where(status.is_retryable(F.col("result_code"))).withColumnRenamed(
        "result_code", "retry_result_code"
    )


def select_channel(
    df: DataFrame, rules: list[tuple[Column, str]] | None = None, code: str | None = "result_code"
) -> DataFrame:
    """Add `send_channel`: policy rules in order, then fallback, then as asked."""
    chosen = F.col("channel")
    if code:
        chosen = status.next_channel(chosen, F.coalesce(F.col(code), F.lit("")))
    for condition, channel in reversed(rules or []):
        chosen = F.when(condition, channel).otherwise(chosen)
    return df.withColumn("send_channel", chosen)


def classify_failure(df: DataFrame) -> DataFrame:
    """Add `decision` (DONE, RETRY, DLQ, ERROR) and `reason`."""
    args = (F.col("tx_id"), F.col("result_code"), F.col("retry_count"))
    return df.withColumns(
        {"decision": status.decision(*args), "reason": status.decision_reason(*args)}
    )


def plan_retries(df: DataFrame) -> DataFrame:
    """The resend of every retryable result: channel, attempt number and due time.

    Waits 30, 60 and 120 s; 50002 continues on SMS and counts as an attempt.
    """
    return (
        classify_failure(df)
        .where("decision = 'RETRY'")
        .withColumns(
            {
                "send_channel": status.next_channel(F.col("channel"), F.col("result_code")),
                "due_at": status.retry_due(F.col("delivered_at"), F.col("retry_count")),
                "next_retry_count": F.col("retry_count") + 1,
            }
        )
    )


def dead_letters(df: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Results that end in the dead-letter table, with reason and full payload."""
    payload = F.to_json(F.struct(*df.columns))
    return (
        classify_failure(df)
        .where("decision = 'DLQ'")
        .select(
            "tx_id",
            "channel",
            F.col("reason").alias("error_reason"),
            payload.alias("payload"),
            (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        )
    )


def method_lane(df: DataFrame) -> DataFrame:
    """Add `lane`: batch, online or near_real_time; null for other codes."""
    return df.withColumn("lane", status.method_lane(F.col("tx_id")))


def assign_lane(
    df: DataFrame,
    live_lanes: dict[str, int],
    order: list[str] | None = None,
) -> DataFrame:
    """Round-robin each channel's requests over its live senders.

    Requests take turns by priority, arrival and id. `live_lanes` holds the
    number of live senders per channel, so a failed one is simply left out and
    the others share its part. `send_lane` is null for a channel without any.
    """
    rank = ranked(df, ["channel"], order or ["priority", "requested_at", "tx_id"], "_turn")
    width = F.lit(None).cast("bigint")
    for channel, n in live_lanes.items():
        width = F.when((F.col("channel") == channel) & F.lit(n > 0), n).otherwise(width)
    return rank.withColumn("send_lane", F.try_mod(F.col("_turn"), width)).drop("_turn")


def dispatch_feed(channel: str = "channel") -> Column:
    """Name of the dispatch feed of a channel."""
    return F.concat(F.lit(DISPATCH_FEED + "."), F.lower(channel))


def with_dispatch_feed(df: DataFrame, channel: str = "channel") -> DataFrame:
    return df.withColumn("topic", dispatch_feed(channel))
