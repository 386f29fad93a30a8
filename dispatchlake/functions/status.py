"""Result-code rules: status, route, retry decision. Shared by batch and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchlake.codes import (
    FALLBACK,
    MAX_RETRIES,
    METHOD_LANES,
    RETRY_BASE_S,
    STATUS_RANK,
    SUCCESS,
    lookup,
)
from dispatchlake.functions import txid


def is_success(code: Column) -> Column:
    return code == SUCCESS


def is_retryable(code: Column) -> Column:
    return code.startswith("5")


def is_permanent(code: Column) -> Column:
    return code.startswith("4")


def status_of(code: Column) -> Column:
    return F.when(is_success(code), "DELIVERED").when(is_retryable(code), "RETRYING").otherwise("FAILED")


def status_rank(status: Column) -> Column:
    return F.try_element_at(lookup(STATUS_RANK), status)


def result_route(tx: Column, code: Column) -> Column:
    """First match wins; a bad id or an unknown code goes to `error`."""
    return (
        F.when(~txid.is_valid(tx), "error")
        .when(is_success(code), "success")
        .when(is_retryable(code), "retry")
        .when(is_permanent(code), "failed")
        .otherwise("error")
    )


def log_level(route: Column) -> Column:
    return F.when(route == "success", "info").when(route == "retry", "warn").otherwise("error")


def decision(tx: Column, code: Column, retry_count: Column) -> Column:
    return (
        F.when(~txid.is_valid(tx), "DLQ")
        .when(is_success(code), "DONE")
        .when(is_permanent(code), "DLQ")
        .when(is_retryable(code) & (retry_count >= MAX_RETRIES), "DLQ")
        .when(is_retryable(code), "RETRY")
        .otherwise("ERROR")
    )


def decision_reason(tx: Column, code: Column, retry_count: Column) -> Column:
    return (
        F.when(~txid.is_valid(tx), "INVALID_TX_ID")
        .when(is_success(code), F.lit(None).cast("string"))
        .when(is_permanent(code), "PERMANENT")
        .when(is_retryable(code) & (retry_count >= MAX_RETRIES), "RETRY_EXHAUSTED")
        .when(is_retryable(code), code)
        .otherwise("UNKNOWN_CODE")
    )


def next_channel(channel: Column, code: Column) -> Column:
    return F.when(code == FALLBACK, "SMS").otherwise(channel)


def retry_delay_s(retry_count: Column) -> Column:
    """30 s, 60 s, 120 s for the first, second and third retry."""
    return (F.pow(F.lit(2), retry_count) * RETRY_BASE_S).cast("bigint")


def retry_due(delivered_at: Column, retry_count: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(delivered_at) + retry_delay_s(retry_count) * 1_000_000)


def method_lane(tx: Column) -> Column:
    return F.try_element_at(lookup(METHOD_LANES), txid.method_code(tx))
