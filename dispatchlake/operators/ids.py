"""Transaction ids: validate, parse, build, number, count duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import BUSINESS_ZONE, SEQUENCE_LIMIT
from dispatchlake.functions import txid
from dispatchlake.operators.ranking import ranked


def txid_validate(df: DataFrame, col: str = "tx_id") -> DataFrame:
    """Add `tx_valid`, `reject_reason` and, for a wrong length, `reject_detail`."""
    tx = F.col(col)
    reason = txid.reject_reason(tx)
    return df.withColumns(
        {
            "tx_valid": txid.is_valid(tx),
            "reject_reason": reason,
            "reject_detail": F.when(
                reason == "LENGTH", F.concat(F.lit("len_"), F.length(tx).cast("string"))
            ),
        }
    )


def txid_parse(df: DataFrame, col: str = "tx_id") -> DataFrame:
    """Add the five parts; all null when the id is invalid."""
    tx = F.when(txid.is_valid(F.col(col)), F.col(col))
    return df.withColumns(
        {
            "message_id": txid.message_id(tx),
            "send_method_code": txid.method_code(tx),
            "day_of_year": txid.day_count(tx),
            "sender_code": txid.sender_code(tx),
            "sequence": txid.sequence(tx),
        }
    )


def txid_build(
    df: DataFrame,
    method: str = "send_method_code",
    sender: str = "sender_code",
    at: str = "requested_at",
    sequence: str = "sequence",
    message: str | None = None,
    zone: str = BUSINESS_ZONE,
) -> DataFrame:
    """Add `built_tx_id` (null if impossible) and `build_error`.

    Without a `message` column the message id is the epoch milliseconds of `at`.
    """
    message_id = F.col(message).cast("string") if message else txid.epoch_message_id(F.col(at))
    sender_code = F.col(sender).cast("string")
    day = txid.local_day(F.col(at), zone)
    seq = F.col(sequence)
    return df.withColumns(
        {
            "built_tx_id": txid.build(message_id, F.col(method), day, sender_code, seq),
            "build_error": txid.build_error(message_id, F.col(method), sender_code, seq),
        }
    )


def txid_consistency(df: DataFrame, at: str = "requested_at", zone: str = BUSINESS_ZONE) -> DataFrame:
    """Add `day_in_range` (001-366) and `day_matches` (equals the local day of `at`)."""
    day = txid.day_count(F.col("tx_id"))
    valid = txid.is_valid(F.col("tx_id"))
    return df.withColumns(
        {
            "day_in_range": valid & day.between(1, 366),
            "day_matches": valid & (day == txid.local_day(F.col(at), zone)),
        }
    )


def assign_sequence(
    df: DataFrame,
    order: list[str],
    sender: str = "sender_code",
    at: str = "requested_at",
    zone: str = BUSINESS_ZONE,
) -> DataFrame:
    """Running number from 1 per sender and local day, wrapping at 10^14."""
    with_day = df.withColumn("sequence_day", txid.local_day(F.col(at), zone))
    numbered = ranked(with_day, [sender, "sequence_day"], order, "_rank")
    return numbered.withColumn("sequence", (F.col("_rank") + 1) % SEQUENCE_LIMIT).drop("_rank")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return df.groupBy("tx_id").agg(F.count("*").alias("n")).where("n > 1")


def txid_uniqueness(df: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, and whether they agree."""
    per_id = df.groupBy("tx_id").agg(F.count("*").alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"),
    ).withColumn("all_unique", F.col("n_rows") == F.col("n_distinct"))
