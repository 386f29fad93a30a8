"""Column expressions over the 35-digit transaction id.

Layout: message id (13) + send method (2) + day of year (3) + sender (3) + sequence (14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import METHOD_CODES, SEQUENCE_DIGITS, TX_LENGTH

# \z, not $: a trailing line break must not pass.
TX_PATTERN = r"^[0-9]{13}0[1-5][0-9]{20}\z"
DIGITS = r"^[0-9]+\z"


def is_valid(tx: Column) -> Column:
    return F.coalesce(tx.rlike(TX_PATTERN), F.lit(False))


# tells an attempt apart: its id and count, and for a bad id the whole record
RECORD = "_record"
ATTEMPT = ["tx_id", "retry_count", RECORD]


def with_record(df: DataFrame) -> DataFrame:
    """Add RECORD: null for a valid id, the whole row as text for a bad one.

    Bad ids say nothing about which message a row belongs to, so only equal rows
    are copies of each other.
    """
    return df.withColumn(RECORD, F.when(~is_valid(F.col("tx_id")), F.to_json(F.struct("*"))))


def once_per_attempt(df: DataFrame) -> DataFrame:
    """Each attempt once; rows with a bad id stay unless they are equal in all columns."""
    return with_record(df).dropDuplicates(ATTEMPT).drop(RECORD)


def reject_reason(tx: Column) -> Column:
    """First failed rule, null for a valid id."""
    return (
        F.when(tx.isNull() | (tx == ""), "NULL_OR_EMPTY")
        .when(F.length(tx) != TX_LENGTH, "LENGTH")
        .when(~tx.rlike(DIGITS), "NON_DIGIT")
        .when(~F.substring(tx, 14, 2).isin(METHOD_CODES), "METHOD_CODE")
    )


def message_id(tx: Column) -> Column:
    return F.substring(tx, 1, 13)


def method_code(tx: Column) -> Column:
    return F.substring(tx, 14, 2)


def day_count(tx: Column) -> Column:
    return F.substring(tx, 16, 3).try_cast("int")


def sender_code(tx: Column) -> Column:
    return F.substring(tx, 19, 3)


def sequence(tx: Column) -> Column:
    return F.substring(tx, 22, SEQUENCE_DIGITS).try_cast("bigint")


def zero_pad(text: Column, width: int) -> Column:
    """Pad on the left but never cut, unlike a bare lpad."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def local_day(at: Column, zone: str) -> Column:
    return F.dayofyear(F.from_utc_timestamp(at, zone))


def epoch_message_id(at: Column) -> Column:
    """13 digits from the epoch milliseconds of `at`."""
    millis = F.floor(F.unix_micros(at) / 1000).cast("bigint").cast("string")
    return zero_pad(F.right(millis, F.lit(13)), 13)


def build_error(message: Column, method: Column, sender: Column, seq: Column) -> Column:
    """First part that cannot be used to build an id, null when all can."""
    padded_sender = zero_pad(sender, 3)
    padded_message = zero_pad(message, 13)
    return (
        F.when(method.isNull() | ~method.isin(METHOD_CODES), "METHOD_CODE")
        .when(
            sender.isNull() | (F.length(padded_sender) != 3) | ~padded_sender.rlike(DIGITS),
            "SENDER_CODE",
        )
        .when(
            message.isNull() | (F.length(padded_message) != 13) | ~padded_message.rlike(DIGITS),
            "MESSAGE_ID",
        )
        .when(seq.isNull() | (seq < 0) | (seq >= 10**SEQUENCE_DIGITS), "SEQUENCE")
    )


def build(message: Column, method: Column, day: Column, sender: Column, seq: Column) -> Column:
    """The id text, null when any part is out of range."""
    text = F.concat(
        zero_pad(message, 13),
        method,
        zero_pad(day.cast("string"), 3),
        zero_pad(sender, 3),
        zero_pad(seq.cast("string"), SEQUENCE_DIGITS),
    )
    return F.when(build_error(message, method, sender, seq).isNull(), text)
