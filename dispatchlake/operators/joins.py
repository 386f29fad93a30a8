"""Joins of requests and results with registers, consent and each other.

Only tables with a fixed bound are broadcast by hint: the code table and the
sender register (three digits, so at most 1000 distinct codes). All others are
left to the adaptive planner, which broadcasts on measured size and splits
skewed partitions of the request or result side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import BUSINESS_ZONE, FALLBACK, ON_TIME_S, code_table
from dispatchlake.functions import status, txid
from dispatchlake.functions.text import address_key
from dispatchlake.functions.times import due_at, gap_us, local


def sender_register(ref: DataFrame) -> DataFrame:
    """Distinct three-digit codes as `_code`: at most 1000 rows, so broadcast."""
    codes = ref.where(F.col("sender_code").rlike(r"^[0-9]{3}\z")).select(
        F.col("sender_code").alias("_code")
    )
    return F.broadcast(codes.distinct())


def registered_only(req: DataFrame, ref: DataFrame) -> DataFrame:
    """Requests whose sender code is in the register."""
    return req.join(sender_register(ref), txid.sender_code(F.col("tx_id")) == F.col("_code"), "left_semi")


def unregistered(req: DataFrame, ref: DataFrame) -> DataFrame:
    """The others, with `refuse_reason`."""
    return req.join(
        sender_register(ref), txid.sender_code(F.col("tx_id")) == F.col("_code"), "left_anti"
    ).withColumn("refuse_reason", F.lit("UNREGISTERED_SENDER"))


def drop_opted_out(req: DataFrame, optout: DataFrame) -> DataFrame:
    """Requests to receivers who did not opt out. Formatting differences do not matter."""
    blocked = optout.select(address_key(F.col("receiver")).alias("_blocked")).distinct()
    return req.join(blocked, address_key(F.col("receiver")) == F.col("_blocked"), "left_anti")


def opted_out(req: DataFrame, optout: DataFrame) -> DataFrame:
    """The refused complement of `drop_opted_out`."""
    blocked = optout.select(address_key(F.col("receiver")).alias("_blocked")).distinct()
    return req.join(
        blocked, address_key(F.col("receiver")) == F.col("_blocked"), "left_semi"
    ).withColumn("refuse_reason", F.lit("OPTED_OUT"))


def apply_permissions(
    req: DataFrame, perms: DataFrame, key: str = "customer_id", zone: str = BUSINESS_ZONE
) -> DataFrame:
    """Add `allowed` and `refuse_reason` (CONSENT, NIGHT_BAN).

    `perms` has customer, sms_agree, email_agree, night_ban_end; of several rows of
    a customer the strictest values count, so requests never multiply.
    SMS, MMS and RCS need sms_agree, EMAIL needs email_agree, FAX neither; a
    customer without a row has not agreed. Sending is allowed while the local
    time is before night_ban_end.
    """
    rules = perms.groupBy(key).agg(
        F.bool_and(F.coalesce("sms_agree", F.lit(False))).alias("sms_agree"),
        F.bool_and(F.coalesce("email_agree", F.lit(False))).alias("email_agree"),
        F.min("night_ban_end").alias("night_ban_end"),
    )
    channel = F.col("channel")
    consent = (
        F.when(channel == "FAX", True)
        .when(channel == "EMAIL", F.col("email_agree"))
        .otherwise(F.col("sms_agree"))
    )
    clock = F.date_format(local(due_at(), zone), "HH:mm")
    reason = F.when(~F.coalesce(consent, F.lit(False)), "CONSENT").when(
        clock >= F.col("night_ban_end"), "NIGHT_BAN"
    )
    return (
        req.join(rules, key, "left")
        .withColumns({"refuse_reason": reason, "allowed": reason.isNull()})
        .drop("sms_agree", "email_agree", "night_ban_end")
    )


def _first_copy(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that share `keys` the first by `order`, so that reruns keep the same one."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def correlate(req: DataFrame, res: DataFrame) -> DataFrame:
    """Each result with the first request of its id."""
    sent = req.select("tx_id", "request_id", "scheduled_at", "requested_at", "meta", "body")
    return res.join(_first_copy(sent, ["tx_id"], ["requested_at", "request_id"]), "tx_id")


def missing_results(req: DataFrame, res: DataFrame) -> DataFrame:
    """Requests with a usable id that never got a result."""
    return req.where(txid.is_valid(F.col("tx_id"))).join(res.select("tx_id"), "tx_id", "left_anti")


def orphan_results(req: DataFrame, res: DataFrame) -> DataFrame:
    """Results that belong to no request."""
    return res.join(req.select("tx_id"), "tx_id", "left_anti").withColumn(
        "error_reason", F.lit("NO_REQUEST")
    )


def explain_codes(res: DataFrame) -> DataFrame:
    """Add code_class, meaning and next_step; null for unknown codes."""
    return res.join(F.broadcast(code_table(res.sparkSession)), "result_code", "left")


def fallback_chain(res: DataFrame) -> DataFrame:
    """Rich-message attempts that were not supported, with the SMS attempt that followed."""
    first = res.where((F.col("result_code") == FALLBACK) & (F.col("channel") == "RCS")).select(
        "tx_id",
        F.col("retry_count").alias("rcs_attempt"),
        (F.col("retry_count") + 1).alias("_next"),
        F.col("delivered_at").alias("rcs_delivered_at"),
    )
    later = res.where(F.col("channel") == "SMS").select(
        "tx_id",
        F.col("retry_count").alias("_next"),
        F.col("result_code").alias("sms_code"),
        F.col("status").alias("sms_status"),
        F.col("dispatched_at").alias("sms_dispatched_at"),
    )
    keys = ["tx_id", "_next"]
    first = _first_copy(first, keys, ["rcs_delivered_at", "rcs_attempt"])
    later = _first_copy(later, keys, ["sms_dispatched_at", "sms_code"])
    return first.join(later, keys, "left").drop("_next")


def due_times(req: DataFrame) -> DataFrame:
    """Due time per id; repeated requests collapse before the join."""
    return req.groupBy("tx_id").agg(F.min(due_at()).alias("due_at"))


def scheduled_dispatches(req: DataFrame, res: DataFrame, tolerance_s: int = ON_TIME_S) -> DataFrame:
    """First attempts of batch messages with their deviation from the schedule."""
    due = due_times(req.where(status.method_lane(F.col("tx_id")) == "batch"))
    first = res.where("retry_count = 0").select("tx_id", "channel", "dispatched_at")
    late = gap_us(F.col("dispatched_at"), F.col("due_at"))
    return first.join(due, "tx_id").withColumns(
        {"late_us": late, "on_time": F.abs(late) <= tolerance_s * 1_000_000}
    )


def schedule_accuracy(
    req: DataFrame, res: DataFrame, tolerance_s: int = ON_TIME_S, floor: float = 0.99
) -> DataFrame:
    """Share of batch messages dispatched on time, per channel."""
    return (
        scheduled_dispatches(req, res, tolerance_s)
        .groupBy("channel")
        .agg(
            F.count("*").alias("n"),
            F.count_if("on_time").alias("n_on_time"),
            F.max(F.abs("late_us")).alias("max_deviation_us"),
        )
        .withColumn("on_time_share", F.col("n_on_time") / F.col("n"))
        .withColumn("ok", F.col("on_time_share") >= floor)
    )


def batch_progress(schedule: DataFrame, members: DataFrame, res: DataFrame) -> DataFrame:
    """Planned and finished messages per batch.

    `members` maps tx_id to batch_id. A message is finished when its last
    attempt is no retry: any attempt that ends the chain counts it once.
    """
    decided = status.decision(F.col("tx_id"), F.col("result_code"), F.col("retry_count"))
    finished = (
        res.groupBy("tx_id")
        .agg(
            F.bool_or(decided.isin("DONE", "DLQ")).alias("done"),
            F.bool_or(F.col("status") == "DELIVERED").alias("ok"),
        )
        .join(members.select("tx_id", "batch_id").distinct(), "tx_id")
        .groupBy("batch_id")
        .agg(F.count_if("done").alias("processed"), F.count_if("ok").alias("delivered"))
    )
    zero = F.lit(0)
    return (
        schedule.join(finished, "batch_id", "left")
        .withColumns(
            {
                "processed": F.coalesce("processed", zero),
                "delivered": F.coalesce("delivered", zero),
            }
        )
        .withColumn("complete", F.col("processed") >= F.col("total_requests"))
    )


def contact_addresses(contacts: DataFrame) -> DataFrame:
    """Address to customer, one row per address (the smallest customer id wins)."""
    numbers = F.transform("contacts.phoneNumbers", lambda p: p["number"])
    mails = F.transform("contacts.emailAddresses", lambda m: m["address"])
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(numbers, empty), F.coalesce(mails, empty))
    return (
        contacts.select("customer_id", F.explode(both).alias("_a"))
        .groupBy(address_key(F.col("_a")).alias("address"))
        .agg(F.min("customer_id").alias("customer_id"))
        .where("address is not null")
    )


def resolve_customer(res: DataFrame, contacts: DataFrame) -> DataFrame:
    """Add the customer the receiver belongs to; null when nobody has the address."""
    book = contact_addresses(contacts)
    return res.join(book, address_key(F.col("receiver")) == F.col("address"), "left").drop("address")


def customer_snapshot(sends: DataFrame, profile: DataFrame) -> DataFrame:
    """Attach the month's contacts and permissions (customer_id, year_month)."""
    return sends.join(profile, ["customer_id", "year_month"], "left")
