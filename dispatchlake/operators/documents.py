"""Customer-month documents: one nested record per customer and month.

A document holds at most `max_sends` sends. Heavier customer-months continue
in numbered parts, so that no task ever gathers an unbounded array; every part
carries the month's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import BUSINESS_ZONE, HEAVY_SENDS
from dispatchlake.functions import txid
from dispatchlake.functions.times import local, year_month
from dispatchlake.operators.ranking import ranked

MAX_SENDS = 10_000
ORDER = ["requested_at", "tx_id", "retry_count"]


def send_struct() -> Column:
    """The 15 fields of a send; the sort fields come first."""
    return F.struct(
        F.col("requested_at").alias("requestedAt"),
        F.col("tx_id").alias("txId"),
        F.col("retry_count").cast("int").alias("retryCount"),
        "channel",
        txid.method_code(F.col("tx_id")).alias("sendMethodCode"),
        "sender",
        "receiver",
        F.col("body").alias("messageBody"),
        F.col("scheduled_at").alias("scheduledAt"),
        F.col("dispatched_at").alias("dispatchedAt"),
        F.col("delivered_at").alias("deliveredAt"),
        "status",
        F.col("result_code").alias("resultCode"),
        "source",
        F.struct("meta.campaignId", "meta.templateId").alias("meta"),
    )


def _collect(rows: DataFrame, keys: list[str], max_sends: int) -> DataFrame:
    """Group rows into arrays of at most `max_sends`, in send order.

    Every row has its exact rank inside its key from one range shuffle, and the
    rank names its part; a key of any size takes the same way. The key's total
    comes with the block offsets, so nothing is counted a second time.
    """
    ranks = ranked(rows, keys, ORDER, "_rank", total="total_count")
    return (
        ranks.withColumn("part", F.floor(F.col("_rank") / max_sends).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(
            F.first("total_count").alias("total_count"),
            F.array_sort(F.collect_list(send_struct())).alias("sends"),
            F.max("delivered_at").alias("updated_at"),
        )
        .select(*keys, "part", "total_count", "sends", "updated_at")
    )


def customer_month_docs(
    hist: DataFrame, zone: str = BUSINESS_ZONE, max_sends: int = MAX_SENDS
) -> DataFrame:
    """Documents `{customer}_{YYYYMM}` with ordered sends and the month's total.

    Parts after the first get a `_pN` suffix.
    """
    rows = hist.withColumn("year_month", year_month(F.col("requested_at"), zone))
    docs = _collect(rows, ["customer_id", "year_month"], max_sends)
    return docs.withColumn("doc_id", _doc_id(F.col("year_month"), F.col("part")))


def heavy_customers(hist: DataFrame, limit: int = HEAVY_SENDS, zone: str = BUSINESS_ZONE) -> DataFrame:
    """Customer-months above `limit` sends."""
    rows = hist.withColumn("year_month", year_month(F.col("requested_at"), zone))
    return (
        rows.groupBy("customer_id", "year_month")
        .agg(F.count("*").alias("total_count"))
        .where(F.col("total_count") > limit)
    )


def heavy_week_docs(
    hist: DataFrame,
    limit: int = HEAVY_SENDS,
    zone: str = BUSINESS_ZONE,
    max_sends: int = MAX_SENDS,
) -> DataFrame:
    """Weekly documents for heavy customer-months; `week` is 1-5 inside the month."""
    heavy = heavy_customers(hist, limit, zone).drop("total_count")
    day = F.dayofmonth(local(F.col("requested_at"), zone))
    rows = (
        hist.withColumn("year_month", year_month(F.col("requested_at"), zone))
        .join(heavy, ["customer_id", "year_month"], "left_semi")
        .withColumn("week", (F.floor((day - 1) / 7) + 1).cast("int"))
    )
    docs = _collect(rows, ["customer_id", "year_month", "week"], max_sends)
    stem = F.concat("year_month", F.lit("_w"), F.col("week").cast("string"))
    return docs.withColumn("doc_id", _doc_id(stem, F.col("part")))


def _doc_id(period: Column, part: Column) -> Column:
    suffix = F.when(part > 0, F.concat(F.lit("_p"), part.cast("string"))).otherwise("")
    return F.concat("customer_id", F.lit("_"), period, suffix)


def sends_of(docs: DataFrame) -> DataFrame:
    """Documents back to one row per send."""
    return docs.select("customer_id", "year_month", F.explode("sends").alias("s")).select(
        "customer_id", "year_month", "s.*"
    )


def customer_history(docs: DataFrame, customer_id: str, first: str, last: str) -> DataFrame:
    """One customer's sends over a range of months (YYYYMM, inclusive)."""
    return sends_of(
        docs.where(
            (F.col("customer_id") == customer_id) & F.col("year_month").between(first, last)
        )
    )


def find_send_in_docs(docs: DataFrame, tx_id: str) -> DataFrame:
    """The documents that hold a message, with only its sends."""
    mine = F.filter("sends", lambda s: s["txId"] == tx_id)
    return docs.where(F.exists("sends", lambda s: s["txId"] == tx_id)).withColumn("sends", mine)


def docs_by_status(docs: DataFrame, status: str | None = None, channel: str | None = None) -> DataFrame:
    """Number of sends and customers per status and channel inside the documents."""
    rows = sends_of(docs)
    if status:
        rows = rows.where(F.col("status") == status)
    if channel:
        rows = rows.where(F.col("channel") == channel)
    return rows.groupBy("status", "channel").agg(
        F.count("*").alias("n"), F.countDistinct("customer_id").alias("customers")
    )
