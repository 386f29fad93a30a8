"""Delivery history: rows, current state, attempt chains, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.functions import status, txid
from dispatchlake.functions.times import gap_us

TIMES = ["requested_at", "dispatched_at", "delivered_at"]


def history_rows(req: DataFrame, res: DataFrame) -> DataFrame:
    """Results in the history table's columns, with the request's times.

    Every result stays; without a request its columns are null. A request that
    arrived several times counts once, as its first arrival, so copies on both
    sides never multiply.
    """
    kept = ["request_id", "scheduled_at", "requested_at", "customer_id", "body", "meta"]
    first = F.min_by(F.struct(*kept), F.struct("requested_at", "request_id")).alias("_first")
    sent = req.where(txid.is_valid(F.col("tx_id"))).groupBy("tx_id").agg(first)
    sent = sent.select("tx_id", "_first.*")
    return res.join(sent, "tx_id", "left").select(
        "tx_id",
        "request_id",
        "channel",
        "sender",
        "receiver",
        "status",
        "result_code",
        F.col("retry_count").cast("smallint").alias("retry_count"),
        "source",
        "scheduled_at",
        "requested_at",
        "dispatched_at",
        "delivered_at",
        F.col("delivered_at").alias("created_at"),
        "customer_id",
        "body",
        "meta",
    )


def stage_events(req: DataFrame, res: DataFrame) -> DataFrame:
    """One row per step of a message: requested, dispatched, result received.

    All steps of a result come from one pass over it.
    """
    none = F.lit(None).cast("timestamp")
    pending = req.select(
        "tx_id",
        F.lit(0).alias("retry_count"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("result_code"),
        F.col("requested_at").alias("at"),
        "requested_at",
        none.alias("dispatched_at"),
        none.alias("delivered_at"),
    )

    def step(name: str, at: str, code: object, sent: object, done: object) -> object:
        return F.struct(
            (F.lit(name) if name else F.col("status")).alias("status"),
            code.alias("result_code"),
            F.col(at).alias("at"),
            sent.alias("dispatched_at"),
            done.alias("delivered_at"),
        )

    no_code = F.lit(None).cast("string")
    steps = F.array(
        step("SENT", "dispatched_at", no_code, F.col("dispatched_at"), none),
        step("", "delivered_at", F.col("result_code"), none, F.col("delivered_at")),
    )
    results = res.select("tx_id", "retry_count", F.explode(steps).alias("s")).select(
        "tx_id",
        "retry_count",
        "s.status",
        "s.result_code",
        "s.at",
        none.alias("requested_at"),
        "s.dispatched_at",
        "s.delivered_at",
    )
    return pending.unionByName(results)


def latest_status(events: DataFrame) -> DataFrame:
    """Current state of each id: highest attempt, then stage, then time.

    Each time column keeps its last known value. Partial aggregation absorbs
    ids with very many (duplicate) events.
    """
    rank = F.struct(F.col("retry_count"), status.status_rank(F.col("status")), F.col("at"))
    state = F.max_by(F.struct("retry_count", "status", "result_code"), rank)
    return (
        events.groupBy("tx_id")
        .agg(
            state.alias("_s"),
            *[F.max_by(t, F.when(F.col(t).isNotNull(), rank)).alias(t) for t in TIMES],
        )
        .select("tx_id", "_s.retry_count", "_s.status", "_s.result_code", *TIMES)
    )


def attempt_chain(res: DataFrame) -> DataFrame:
    """Attempts in order with the previous and next code and the gap before.

    Copies of an attempt are dropped first, so an id has few rows here. A result
    with a bad id is a chain of its own.
    """
    chain = Window.partitionBy("tx_id", txid.RECORD).orderBy("retry_count")
    once = txid.with_record(res).dropDuplicates(txid.ATTEMPT)
    chained = once.withColumns(
        {
            "previous_code": F.lag("result_code").over(chain),
            "next_code": F.lead("result_code").over(chain),
            "gap_us": gap_us(F.col("dispatched_at"), F.lag("delivered_at").over(chain)),
        }
    )
    return chained.drop(txid.RECORD)


def history_by_tx(hist: DataFrame, tx_id: str) -> DataFrame:
    """The whole path of one message."""
    return hist.where(F.col("tx_id") == tx_id).orderBy("retry_count", "delivered_at")


def history_by_receiver(hist: DataFrame, receiver: str, limit: int | None = None) -> DataFrame:
    """A receiver's sends, newest first; with `limit` the newest so many (no full sort)."""
    rows = (
        hist.where(F.col("receiver") == receiver)
        .orderBy(F.desc("requested_at"), "tx_id", F.desc("retry_count"))
    )
    return rows if limit is None else rows.limit(limit)


def retry_candidates(hist: DataFrame, wanted: str = "RETRYING", channel: str | None = None) -> DataFrame:
    """Rows in a status, optionally of one channel."""
    rows = hist.where(F.col("status") == wanted)
    return rows.where(F.col("channel") == channel) if channel else rows


def recent_metrics(metrics: DataFrame, n: int) -> DataFrame:
    """The newest n metric minutes of each channel.

    Rows are first merged per minute; the rank limit is applied before the
    shuffle too.
    """
    newest = Window.partitionBy("channel").orderBy(F.desc("metric_time"))
    per_minute = metrics.groupBy("channel", "metric_time").agg(
        F.sum("total_count").alias("total_count"), F.sum("success_count").alias("success_count")
    )
    return per_minute.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)
