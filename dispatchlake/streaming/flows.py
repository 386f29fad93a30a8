"""The two whole jobs as streams: requests to dispatch, results to their stores.

Each is one query: a micro-batch is parsed once, staged, and written to all of the
job's tables in one commit (`commits`). So after a kill at any point a batch is in
every table or in none, and running it again changes nothing. Feeds on a broker
cannot be part of that commit: they are published just before it, so their readers
may see records of a batch twice and de-duplicate, as the feeds ask them to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dispatchlake import schemas
from dispatchlake.codes import BUSINESS_ZONE, DLQ_FEED, RETRY_FEED
from dispatchlake.functions import txid
from dispatchlake.operators.channels import ChannelSpec, cap_of, default_specs, format_for_channel
from dispatchlake.operators.history import history_rows
from dispatchlake.operators.intake import attach_trace, parse_requests, parse_results
from dispatchlake.operators.metrics import latency_counts, merged_minute_metrics
from dispatchlake.operators.ranking import same
from dispatchlake.operators.ratelimit import last_releases, rate_limit_after
from dispatchlake.operators.routing import (
    dead_letters,
    dispatch_feed,
    plan_retries,
    route_results,
    select_channel,
)
from dispatchlake.plans.dispatch import ADDED, screen_requests
from dispatchlake.session import scratch_scope, stage
from dispatchlake.sources.feeds import to_feed, write_feed
from dispatchlake.sources.sinks import as_history
from dispatchlake.streaming.commits import Batch, Layout, in_one_commit, stored
from dispatchlake.streaming.runs import for_each

ID_DAY = "id_day"
BY_TX = {"parquet.bloom.filter.enabled#tx_id": "true"}
FEED_COLUMNS = ["key", "value", "topic", "timestamp"]

DISPATCH_TABLES = {
    "requests": Layout(by=(ID_DAY,), order=("tx_id",), options=BY_TX),
    "dispatch": Layout(by=("topic",)),
    "rejects": Layout(by=("reject_reason",)),
    "releases": Layout(),  # the last sends per channel, for the rate limit
}
SETTLE_TABLES = {
    "history": Layout(by=("day",), order=("receiver", "requested_at"), options=BY_TX),
    "metrics": Layout(by=("day",)),  # parts, see `stored_metrics`
    "retry": Layout(),
    "dlq": Layout(),
    "log": Layout(by=("level",)),
    "errors": Layout(),
    "seen": Layout(index="_delivered_us"),
}


def id_day(tx: Column) -> Column:
    """Day of the id's first 13 digits, the epoch milliseconds; null for a bad id."""
    millis = F.when(txid.is_valid(tx), txid.message_id(tx).cast("bigint"))
    return F.to_date(F.timestamp_millis(millis))


def _publish(records: DataFrame, location: str | None, servers: str | None) -> None:
    if location or servers:
        write_feed(records.select(*FEED_COLUMNS), location, servers)


def dispatch_stream(
    records: DataFrame,
    register: DataFrame,
    optout: DataFrame,
    permissions: DataFrame,
    contacts: DataFrame,
    cap: int | None,
    path: str,
    checkpoint: str,
    arrival: Column | None = None,
    specs: list[ChannelSpec] | None = None,
    zone: str = BUSINESS_ZONE,
    location: str | None = None,
    servers: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Request feed (`read_feed`) to dispatch feed: parse, screen, choose a channel, pace.

    Tables below `path`: `requests` (what is sent, with `send_channel` and
    `release_at`), `dispatch` (its records per channel topic), `rejects` (refused and
    unparsed, with reason and payload). The rows equal those of `screen_requests` and
    `dispatch_requests` over the whole feed, if batches come in the order of
    `arrival` (default: requested_at). Ids that repeat are paced one by one; equal
    ids of one batch and arrival take any order.
    """
    at = "_at"
    release = StructType().add("send_channel", "string").add("_unique", "string").add(at, "timestamp")
    moment = F.col("requested_at") if arrival is None else arrival
    rules = specs or default_specs()
    caps = [c for c in [cap, *(s.cap for s in rules)] if c is not None]
    most = max(caps, default=0)

    def step(rows: DataFrame, batch: Batch) -> None:
        with scratch_scope(rows.sparkSession):
            parsed = stage(parse_requests(rows), "parsed")
            good = parsed.where("parse_ok").drop(*FEED_COLUMNS, "parse_ok", "raw")
            screened = screen_requests(
                good, register, optout, permissions, specs, zone, contacts
            )
            screened = stage(screened, "screened")
            payload = F.to_json(F.struct(*good.columns))
            refused = screened.where("refuse_reason is not null").select(
                "tx_id", F.col("refuse_reason").alias("reject_reason"), "refuse_detail", payload.alias("payload")
            )
            unparsed = parsed.where("not parse_ok").select(
                F.col("key").alias("tx_id"),
                F.lit("UNPARSED").alias("reject_reason"),
                F.lit(None).cast("string").alias("refuse_detail"),
                F.col("raw").alias("payload"),
            )
            rejects = refused.unionByName(unparsed)
            batch.append("rejects", rejects.withColumn("received_at", F.current_timestamp()))
            accepted = select_channel(screened.where("refuse_reason is null").drop(*ADDED), code=None)
            # rows of one id and arrival stay apart by their own number
            number = F.monotonically_increasing_id().cast("string")
            keyed = accepted.withColumns(
                {at: moment, "_unique": F.concat_ws("#", "tx_id", F.lpad(number, 19, "0"))}
            )
            before = batch.commits.read("releases", release)
            pace = cap_of(F.col("send_channel"), rules, cap)
            paced = rate_limit_after(keyed, before, pace, at, "_unique", "send_channel")
            segment = batch.append("requests", paced.withColumn(ID_DAY, id_day(F.col("tx_id"))))
            sent = batch.written("requests", segment)
            last = last_releases(sent, before, pace, at, "_unique", "send_channel", most)
            batch.replace("releases", last)
            formatted = format_for_channel(
                sent.withColumn("channel", F.col("send_channel")).drop(at, "_unique", ID_DAY)
            )
            out = to_feed(formatted, dispatch_feed("channel"), F.col("release_at"))
            segment = batch.append("dispatch", out)
            _publish(batch.written("dispatch", segment), location, servers)

    return for_each(records, in_one_commit(path, DISPATCH_TABLES, step), checkpoint, every=every)


def settle_stream(
    records: DataFrame,
    requests: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    node: str = "spark",
    forget_us: int = 24 * 3600 * 1_000_000,
    location: str | None = None,
    servers: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Result feed to history, metrics, retries, dead letters, log and errors.

    `requests` gives the current request table (for example that of
    `dispatch_stream`); with an `id_day` column only the days of the batch's ids are
    read. Each attempt counts once: a copy of a result is known by its id and count
    while no result over `forget_us` newer has come. The tables hold the rows of
    `settle_results` over the whole feed: `history` with the request's columns,
    `metrics` as parts, `retry` and `dlq` also as feed records, `log`, `errors`
    (unknown codes, bad ids and unparsed records with their text).
    """

    def step(rows: DataFrame, batch: Batch) -> None:
        with scratch_scope(rows.sparkSession):
            parsed = stage(parse_results(rows), "parsed")
            good = parsed.where("parse_ok").drop(*FEED_COLUMNS, "parse_ok", "raw")
            fresh, newest = _not_seen(good, batch)
            if newest is not None:
                batch.drop("seen", newest - forget_us)
            traced = attach_trace(fresh, "RESULT_RECEIVED", node)
            routed = stage(route_results(traced), "routed")
            result = good.columns
            known = routed.where("route <> 'error'").select(*result)
            sent = stage(_first_requests(known, requests()), "sent")
            history = as_history(history_rows(sent, known))
            batch.append("history", history.withColumn("day", F.to_date("dispatched_at")))
            parts = latency_counts(known).withColumn("day", F.to_date("metric_time"))
            batch.append("metrics", parts)
            retry = batch.append("retry", _retry_messages(known, sent))
            letters = dead_letters(routed.select(*result), F.col("delivered_at"))
            dlq = batch.append("dlq", letters)
            batch.append("log", routed)
            raw = parsed.where("not parse_ok").select(F.col("key").alias("tx_id"), "raw")
            bad = routed.where("route = 'error'").select(*result)
            batch.append("errors", bad.unionByName(raw, allowMissingColumns=True))
            message = batch.written("retry", retry).drop(*RETRY_PLAN)
            _publish(to_feed(message, RETRY_FEED), location, servers)
            _publish(to_feed(batch.written("dlq", dlq), DLQ_FEED), location, servers)
            batch.merge("seen")

    return for_each(records, in_one_commit(path, SETTLE_TABLES, step), checkpoint, every=every)


RETRY_PLAN = ["send_channel", "next_retry_count", "due_at", "has_request"]


def _retry_messages(results: DataFrame, sent: DataFrame) -> DataFrame:
    """The request of every result that may be sent again, on its next channel and with
    its next count, the code (`retryResultCode`) and when it is due.

    A result without a request keeps its row, with `has_request` false.
    """
    plan = plan_retries(results).select(
        "tx_id",
        "send_channel",
        "next_retry_count",
        "due_at",
        F.col("result_code").alias("retryResultCode"),
    )
    meta = F.coalesce("meta", F.from_json(F.lit("{}"), schemas.META))
    joined = plan.join(sent.withColumn("has_request", F.lit(True)), "tx_id", "left")
    return joined.withColumns(
        {
            "has_request": F.coalesce("has_request", F.lit(False)),
            "channel": F.col("send_channel"),
            "meta": meta.withField("retryCount", F.col("next_retry_count")),
        }
    )


def _not_seen(good: DataFrame, batch: Batch) -> tuple[DataFrame, int | None]:
    """Results that no earlier batch had, each attempt once, and the newest time."""
    us = F.coalesce(F.unix_micros("delivered_at"), F.lit(0))
    keyed = txid.with_record(good).withColumn("_delivered_us", us)
    low, high = keyed.agg(F.min("_delivered_us"), F.max("_delivered_us")).first()
    known = [*txid.ATTEMPT, "_delivered_us"]
    schema = keyed.select(*known).schema
    once = keyed.dropDuplicates(txid.ATTEMPT)
    if low is not None:
        # a copy has its original's time, so only files of these times can hold it
        seen = batch.commits.read("seen", schema, low - 1, high).select(*txid.ATTEMPT)
        once = once.join(seen, same(once, seen, txid.ATTEMPT), "left_anti")
    fresh = stage(once, "fresh")
    batch.append("seen", fresh.select(*known))
    return fresh.select(*good.columns), high


def _first_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    """The first request of each id among `results`, in the feed's columns."""
    ids = results.where(txid.is_valid(F.col("tx_id"))).select("tx_id").distinct()
    if ID_DAY in requests.columns:
        day = id_day(F.col("tx_id"))
        low, high = ids.agg(F.min(day), F.max(day)).first()
        requests = requests.where(F.col(ID_DAY).between(F.lit(low), F.lit(high)))
    if "customer_id" not in requests.columns:
        requests = requests.withColumn("customer_id", F.lit(None).cast("string"))
    names = [f.name for f in StructType.fromDDL(schemas.REQUEST).fields if f.name != "tx_id"]
    whole = F.struct(*names, "customer_id")
    first = F.min_by(whole, F.struct("requested_at", "request_id")).alias("_first")
    near = requests.join(ids, "tx_id", "left_semi")
    return near.groupBy("tx_id").agg(first).select("tx_id", "_first.*")


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric minutes of a `settle_stream` so far, with the columns of `minute_metrics`."""
    return merged_minute_metrics(stored(spark, path, "metrics"))
