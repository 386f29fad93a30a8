"""Registered queries: stream jobs and table round trips.

Stream queries write the derived workload to the shared folder, run the job on
it until all is processed, and return the table it wrote. A marker row one day
after the last event moves the watermark past all windows. The hold jobs get
their feed week by week, start anew for each, and return when each row left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators import documents, history as hist_ops, intake, metrics, routing
from dispatchlake.queries.history_and_docs import LATEST_STATUS
from dispatchlake.queries.joins_and_metrics import MINUTE_METRICS, RATE_LIMIT
from dispatchlake.queries.base import ZONE, history, on_hist, on_req, on_res, us
from dispatchlake.session import configure_streaming, scratch_path
from dispatchlake.sources import feeds, sinks
from dispatchlake.sources.workload import folded, requests, results
from dispatchlake.streaming import correlate, hold, jobs, runs

MARK = "9" * 13 + "03" + "366" + "999" + "9" * 14


def _marked(df: DataFrame, time: str, **values: object) -> DataFrame:
    """Add the marker row: a copy of the latest row, a day later, under its own id."""
    last = df.agg(F.max_by(F.struct(*df.columns), F.unix_micros(time)).alias("r")).select("r.*")
    changed = {time: F.col(time) + F.expr("interval 1 day"), "tx_id": F.lit(MARK)}
    changed |= {k: F.lit(v).cast(df.schema[k].dataType) for k, v in values.items()}
    return df.unionByName(last.withColumns(changed))


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    spark = configure_streaming(df.sparkSession)
    path = scratch_path(spark, f"feed-{name}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@contextmanager
def _one_store_per_core(spark: SparkSession) -> Iterator[None]:
    """Stateful streams have no adaptive merging of small partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _finished(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    out = scratch_path(spark, f"out-{name}")
    with _one_store_per_core(spark):
        runs.to_table(stream, out, scratch_path(spark, f"checkpoint-{name}")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _correlated(req: DataFrame, res: DataFrame, horizon: str = "1 hour") -> DataFrame:
    spark = req.sparkSession
    out, mark = scratch_path(spark, "out-correlate"), scratch_path(spark, "checkpoint-correlate")
    correlate.correlate_stream(req, res, out, mark, horizon).awaitTermination()
    return correlate.correlated(spark, out)


def _doubled(res: DataFrame) -> DataFrame:
    """Every 50th message arrives twice, as an at-least-once feed would have it."""
    return res.unionByName(res.where(F.col("event_id") % 50 == 7))


# --- streams ---------------------------------------------------------------------


def stream_minute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    source = _as_stream(_marked(results(spark, sf), "delivered_at"), "metrics")
    return _finished(jobs.stream_minute_metrics(source), "metrics").select(
        us("metric_time", "metric_us"),
        "channel",
        "send_method_code",
        "total_count",
        "success_count",
        "fail_count",
        "retry_count",
        "dlq_count",
        "avg_latency_ms",
        F.col("p95_exact").alias("p95_ms"),
    )


def stream_success_alert(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf).withColumn("delivered_at", folded(F.col("delivered_at")))
    source = _as_stream(res, "alert")
    out = scratch_path(spark, "out-alert")
    with _one_store_per_core(spark):
        runs.updates_to_table(
            jobs.stream_success_alert(source), out, scratch_path(spark, "checkpoint-alert")
        ).awaitTermination()
    return (
        jobs.current_windows(spark.read.parquet(out))
        .where("alert")
        .select(us("window_start", "window_us"), "channel", "total", "success", "rate")
    )


STREAM_ALERT = on_res("""
select * from (select w * 10000000 as window_us, channel, count(*) as total, count(*) filter (where status = 'DELIVERED') as success,
    count(*) filter (where status = 'DELIVERED') / count(*) as rate
  from (select *, delivered_us % 600000000 // 10000000 - unnest([0, 1, 2, 3, 4, 5]) as w from res) a group by 1, 2) b where rate <= 0.95""")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    source = _as_stream(_doubled(results(spark, sf)), "dedup")
    return _finished(jobs.stream_dedup(source), "dedup").select(
        "tx_id", "retry_count", "channel", "status", "result_code", us("delivered_at")
    )


STREAM_DEDUP = on_res("select tx_id, retry_count, channel, status, result_code, delivered_us from res")


def stream_correlate(spark: SparkSession, sf: str) -> DataFrame:
    """First attempts within two hours; every 500th result never arrives."""
    first = results(spark, sf).where("retry_count = 0 and event_id % 500 <> 3")
    req = _as_stream(_marked(requests(spark, sf), "requested_at"), "requests")
    res = _as_stream(_marked(first, "delivered_at"), "results")
    return (
        _correlated(req, res, "2 hours")
        .where(F.col("tx_id") != MARK)
        .select("tx_id", "request_id", us("requested_at"), "result_code", us("delivered_at"), "missing")
    )


STREAM_CORRELATE = on_res("""
select r.tx_id, r.request_id, r.requested_us, s.result_code, s.delivered_us, s.tx_id is null as missing
from req r left join (select * from res where retry_count = 0 and event_id % 500 <> 3) s using (event_id)""")


def stream_correlate_all(spark: SparkSession, sf: str) -> DataFrame:
    """All attempts within the default horizon, counted from the due time.

    Every 7th scheduled message is due two days later and answered then, every 500th
    message is never answered, and the answers of every 300th are two hours late.
    """
    eid = F.col("event_id")
    later = F.when((eid % 7 == 0) & (eid % 5 < 2), F.expr("interval 2 days")).otherwise(
        F.expr("interval 0 days")
    )
    slow = F.when(eid % 300 == 4, F.expr("interval 2 hours")).otherwise(F.expr("interval 0 hours"))
    asked = requests(spark, sf).withColumn("scheduled_at", F.col("scheduled_at") + later)
    answers = results(spark, sf).where("event_id % 500 <> 3")
    answers = answers.withColumn("delivered_at", F.col("delivered_at") + later + slow)
    req = _as_stream(_outlived(asked, "requested_at"), "all-requests")
    res = _as_stream(_outlived(answers, "delivered_at"), "all-results")
    return (
        _correlated(req, res)
        .where(F.col("tx_id") != MARK)
        .select(
            "tx_id",
            "request_id",
            us("requested_at"),
            "retry_count",
            "result_code",
            us("delivered_at"),
            "missing",
            "late",
        )
    )


def _outlived(df: DataFrame, time: str) -> DataFrame:
    """With the marker row a week later, after the longest schedule."""
    marked = _marked(df, time)
    week = F.when(F.col("tx_id") == MARK, F.expr("interval 7 days")).otherwise(F.expr("interval 0 days"))
    return marked.withColumn(time, F.col(time) + week)


STREAM_CORRELATE_ALL = on_res("""
, asked as (select *, case when event_id % 7 = 0 and event_id % 5 < 2 then 172800000000 else 0 end as later from req),
answers as (select s.*, s.delivered_us + a.later + case when event_id % 300 = 4 then 7200000000 else 0 end as back_us
  from res s join asked a using (event_id) where event_id % 500 <> 3),
paired as (select a.tx_id as request_tx, a.request_id, a.requested_us, s.tx_id as result_tx, s.retry_count, s.result_code, s.back_us
  from asked a full join answers s on a.tx_id = s.tx_id and s.back_us between a.requested_us and a.due_us + a.later + 3600000000)
select coalesce(request_tx, result_tx) as tx_id, request_id, requested_us, retry_count, result_code, back_us as delivered_us,
  result_tx is null as missing, request_tx is null as late from paired""")


WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


def _held_by_week(
    df: DataFrame, name: str, at: str, due: str, job: Callable, columns: Callable = lambda d: d
) -> DataFrame:
    """Run a hold job over weekly deliveries of `df`; `released_at` is null while a row waits."""
    spark = configure_streaming(df.sparkSession)
    feed, out, mark = (scratch_path(spark, f"{k}-{name}") for k in ("feed", "out", "checkpoint"))
    # derived and written once; each run finds the folders of one more week
    begun = [(F.col(at) >= F.lit(since).cast("timestamp")).cast("int") for since in WEEKS]
    week = F.coalesce(sum(begun[1:], begun[0]), F.lit(0))
    df.withColumn("_week", week).write.partitionBy("_week").parquet(feed)
    for last in range(len(WEEKS) + 1):
        arrived = f"{feed}/_week=[0-{last}]"
        job(spark.readStream.schema(df.schema).parquet(arrived), out, mark, at).awaitTermination()
    gone = hold.released(spark, out).drop("batch_id")
    waiting = hold.held(spark, out, columns(df).schema, due)
    return gone.unionByName(waiting.withColumn("released_at", F.lit(None).cast("timestamp")))


def _released_sql(rows: str, at: str, due: str) -> str:
    """The latest time of the first week that reaches the due time."""
    week = "+".join(f"cast({at} >= epoch_us(timestamp '{w}') as int)" for w in WEEKS)
    clocks = f"select max({at}) as clock from {rows} group by {week}"
    return f"select h.*, (select min(clock) from ({clocks}) c where clock >= coalesce({due}, {at})) as released_us from {rows} h"


def stream_retry(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf)
    return _held_by_week(
        res, "retry", "delivered_at", "due_at", runs.retry_stream, jobs.retry_steps
    ).select(
        "tx_id",
        "channel",
        "send_channel",
        "decision",
        "reason",
        "next_retry_count",
        us("due_at"),
        us("released_at"),
    )


STREAM_RETRY = on_res(f""", planned as (select *, case when decision = 'RETRY' then delivered_us + 30000000 * cast(power(2, retry_count) as bigint) end as due
  from res where decision <> 'DONE')
select tx_id, channel, case when decision = 'RETRY' then case when result_code = '50002' then 'SMS' else channel end end as send_channel,
  decision, reason, case when decision = 'RETRY' then retry_count + 1 end as next_retry_count, due as due_us, released_us
from ({_released_sql("planned", "delivered_us", "due")}) p""")


def stream_hold_until_due(spark: SparkSession, sf: str) -> DataFrame:
    req = requests(spark, sf)
    return _held_by_week(
        req, "hold", "requested_at", "scheduled_at", runs.hold_stream
    ).select(
        "event_id",
        "tx_id",
        "channel",
        "body",
        F.size("attachments").alias("n_files"),
        "meta.campaignId",
        us("scheduled_at"),
        us("requested_at"),
        us("released_at"),
    )


STREAM_HOLD = on_req(f""", planned as (select *, case when event_id % 5 < 2 then due_us end as scheduled_us from req)
select event_id, tx_id, channel, body, n_files, campaign_id as "campaignId", scheduled_us, requested_us, released_us
from ({_released_sql("planned", "requested_us", "scheduled_us")}) p""")


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf).select(
        "event_id", "channel", folded(F.col("requested_at")).alias("burst_at")
    )
    source = _as_stream(rows, "limit")
    out = scratch_path(spark, "out-limit")
    runs.rate_limit_stream(
        source, 3, out, scratch_path(spark, "checkpoint-limit"), "burst_at", "event_id"
    ).awaitTermination()
    return runs.limited_rows(spark, out).select(
        "event_id", "channel", us("burst_at"), us("release_at")
    )


def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    stages = hist_ops.stage_events(requests(spark, sf), _doubled(results(spark, sf)))
    source = _as_stream(stages, "stages")
    out = scratch_path(spark, "out-stages")
    runs.history_stream(source, out, scratch_path(spark, "checkpoint-stages")).awaitTermination()
    return runs.current_history(spark, out).select(
        "tx_id",
        "retry_count",
        "status",
        "result_code",
        us("requested_at"),
        us("dispatched_at"),
        us("delivered_at"),
    )


def stream_route(spark: SparkSession, sf: str) -> DataFrame:
    """Results and requests routed to their tables, counted per route."""
    res = results(spark, sf).withColumn(
        "tx_id", F.when(F.col("event_id") % 79 == 78, "1234").otherwise(F.col("tx_id"))
    )
    parts = []
    for kind, df in {"request": requests(spark, sf), "result": res}.items():
        out = scratch_path(spark, f"out-{kind}")
        runs.route_stream(
            _as_stream(df, kind), kind, out, scratch_path(spark, f"checkpoint-{kind}")
        ).awaitTermination()
        routed = spark.read.parquet(out).groupBy("route", "channel").agg(F.count("*").alias("n"))
        parts.append(routed.withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


STREAM_ROUTE = on_res("""
select 'request' as kind, case when length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' then 'request' else 'reject' end as route, channel, count(*) as n
from req group by 1, 2, 3
union all
select 'result', case when event_id % 79 = 78 then 'error' when status = 'DELIVERED' then 'success' when status = 'RETRYING' then 'retry' else 'failed' end,
  channel, count(*) from res group by 1, 2, 3""")


# --- round trips -----------------------------------------------------------------


def sink_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to the request feed and back through the parser."""
    place = scratch_path(spark, "feeds")
    req = requests(spark, sf).drop("event_id", "user_id", "customer_id")
    feeds.write_feed(feeds.to_feed(req, "topic.send.request", F.col("requested_at")), place)
    back = feeds.read_feed(spark, "topic.send.request", place, streaming=False)
    parsed = intake.parse_requests(back)
    return parsed.select(
        "key",
        "topic",
        "tx_id",
        "channel",
        "receiver",
        "body",
        F.size("attachments").alias("n_files"),
        F.col("meta.campaignId").alias("campaign_id"),
        F.expr("unix_millis(requested_at)").alias("requested_ms"),
        F.expr("unix_millis(scheduled_at)").alias("scheduled_ms"),
        "parse_ok",
    )


SINK_FEED = on_req("""
select tx_id as key, 'topic.send.request' as topic, tx_id, channel, receiver, body, n_files, campaign_id, requested_us // 1000 as requested_ms,
  case when event_id % 5 < 2 then due_us // 1000 end as scheduled_ms, true as parse_ok from req""")


def feed_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Results read as a stream from a moment on, instead of from the start."""
    place = scratch_path(spark, "feeds")
    res = results(spark, sf)
    feeds.write_feed(feeds.to_feed(res, "topic.send.result", F.col("delivered_at")), place)
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    configure_streaming(spark)
    late = feeds.read_feed(
        spark, "topic.send.result", place, start="latest", since=since, max_per_batch=500
    )
    return _finished(intake.parse_results(late), "latest").select(
        "tx_id", "retry_count", "result_code", F.expr("unix_millis(delivered_at)").alias("delivered_ms")
    )


FEED_LATEST = on_res("""
select tx_id, retry_count, result_code, delivered_us // 1000 as delivered_ms from res
where delivered_us >= epoch_us(timestamp '2024-01-20 00:00:00')""")


def sink_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "dispatch")
    sinks.fan_out(requests(spark, sf), place)
    rows = spark.read.parquet(place)
    return rows.select("key", "topic", F.get_json_object("value", "$.layout").alias("layout"))


SINK_FAN_OUT = on_req("""
select tx_id as key, 'topic.send.dispatch.' || lower(channel) as topic,
  case channel when 'SMS' then 'text' when 'MMS' then 'multimedia' when 'RCS' then 'card' when 'FAX' then 'document' else 'mail' end as layout
from req""")


def http_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies landed as files; each tenth of them is cut off."""
    place = scratch_path(spark, "bodies")
    body = F.to_json(F.struct(F.col("tx_id").alias("txId"), "channel", "source", "sender", "receiver"))
    text = F.when(F.col("event_id") % 10 == 9, F.substring(body, 1, 30)).otherwise(body)
    requests(spark, sf).select(text.alias("value")).write.text(place)
    configure_streaming(spark)
    parsed = intake.parse_requests(feeds.ingest_http_dump(spark, place))
    routed = routing.route_requests(parsed.where("parse_ok")).select("tx_id", "channel", "route")
    bad = parsed.where("not parse_ok").select(
        F.lit(None).cast("string").alias("tx_id"), F.lit(None).cast("string").alias("channel"), F.lit("unparsed").alias("route")
    )
    return _finished(routed.unionByName(bad), "bodies")


HTTP_DUMP = on_req("""
select case when event_id % 10 <> 9 then tx_id end as tx_id, case when event_id % 10 <> 9 then channel end as channel,
  case when event_id % 10 = 9 then 'unparsed' when length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' then 'request' else 'reject' end as route
from req""")


def sink_history(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "history")
    sinks.append_history(history(spark, sf), place)
    return spark.read.parquet(place).select(
        "tx_id",
        "request_id",
        "channel",
        "status",
        "retry_count",
        us("requested_at"),
        us("dispatched_at"),
        F.col("day").cast("string").alias("day"),
    )


SINK_HISTORY = on_hist("""
select tx_id, request_id, channel, status, retry_count::smallint as retry_count, requested_us, dispatched_us,
  strftime(make_timestamp(dispatched_us), '%Y-%m-%d') as day from hist""")


def sink_customer_month(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "documents")
    sinks.write_customer_month(documents.customer_month_docs(history(spark, sf), ZONE), place)
    docs = spark.read.parquet(place).withColumn("year_month", F.col("year_month").cast("string"))
    return docs.select(
        "doc_id", "customer_id", "year_month", "total_count", F.size("sends").alias("n_sends")
    )


SINK_CUSTOMER_MONTH = on_hist("""
select customer_id || '_' || ym as doc_id, customer_id, ym as year_month, count(*) as total_count, cast(count(*) as int) as n_sends
from (select *, strftime(make_timestamp(requested_us), '%Y%m') as ym from hist) z group by customer_id, ym""")


def sink_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes stored twice: the second run replaces its days."""
    place = scratch_path(spark, "metrics")
    rows = metrics.minute_metrics(results(spark, sf))
    sinks.write_metrics(rows, place)
    sinks.write_metrics(rows.where(F.dayofmonth("metric_time") <= 10), place)
    return (
        spark.read.parquet(place)
        .groupBy(F.col("day").cast("string").alias("day"), "channel")
        .agg(F.sum("total_count").alias("total"), F.count("*").alias("n_rows"))
    )


SINK_METRICS = on_res("""
select strftime(make_timestamp(m * 60000000), '%Y-%m-%d') as day, channel, cast(sum(n) as bigint) as total, count(*) as n_rows
from (select delivered_us // 60000000 as m, channel, substr(tx_id, 14, 2) as c, count(*) as n from res group by 1, 2, 3) z group by 1, 2""")


def sink_dlq(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "dlq")
    sinks.write_dlq(results(spark, sf), place)
    return spark.read.parquet(place).select(
        "tx_id",
        "channel",
        "error_reason",
        F.get_json_object("payload", "$.result_code").alias("result_code"),
        F.get_json_object("payload", "$.receiver").alias("receiver"),
    )


SINK_DLQ = on_res("""
select tx_id, channel, reason as error_reason, result_code, receiver from res where decision = 'DLQ'""")


def sink_rejects(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "rejects")
    sinks.write_rejects(routing.route_requests(requests(spark, sf)), place)
    return spark.read.parquet(place).select(
        "tx_id",
        "reject_reason",
        F.get_json_object("payload", "$.request_id").alias("request_id"),
        F.get_json_object("payload", "$.reject_detail").alias("reject_detail"),
    )


SINK_REJECTS = on_req("""
select tx_id, case when length(tx_id) <> 35 then 'LENGTH' else 'METHOD_CODE' end as reject_reason, request_id,
  case when length(tx_id) <> 35 then 'len_' || length(tx_id) end as reject_detail
from req where length(tx_id) <> 35 or substr(tx_id, 14, 2) = '09'""")


def sink_result_log(spark: SparkSession, sf: str) -> DataFrame:
    place = scratch_path(spark, "log")
    sinks.write_result_log(results(spark, sf), place)
    rows = spark.read.parquet(place)
    return rows.groupBy("level", "route", "result_code").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms"))


SINK_RESULT_LOG = on_res("""
select case when status = 'DELIVERED' then 'info' when status = 'RETRYING' then 'warn' else 'error' end as level,
  case when status = 'DELIVERED' then 'success' when status = 'RETRYING' then 'retry' else 'failed' end as route,
  result_code, count(*) as n, cast(sum(elapsed_ms) as bigint) as elapsed_ms from res group by 1, 2, 3""")


QUERIES = {
    "stream_minute_metrics": (stream_minute_metrics, MINUTE_METRICS),
    "stream_success_alert": (stream_success_alert, STREAM_ALERT),
    "stream_dedup": (stream_dedup, STREAM_DEDUP),
    "stream_correlate": (stream_correlate, STREAM_CORRELATE),
    "stream_correlate_all": (stream_correlate_all, STREAM_CORRELATE_ALL),
    "stream_retry": (stream_retry, STREAM_RETRY),
    "stream_hold_until_due": (stream_hold_until_due, STREAM_HOLD),
    "stream_rate_limit": (stream_rate_limit, RATE_LIMIT),
    "stream_history": (stream_history, LATEST_STATUS),
    "stream_route": (stream_route, STREAM_ROUTE),
    "sink_feed": (sink_feed, SINK_FEED),
    "feed_latest": (feed_latest, FEED_LATEST),
    "sink_fan_out": (sink_fan_out, SINK_FAN_OUT),
    "http_dump": (http_dump, HTTP_DUMP),
    "sink_history": (sink_history, SINK_HISTORY),
    "sink_customer_month": (sink_customer_month, SINK_CUSTOMER_MONTH),
    "sink_metrics": (sink_metrics, SINK_METRICS),
    "sink_dlq": (sink_dlq, SINK_DLQ),
    "sink_rejects": (sink_rejects, SINK_REJECTS),
    "sink_result_log": (sink_result_log, SINK_RESULT_LOG),
}
