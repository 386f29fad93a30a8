"""Registered queries: the two whole flows, as batch plans and as stream jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispatchlake.codes import REQUEST_FEED, RESULT_FEED
from dispatchlake.functions.times import due_at
from dispatchlake.plans.dispatch import dispatch_requests, screen_requests
from dispatchlake.plans.settle import settle_results
from dispatchlake.queries.base import ZONE, on_req, on_res, us
from dispatchlake.queries.joins_and_metrics import contacts, optout, permission_table, register
from dispatchlake.session import configure_streaming, scratch_path, stage
from dispatchlake.sources import feeds
from dispatchlake.sources.workload import folded, requests, results
from dispatchlake.streaming.commits import stored
from dispatchlake.streaming.flows import ID_DAY, dispatch_stream, id_day, settle_stream, stored_metrics


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    req = requests(spark, sf).withColumn("arrive_at", folded(due_at()))
    return screen_requests(
        req, register(spark, sf), optout(spark, sf), permission_table(spark, sf), zone=ZONE
    )


def screen_flow(spark: SparkSession, sf: str) -> DataFrame:
    return _screened(spark, sf).select("event_id", "channel", "refuse_reason", "refuse_detail")


_SCREENED = """
, screened as (select *, case when length(tx_id) <> 35 then 'LENGTH' when substr(tx_id, 14, 2) = '09' then 'METHOD_CODE'
    when substr(tx_id, 19, 3) not in (select lpad(cast(1 + s_suppkey % 6 as varchar), 3, '0') from supplier) then 'UNREGISTERED_SENDER'
    when receiver in (select receiver from req where user_id % 17 = 0 and channel <> 'EMAIL') then 'OPTED_OUT'
    when channel <> 'FAX' and (user_id % 29 = 28 or (channel = 'EMAIL' and user_id % 13 = 0) or (channel <> 'EMAIL' and user_id % 11 = 0)) then 'CONSENT'
    when user_id % 29 <> 28 and (due_us // 60000000) % 1440 >= 1320 then 'NIGHT_BAN'
    when channel = 'MMS' and attachment_mb > 2 then '40004' when channel = 'EMAIL' and receiver not like '%@%' then '40001' end as refuse_reason from req) """
SCREEN_FLOW = on_req(_SCREENED + """
select event_id, channel, refuse_reason, case refuse_reason when '40004' then '첨부파일 크기 초과 (2.5MB)'
  when '40001' then '이메일 주소 형식 오류: ' || receiver end as refuse_detail from screened""")


def dispatch_flow(spark: SparkSession, sf: str) -> DataFrame:
    return dispatch_requests(_screened(spark, sf), 2, "arrive_at").select(
        "event_id", "send_channel", "topic", us("release_at")
    )


DISPATCH_FLOW = on_req(_SCREENED + """
, k as (select *, due_us % 600000000 as t, row_number() over (partition by channel order by due_us % 600000000, tx_id) - 1 as k
    from screened where refuse_reason is null)
select event_id, channel as send_channel, 'topic.send.dispatch.' || lower(channel) as topic,
  max(t - k // 2 * 1000000) over (partition by channel, k % 2 order by k rows unbounded preceding) + k // 2 * 1000000 as release_us from k""")


def settle_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Results with repeats and bad records; rows per output and channel."""
    eid = F.col("event_id")
    res = results(spark, sf).withColumns(
        {
            "tx_id": F.when(eid % 79 == 78, F.concat(F.lit("X"), eid)).otherwise(F.col("tx_id")),
            "result_code": F.when(eid % 83 == 82, "90000").otherwise(F.col("result_code")),
        }
    )
    outputs = settle_results(res.unionByName(res.where(eid % 50 == 7)))
    counts = None
    for name, df in outputs.items():
        n = F.sum("total_count") if name == "metrics" else F.count("*")
        part = df.groupBy("channel").agg(n.alias("n")).withColumn("output", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return counts


SETTLE_FLOW = on_res("""
, s as (select *, event_id % 79 = 78 as bad, case when event_id % 83 = 82 then '90000' else result_code end as c from res)
select channel, 'history' as output, count(*) as n from s where not bad and c <> '90000' group by 1
union all select channel, 'metrics', count(*) from s where not bad and c <> '90000' group by 1
union all select channel, 'retry', count(*) from s where not bad and c like '5%' and retry_count < 3 group by 1
union all select channel, 'dlq', count(*) from s where bad or c like '4%' or (c like '5%' and retry_count >= 3) group by 1
union all select channel, 'errors', count(*) from s where bad or c = '90000' group by 1""")


PARTS_US = [200_000_000, 400_000_000]


def _in_parts(records: DataFrame, us: Column, bounds: list[int], job: Callable) -> None:
    """Deliver feed records in parts of `us`; the job starts anew for each part."""
    spark = configure_streaming(records.sparkSession)
    place = scratch_path(spark, "feed")
    whole = stage(records.withColumn("_part_us", us), "feed-records")
    us = F.col("_part_us")
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = F.lit(True) if low is None else us >= low
        rows = whole.where(part if high is None else part & (us < high))
        rows.select("key", "value", "topic", "timestamp").write.mode("append").partitionBy(
            "topic"
        ).parquet(place)
        job(place).awaitTermination()


def dispatch_job(spark: SparkSession, sf: str) -> DataFrame:
    """The request feed as a stream of three parts: what is dispatched, what is refused.

    Every 59th record is cut off.
    """
    eid = F.col("event_id")
    req = requests(spark, sf)
    record = feeds.to_feed(req.drop("user_id", "customer_id"), REQUEST_FEED)
    arrival = F.get_json_object("value", "$.event_id").cast("long")
    due = req.select("event_id", F.unix_micros(folded(due_at())).alias("_us"))
    cut = F.when(eid % 59 == 58, F.substring("value", 1, 40)).otherwise(F.col("value"))
    rows = (
        record.withColumn("event_id", arrival).join(due, "event_id").withColumn("value", cut)
    )
    out, mark = scratch_path(spark, "dispatch-job"), scratch_path(spark, "checkpoint")

    def job(place: str) -> StreamingQuery:
        return dispatch_stream(
            feeds.read_feed(spark, REQUEST_FEED, place),
            register(spark, sf),
            optout(spark, sf),
            permission_table(spark, sf),
            contacts(spark, sf),
            2,
            out,
            mark,
            folded(due_at()),
            zone=ZONE,
        )

    _in_parts(rows, F.col("_us"), PARTS_US, job)
    sent = stored(spark, out, "dispatch").select(
        F.lit("dispatch").alias("output"),
        F.col("key").alias("tx_id"),
        F.get_json_object("value", "$.requestId").alias("request_id"),
        F.col("topic").alias("place"),
        F.get_json_object("value", "$.body").alias("detail"),
        us("timestamp", "release_us"),
    )
    request_id = F.get_json_object("payload", "$.request_id")
    refused = stored(spark, out, "rejects").select(
        F.lit("reject").alias("output"),
        "tx_id",
        request_id.alias("request_id"),
        F.col("reject_reason").alias("place"),
        F.col("refuse_detail").alias("detail"),
        F.lit(None).cast("long").alias("release_us"),
    )
    return sent.unionByName(refused)


DISPATCH_JOB = on_req(_SCREENED.replace(
    "when channel <> 'FAX' and (user_id",
    "when channel = 'EMAIL' and receiver not like '%@%' then 'CONSENT' when channel <> 'FAX' and (user_id",
) + """
, parsed as (select *, event_id % 59 = 58 as cut from screened)
, k as (select *, due_us % 600000000 as t, row_number() over (partition by channel order by due_us % 600000000, tx_id) - 1 as k
    from parsed where refuse_reason is null and not cut)
select 'dispatch' as output, tx_id, request_id, 'topic.send.dispatch.' || lower(channel) as place, body as detail,
  max(t - k // 2 * 1000000) over (partition by channel, k % 2 order by k rows unbounded preceding) + k // 2 * 1000000 as release_us from k
union all
select 'reject', tx_id, case when not cut then request_id end, case when cut then 'UNPARSED' else refuse_reason end,
  case when not cut and refuse_reason = '40004' then '첨부파일 크기 초과 (2.5MB)' end, null
from parsed where cut or refuse_reason is not null""")


DAYS = ["2024-01-11", "2024-01-21"]


def settle_job(spark: SparkSession, sf: str) -> DataFrame:
    """The result feed as a stream of three parts, with copies in the same and in later
    parts, bad ids, unknown codes and cut records: rows of every output."""
    eid = F.col("event_id")
    res = results(spark, sf)
    sent = scratch_path(spark, "requests")
    requests(spark, sf).withColumn(ID_DAY, id_day(F.col("tx_id"))).write.partitionBy(ID_DAY).parquet(sent)
    odd = res.withColumns(
        {
            "tx_id": F.when(eid % 79 == 78, F.concat(F.lit("X"), eid)).otherwise(F.col("tx_id")),
            "result_code": F.when(eid % 83 == 82, "90000").otherwise(F.col("result_code")),
        }
    )
    record = feeds.to_feed(odd.drop("user_id"), RESULT_FEED).withColumn(
        "event_id", F.get_json_object("value", "$.event_id").cast("long")
    )
    at = F.get_json_object("value", "$.deliveredAt").cast("timestamp")
    cut = F.when(F.col("event_id") % 61 == 60, F.substring("value", 1, 30)).otherwise(F.col("value"))
    rows = record.withColumns({"_us": F.unix_micros(at), "value": cut})
    later = rows.withColumn("_us", F.col("_us") + 8 * 24 * 3600 * 1_000_000)
    whole = rows.unionByName(rows.where("event_id % 50 = 7"))
    whole = whole.unionByName(later.where("event_id % 50 = 9 and event_id % 61 <> 60"))
    out, mark = scratch_path(spark, "settle-job"), scratch_path(spark, "checkpoint")

    def job(place: str) -> StreamingQuery:
        feed = feeds.read_feed(spark, RESULT_FEED, place)
        month_us = 31 * 24 * 3600 * 1_000_000
        return settle_stream(feed, lambda: spark.read.parquet(sent), out, mark, forget_us=month_us)

    bounds = [int(datetime.fromisoformat(f"{d}T00:00:00+00:00").timestamp()) * 1_000_000 for d in DAYS]
    _in_parts(whole, F.col("_us"), bounds, job)
    none = F.lit(None)

    def part(table: DataFrame, output: str, place: Column, code: Column, count: Column, detail: Column, at: Column):
        return table.select(
            F.lit(output).alias("output"),
            F.col("tx_id"),
            place.alias("place"),
            code.cast("string").alias("code"),
            count.cast("long").alias("n"),
            detail.cast("string").alias("detail"),
            at.cast("long").alias("at_us"),
        )

    col, micros = F.col, F.unix_micros
    minutes = stored_metrics(spark, out).withColumn("tx_id", none.cast("string"))
    figures = F.concat_ws("/", "success_count", "fail_count", "retry_count", "dlq_count", "p95_latency_ms")
    errors = stored(spark, out, "errors")
    return reduce(
        DataFrame.unionByName,
        [
            part(stored(spark, out, "history"), "history", col("channel"), col("result_code"), col("retry_count"), col("request_id"), micros("requested_at")),
            part(stored(spark, out, "retry"), "retry", col("channel"), col("retryResultCode"), col("meta.retryCount"), col("body"), micros("due_at")),
            part(stored(spark, out, "dlq"), "dlq", col("channel"), F.get_json_object("payload", "$.result_code"), F.get_json_object("payload", "$.retry_count"), col("error_reason"), micros("created_at")),
            part(stored(spark, out, "log"), "log", col("route"), col("result_code"), col("retry_count"), F.concat_ws(" ", "level", "flow_step"), micros("delivered_at")),
            part(errors, "errors", col("channel"), col("result_code"), col("retry_count"), col("raw"), micros("delivered_at")),
            part(minutes, "metrics", col("channel"), col("send_method_code"), col("total_count"), figures, micros("metric_time")),
        ],
    )


SETTLE_JOB = on_res("""
, s as (select *, case when event_id % 79 = 78 then 'X' || event_id else tx_id end as id, event_id % 79 = 78 as bad,
    case when event_id % 83 = 82 then '90000' else result_code end as c from res where event_id % 61 <> 60),
g as (select * from s where not bad and c <> '90000'),
lost as (select *, substr('{"event_id":' || event_id || ',"txId":"' || case when event_id % 79 = 78 then 'X' || event_id else tx_id end, 1, 30) as raw,
    case when event_id % 79 = 78 then 'X' || event_id else tx_id end as id,
    unnest(range(case when event_id % 50 = 7 then 2 else 1 end)) as again from res where event_id % 61 = 60)
select 'history' as output, tx_id, g.channel as place, c as code, retry_count::bigint as n, r.request_id as detail, r.requested_us as at_us
from g join req r using (tx_id)
union all
select 'retry', tx_id, case when c = '50002' then 'SMS' else g.channel end, c, retry_count + 1, r.body,
  delivered_us + 30000000 * cast(power(2, retry_count) as bigint) from g join req r using (tx_id) where c like '5%' and retry_count < 3
union all
select 'dlq', id, channel, c, retry_count, case when bad then 'INVALID_TX_ID' when c like '4%' then 'PERMANENT' else 'RETRY_EXHAUSTED' end, delivered_us
from s where bad or c like '4%' or (c like '5%' and retry_count >= 3)
union all
select 'log', id, case when bad or c = '90000' then 'error' when c = '10000' then 'success' when c like '5%' then 'retry' else 'failed' end, c, retry_count,
  case when not bad and c = '10000' then 'info' when not bad and c like '5%' then 'warn' else 'error' end || ' RESULT_RECEIVED', delivered_us from s
union all
select 'errors', id, channel, c, retry_count, null, delivered_us from s where bad or c = '90000'
union all
select 'errors', id, null, null, null, raw, null from lost
union all
select 'metrics', null, channel, substr(tx_id, 14, 2), count(*), concat_ws('/', count(*) filter (c = '10000'), count(*) filter (c like '4%'),
  count(*) filter (c like '5%'), count(*) filter (c like '4%' or (c like '5%' and retry_count >= 3)), cast(round(quantile_cont(elapsed_ms, 0.95)) as int)),
  delivered_us // 60000000 * 60000000 from g group by channel, substr(tx_id, 14, 2), delivered_us // 60000000""")


QUERIES = {
    "dispatch_job": (dispatch_job, DISPATCH_JOB),
    "settle_job": (settle_job, SETTLE_JOB),
    "screen_flow": (screen_flow, SCREEN_FLOW),
    "dispatch_flow": (dispatch_flow, DISPATCH_FLOW),
    "settle_flow": (settle_flow, SETTLE_FLOW),
}
