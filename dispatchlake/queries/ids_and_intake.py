"""Registered queries: transaction ids, intake, channel checks, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.codes import MAX_RETRIES
from dispatchlake.functions import txid
from dispatchlake.operators import channels, ids, intake, routing
from dispatchlake.operators.joins import due_at
from dispatchlake.queries.base import ZONE, on_req, on_res, us
from dispatchlake.sources.workload import requests, results


def _at(text: str) -> object:
    return F.lit(text).cast("timestamp")


# --- transaction ids -------------------------------------------------------------


def txid_build(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    rows = requests(spark, sf).withColumns(
        {
            "method": F.when(eid % 101 == 100, "09").otherwise(F.concat(F.lit("0"), 1 + eid % 5)),
            "sender_no": F.when(eid % 83 == 82, 1000 + eid).otherwise(1 + F.col("user_id") % 9),
        }
    )
    built = ids.txid_build(rows, "method", "sender_no", "requested_at", "event_id", zone=ZONE)
    return built.select("event_id", "built_tx_id", "build_error")


TXID_BUILD = on_req("""
select event_id,
  case when e is null then lpad(cast(requested_us // 1000 as varchar), 13, '0') || '0' || (1 + event_id % 5)
    || lpad(cast(dayofyear(make_timestamp(requested_us)) as varchar), 3, '0')
    || lpad(cast(1 + user_id % 9 as varchar), 3, '0') || lpad(cast(event_id as varchar), 14, '0') end as built_tx_id,
  e as build_error
from (select *, case when event_id % 101 = 100 then 'METHOD_CODE' when event_id % 83 = 82 then 'SENDER_CODE' end as e
      from req) z""")


def txid_validate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    broken = requests(spark, sf).withColumn(
        "tx_id",
        F.when(eid % 103 == 102, None)
        .when(eid % 107 == 106, "")
        .when(eid % 109 == 108, F.concat(F.lit("A"), F.substring("tx_id", 2, 34)))
        .otherwise(F.col("tx_id")),
    )
    return ids.txid_validate(broken).select(
        "event_id", "tx_valid", "reject_reason", "reject_detail"
    )


TXID_VALIDATE = on_req(r"""
select event_id, r is null as tx_valid, r as reject_reason,
  case when r = 'LENGTH' then 'len_' || length(t) end as reject_detail
from (select event_id, t, case when t is null or t = '' then 'NULL_OR_EMPTY' when length(t) <> 35 then 'LENGTH'
        when not regexp_full_match(t, '[0-9]+') then 'NON_DIGIT'
        when substr(t, 14, 2) not in ('01','02','03','04','05') then 'METHOD_CODE' end as r
  from (select event_id, case when event_id % 103 = 102 then null when event_id % 107 = 106 then ''
          when event_id % 109 = 108 then 'A' || substr(tx_id, 2, 34) else tx_id end as t from req) a) b""")


def txid_parse(spark: SparkSession, sf: str) -> DataFrame:
    return ids.txid_parse(requests(spark, sf)).select(
        "event_id", "message_id", "send_method_code", "day_of_year", "sender_code", "sequence"
    )


TXID_PARSE = on_req("""
select event_id, substr(t, 1, 13) as message_id, substr(t, 14, 2) as send_method_code,
  cast(substr(t, 16, 3) as int) as day_of_year, substr(t, 19, 3) as sender_code, cast(substr(t, 22, 14) as bigint) as sequence
from (select event_id, case when length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' then tx_id end as t from req) z""")


def txid_consistency(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    shifted = requests(spark, sf).withColumn(
        "tx_id",
        F.when(
            eid % 71 == 70, F.concat(F.substring("tx_id", 1, 15), F.lit("000"), F.substring("tx_id", 19, 17))
        ).otherwise(F.col("tx_id")),
    )
    rows = ids.txid_consistency(shifted, zone=ZONE)
    return rows.groupBy("day_in_range", "day_matches").agg(F.count("*").alias("n"))


TXID_CONSISTENCY = on_req("""
select ok and event_id % 71 <> 70 as day_in_range, ok and event_id % 71 <> 70 as day_matches, count(*) as n
from (select event_id, length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' as ok from req) z group by 1, 2""")


def txid_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    req = requests(spark, sf).select("tx_id", "event_id")
    again = req.where(F.col("event_id") % 50 == 7)
    return ids.txid_uniqueness(req.unionByName(again))


TXID_UNIQUENESS = on_req("""
select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct, count(*) filter (where n > 1) as n_duplicated,
  sum(n) = count(*) as all_unique
from (select tx_id, count(*) as n from (select tx_id from req union all select tx_id from req where event_id % 50 = 7) u
      group by tx_id) z""")


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    req = requests(spark, sf).select("tx_id", "event_id")
    return ids.duplicate_ids(req.unionByName(req.where(F.col("event_id") % 50 == 7)))


DUPLICATE_IDS = on_req("select tx_id, cast(2 as bigint) as n from req where event_id % 50 = 7")


def assign_sequence(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ids.txid_parse(requests(spark, sf)).where("sender_code is not null").drop("sequence")
    numbered = ids.assign_sequence(parsed, ["message_id", "event_id"], zone=ZONE)
    return numbered.select("event_id", "sender_code", "sequence_day", "sequence")


ASSIGN_SEQUENCE = on_req("""
select event_id, sender_code, cast(sequence_day as int) as sequence_day,
  row_number() over (partition by sender_code, sequence_day order by message_id, event_id) as sequence
from (select event_id, substr(tx_id, 19, 3) as sender_code, dayofyear(make_timestamp(requested_us)) as sequence_day,
        substr(tx_id, 1, 13) as message_id
      from req where length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09') z""")


# --- intake ----------------------------------------------------------------------


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON text; some of it is cut off."""
    eid = F.col("event_id")
    text = F.to_json(
        F.struct(
            F.col("tx_id").alias("txId"),
            "channel",
            "receiver",
            "priority",
            F.struct((eid % 4).cast("int").alias("retryCount")).alias("meta"),
        )
    )
    cut = F.when(eid % 73 == 72, F.expr("left(t, 20)")).otherwise(F.col("t"))
    return requests(spark, sf).withColumn("t", text).select("event_id", cut.alias("value"))


def request_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    return intake.parse_requests(_raw(spark, sf)).select(
        "event_id",
        "parse_ok",
        F.when(F.col("parse_ok"), F.col("tx_id")).alias("tx_id"),
        F.when(F.col("parse_ok"), F.col("channel")).alias("channel"),
        F.when(F.col("parse_ok"), F.col("receiver")).alias("receiver"),
        F.when(F.col("parse_ok"), F.col("meta.retryCount")).alias("meta_retry_count"),
        "raw",
    )


REQUEST_JSON = on_req("""
select event_id, event_id % 73 <> 72 as parse_ok,
  case when event_id % 73 <> 72 then tx_id end as tx_id, case when event_id % 73 <> 72 then channel end as channel,
  case when event_id % 73 <> 72 then receiver end as receiver,
  case when event_id % 73 <> 72 then cast(event_id % 4 as int) end as meta_retry_count,
  case when event_id % 73 = 72 then left('{"txId":"' || tx_id, 20) end as raw
from req""")


def result_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.date_format("delivered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    text = F.to_json(
        F.struct(
            F.col("tx_id").alias("txId"),
            "channel",
            "receiver",
            "status",
            F.col("result_code").alias("resultCode"),
            F.col("retry_count").alias("retryCount"),
            F.col("elapsed_ms").alias("elapsedMs"),
            F.when(F.col("event_id") % 31 == 30, "not a time").otherwise(iso).alias("deliveredAt"),
        )
    )
    raw = results(spark, sf).select("event_id", text.alias("value"))
    return intake.parse_results(raw).select(
        "event_id",
        "tx_id",
        "channel",
        "receiver",
        "status",
        "result_code",
        "retry_count",
        "elapsed_ms",
        us("delivered_at"),
        "parse_ok",
    )


RESULT_JSON = on_res("""
select event_id, tx_id, channel, receiver, status, result_code, retry_count, elapsed_ms,
  case when event_id % 31 <> 30 then delivered_us end as delivered_us, true as parse_ok from res""")


def unbundle_merge_intakes(spark: SparkSession, sf: str) -> DataFrame:
    """Batch requests travel in bundles of at most 200 (by id range), the rest singly."""
    req = requests(spark, sf)
    bundle = F.floor(F.col("event_id") / 500)
    lane = F.col("event_id") % 5
    bundles = (
        req.where(lane < 2)
        .groupBy("channel", bundle.alias("bundle"))
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "tx_id", "receiver"))).alias("items"))
    )
    batch = intake.unbundle(bundles).withColumn("intake", F.lit("batch")).drop("bundle")
    cols = ["channel", "event_id", "tx_id", "receiver"]
    online = req.where(lane == 2).select(*cols).withColumn("intake", F.lit("online"))
    near = req.where(lane > 2).select(*cols).withColumn("intake", F.lit("near_real_time"))
    return intake.merge_intakes(online, batch, near).select(*cols, "intake", "item_no")


UNBUNDLE = on_req("""
select channel, event_id, tx_id, receiver,
  case when event_id % 5 < 2 then 'batch' when event_id % 5 = 2 then 'online' else 'near_real_time' end as intake,
  case when event_id % 5 < 2 then cast(row_number() over (partition by channel, event_id // 500, event_id % 5 < 2
    order by event_id) - 1 as int) end as item_no
from req""")


def due_batch(spark: SparkSession, sf: str) -> DataFrame:
    due = intake.read_due_batch(requests(spark, sf), "2024-01-10 00:00:00")
    return due.select("event_id", "channel", us("scheduled_at"))


DUE_BATCH = on_req("""
select event_id, channel, due_us as scheduled_us from req
where event_id % 5 < 2 and due_us <= epoch_us(timestamp '2024-01-10 00:00:00')""")


def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_dispatch_feed(results(spark, sf)).withColumn(
        "topic",
        F.when(F.col("status") == "RETRYING", "topic.send.retry")
        .when(F.col("status") == "FAILED", "topic.send.dlq")
        .when(F.col("event_id") % 2 == 0, "topic.send.result")
        .otherwise(F.col("topic")),
    )
    kept = intake.retain(rows, _at("2024-01-20 00:00:00"), at="delivered_at")
    return kept.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.unix_micros("delivered_at")).alias("oldest_us"))


RETENTION = on_res("""
select topic, count(*) as n, min(delivered_us) as oldest_us
from (select *, case when status = 'RETRYING' then 'topic.send.retry' when status = 'FAILED' then 'topic.send.dlq'
        when event_id % 2 = 0 then 'topic.send.result' else 'topic.send.dispatch.' || lower(channel) end as topic from res) z
where delivered_us >= epoch_us(timestamp '2024-01-20 00:00:00') - 3600000000 *
  case when topic = 'topic.send.retry' then 72 when topic = 'topic.send.dlq' then 168 when topic = 'topic.send.result' then 48 else 6 end
group by topic""")


def replay(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf)
    feed = res.unionByName(res.where(F.col("event_id") % 50 == 7))
    lost = F.col("event_id") % 4 == 1
    again = intake.replay(feed, res.where(~lost), _at("2024-01-08"), _at("2024-01-15"))
    return again.select("event_id", "tx_id", "retry_count", "result_code", us("delivered_at"))


REPLAY = on_res("""
select event_id, tx_id, retry_count, result_code, delivered_us from res
where event_id % 4 = 1 and delivered_us >= epoch_us(timestamp '2024-01-08') and delivered_us < epoch_us(timestamp '2024-01-15')""")


def sender_codes_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Codes seen in the requests, plus the seed codes that were not there; with their use."""
    used = (
        ids.txid_parse(requests(spark, sf))
        .where("sender_code is not null")
        .groupBy("sender_code")
        .agg(F.count("*").alias("n"))
    )
    known = used.where("sender_code >= '002'").select(
        "sender_code", F.concat(F.lit("SENDER_"), "sender_code").alias("sender_name")
    )
    register = known.unionByName(
        intake.load_codes(spark, known).select("sender_code", "sender_name")
    )
    return register.join(used, "sender_code", "left")


SENDER_CODES = on_req("""
select sender_code, case when sender_code = '001' then 'CI_CAMPAIGN' else 'SENDER_' || sender_code end as sender_name, count(*) as n
from (select substr(tx_id, 19, 3) as sender_code from req where length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09') z
group by 1, 2""")


def enums_and_required(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    rows = requests(spark, sf).withColumns(
        {
            "channel": F.when(eid % 59 == 58, "KAKAO").otherwise(F.col("channel")),
            "source": F.when(eid % 61 == 60, None).otherwise(F.col("source")),
            "body": F.when(eid % 67 == 66, None).otherwise(F.col("body")),
            "receiver": F.when(eid % 53 == 52, "").otherwise(F.col("receiver")),
        }
    )
    checked = intake.required_fields(intake.check_enums(rows))
    return checked.select(
        "event_id",
        F.array_join("bad_enums", ",").alias("bad_enums"),
        F.array_join("missing_fields", ",").alias("missing_fields"),
    )


ENUMS = on_req("""
select event_id,
  concat_ws(',', case when event_id % 59 = 58 then 'channel' end, case when event_id % 61 = 60 then 'source' end) as bad_enums,
  concat_ws(',', case when event_id % 53 = 52 then 'receiver' end, case when event_id % 67 = 66 then 'body' end) as missing_fields
from req""")


# --- channel checks --------------------------------------------------------------


def sms_receiver_check(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    dashed = F.concat(F.substring("receiver", 1, 3), F.lit("-"), F.expr("substring(receiver, 4)"))
    rows = requests(spark, sf).where("channel = 'SMS'").withColumn(
        "receiver", F.when(eid % 3 == 0, dashed).otherwise(F.col("receiver"))
    )
    return channels.sms_receiver_check(rows).select("event_id", "receiver", "receiver_suspect")


SMS_RECEIVER = on_req("""
select event_id, receiver, not (replace(receiver, '-', '') like '01%' and length(replace(receiver, '-', '')) between 10 and 11) as receiver_suspect
from (select event_id, case when event_id % 3 = 0 then substr(receiver, 1, 3) || '-' || substr(receiver, 4) else receiver end as receiver
      from req where channel = 'SMS') z""")


def sms_body_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = channels.sms_body_check(requests(spark, sf))
    size = channels.euckr_length(F.col("body"))
    return rows.select("event_id", size.alias("body_bytes"), "mms_recommended")


SMS_BODY = on_req("""
select event_id, cast(length(body) + length(body) - length(replace(body, '안', '')) as int) as body_bytes,
  length(body) + length(body) - length(replace(body, '안', '')) > 80 as mms_recommended from req""")


def mms_attachment_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = channels.mms_attachment_check(requests(spark, sf).where("channel = 'MMS'"))
    return rows.select("event_id", "oversize_mb", "fail_code", "fail_detail")


MMS_ATTACHMENT = on_req("""
select event_id, case when attachment_mb > 2 then attachment_mb end as oversize_mb,
  case when attachment_mb > 2 then '40004' end as fail_code,
  case when attachment_mb > 2 then '첨부파일 크기 초과 (2.5MB)' end as fail_detail from req where channel = 'MMS'""")


def email_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf).where("channel = 'EMAIL'")
    checked = channels.email_subject_check(channels.email_address_check(rows))
    return checked.select("event_id", "fail_code", "fail_detail", "subject_missing")


EMAIL_CHECKS = on_req("""
select event_id, case when receiver not like '%@%' then '40001' end as fail_code,
  case when receiver not like '%@%' then '이메일 주소 형식 오류: ' || receiver end as fail_detail,
  subject = '' as subject_missing from req where channel = 'EMAIL'""")


def channel_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = channels.format_for_channel(requests(spark, sf))
    return rows.select(
        "event_id", "layout", "title", "text", F.size("media").alias("media_count"), "over_limit"
    )


CHANNEL_FORMAT = on_req("""
select event_id,
  case channel when 'SMS' then 'text' when 'MMS' then 'multimedia' when 'RCS' then 'card' when 'FAX' then 'document' else 'mail' end as layout,
  nullif(subject, '') as title, body as text, case when channel <> 'SMS' then n_files end as media_count,
  channel = 'SMS' and length(body) + length(body) - length(replace(body, '안', '')) > 80 as over_limit
from req""")


def channel_spec(spark: SparkSession, sf: str) -> DataFrame:
    """A sixth channel joins by its spec alone: no rule elsewhere changes."""
    push = channels.ChannelSpec(
        "PUSH",
        warnings={"long_body": F.length("body") > 40},
        failures={"40001": (F.col("receiver").startswith("02"), F.lit("no device"))},
        latency_bounds_ms=[5, 50],
        cap=100,
    )
    eid = F.col("event_id")
    rows = requests(spark, sf).withColumn(
        "channel",
        F.when((F.col("channel") == "FAX") & (eid % 2 == 0), "PUSH")
        .when(eid % 59 == 58, "KAKAO")
        .otherwise(F.col("channel")),
    )
    done = channels.apply_channels(rows, [*channels.default_specs(), push])
    return done.select(
        "event_id",
        "channel",
        "channel_known",
        F.array_join("warnings", ",").alias("warnings"),
        "fail_code",
        "fail_detail",
    )


CHANNEL_SPEC = on_req("""
select event_id, ch as channel, ch <> 'KAKAO' as channel_known,
  concat_ws(',',
    case when ch = 'SMS' and not (receiver like '01%' and length(receiver) between 10 and 11) then 'receiver_suspect' end,
    case when ch = 'SMS' and length(body) + length(body) - length(replace(body, '안', '')) > 80 then 'mms_recommended' end,
    case when ch = 'EMAIL' and subject = '' then 'subject_missing' end,
    case when ch = 'PUSH' and length(body) > 40 then 'long_body' end) as warnings,
  case when ch = 'MMS' and attachment_mb > 2 then '40004' when ch = 'EMAIL' and receiver not like '%@%' then '40001'
       when ch = 'PUSH' and receiver like '02%' then '40001' end as fail_code,
  case when ch = 'MMS' and attachment_mb > 2 then '첨부파일 크기 초과 (2.5MB)'
       when ch = 'EMAIL' and receiver not like '%@%' then '이메일 주소 형식 오류: ' || receiver
       when ch = 'PUSH' and receiver like '02%' then 'no device' end as fail_detail
from (select *, case when channel = 'FAX' and event_id % 2 = 0 then 'PUSH' when event_id % 59 = 58 then 'KAKAO' else channel end as ch from req) z""")


# --- routing ---------------------------------------------------------------------


def trace_and_route_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.route_requests(requests(spark, sf), "node-1", F.col("requested_at"))
    return rows.select(
        "event_id", "route", "reject_reason", "flow_step", "node", "feed_key", us("received_at")
    )


TRACE_ROUTE = on_req("""
select event_id, case when r is null then 'request' else 'reject' end as route, r as reject_reason,
  'REQUEST_RECEIVED' as flow_step, 'node-1' as node, tx_id as feed_key, requested_us as received_us
from (select *, case when length(tx_id) <> 35 then 'LENGTH' when substr(tx_id, 14, 2) = '09' then 'METHOD_CODE' end as r from req) z""")


def route_results(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    rows = results(spark, sf).withColumns(
        {
            "tx_id": F.when(eid % 79 == 78, "1234").otherwise(F.col("tx_id")),
            "result_code": F.when(eid % 83 == 82, "90000").otherwise(F.col("result_code")),
        }
    )
    routed = routing.route_results(routing.derive_status(rows))
    return routed.select("event_id", "retry_count", "status", "route", "level")


ROUTE_RESULTS = on_res("""
select event_id, retry_count, case when c = '10000' then 'DELIVERED' when c like '5%' then 'RETRYING' else 'FAILED' end as status,
  route, case route when 'success' then 'info' when 'retry' then 'warn' else 'error' end as level
from (select *, case when event_id % 79 = 78 then 'error' when c = '10000' then 'success' when c like '5%' then 'retry'
        when c like '4%' then 'failed' else 'error' end as route
  from (select *, case when event_id % 83 = 82 then '90000' else result_code end as c from res) a) b""")


def build_results(spark: SparkSession, sf: str) -> DataFrame:
    """Channel checks decide the outcome of each request; all else succeeds."""
    eid = F.col("event_id")
    rows = channels.apply_channels(requests(spark, sf), channels.default_specs()).withColumns(
        {
            "result_code": F.coalesce("fail_code", F.lit("10000")),
            "error_detail": F.col("fail_detail"),
            "elapsed_ms": (eid % 500).cast("int"),
            "source": F.when(eid % 19 == 18, None).otherwise(F.col("source")),
            "meta": F.when(eid % 23 != 22, F.col("meta")),
        }
    )
    built = routing.build_result(rows, F.col("requested_at"))
    return built.select(
        "tx_id",
        "channel",
        "receiver",
        "status",
        "result_code",
        "error_detail",
        "retry_count",
        "source",
        us("dispatched_at"),
        "elapsed_ms",
        "adapter_version",
    )


BUILD_RESULTS = on_req("""
select tx_id, channel, receiver, case when c = '10000' then 'DELIVERED' else 'FAILED' end as status, c as result_code,
  case when not ok then 'txId 형식 오류 (35자리 숫자 아님)' when c = '40004' then '첨부파일 크기 초과 (2.5MB)'
       when c = '40001' then '이메일 주소 형식 오류: ' || receiver end as error_detail,
  0 as retry_count, case when event_id % 19 = 18 then '' else source end as source, requested_us as dispatched_us,
  case when ok then cast(event_id % 500 as int) else 0 end as elapsed_ms, '1.0.0' as adapter_version
from (select *, case when not ok then '40001' when channel = 'MMS' and attachment_mb > 2 then '40004'
        when channel = 'EMAIL' and receiver not like '%@%' then '40001' else '10000' end as c
  from (select *, length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' as ok from req) a) b""")


def retry_messages(spark: SparkSession, sf: str) -> DataFrame:
    outcome = results(spark, sf).where("retry_count = 0").select("tx_id", "result_code")
    rows = routing.build_retry(requests(spark, sf).join(outcome, "tx_id"))
    return rows.select("event_id", "tx_id", "channel", "body", "retry_result_code")


RETRY_MESSAGES = on_res("""
select r.event_id, r.tx_id, r.channel, r.body, s.result_code as retry_result_code
from req r join res s on r.event_id = s.event_id and s.retry_count = 0 where s.result_code like '5%'""")


def retry_messages_all(spark: SparkSession, sf: str) -> DataFrame:
    """The retry messages of every attempt that may be sent again, not of the first alone."""
    outcome = results(spark, sf).where(F.col("retry_count") < MAX_RETRIES)
    outcome = outcome.select("tx_id", "retry_count", "result_code")
    rows = routing.build_retry(requests(spark, sf).join(outcome, "tx_id"))
    return rows.select("event_id", "tx_id", "channel", "body", "retry_count", "retry_result_code")


RETRY_MESSAGES_ALL = on_res("""
select r.event_id, r.tx_id, r.channel, r.body, s.retry_count, s.result_code as retry_result_code
from req r join res s on r.event_id = s.event_id where s.decision = 'RETRY'""")


def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    return routing.plan_retries(results(spark, sf)).select(
        "tx_id", "channel", "send_channel", "reason", "next_retry_count", us("due_at")
    )


RETRY_PLAN = on_res("""
select tx_id, channel, case when result_code = '50002' then 'SMS' else channel end as send_channel, reason,
  retry_count + 1 as next_retry_count, delivered_us + 30000000 * cast(power(2, retry_count) as bigint) as due_us
from res where decision = 'RETRY'""")


def classify_failure(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.classify_failure(results(spark, sf))
    return rows.groupBy("channel", "decision", "reason").agg(F.count("*").alias("n"))


CLASSIFY = on_res("select channel, decision, reason, count(*) as n from res group by 1, 2, 3")


def select_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Policy: multimedia for plain messages with a long body; then fallback."""
    body = requests(spark, sf).select("tx_id", "body")
    rules = [((F.col("channel") == "SMS") & (F.length("body") > 40), "MMS")]
    rows = routing.select_channel(results(spark, sf).join(body, "tx_id"), rules)
    return rows.select("tx_id", "retry_count", "channel", "send_channel")


SELECT_CHANNEL = on_res("""
select s.tx_id, s.retry_count, s.channel,
  case when s.channel = 'SMS' and length(body) > 40 then 'MMS' when result_code = '50002' then 'SMS' else s.channel end as send_channel
from res s join req r using (event_id)""")


def method_lane(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.method_lane(requests(spark, sf))
    return rows.groupBy("channel", "lane").agg(F.count("*").alias("n"))


METHOD_LANE = on_req("""
select channel, case when substr(tx_id, 14, 2) in ('01', '02') then 'batch' when substr(tx_id, 14, 2) = '03' then 'online'
  when substr(tx_id, 14, 2) in ('04', '05') then 'near_real_time' end as lane, count(*) as n from req group by 1, 2""")


LIVE = {"SMS": 4, "MMS": 2, "RCS": 1, "EMAIL": 3, "FAX": 0}


def assign_lane(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.assign_lane(requests(spark, sf), LIVE)
    return rows.select("event_id", "channel", "send_lane")


ASSIGN_LANE = on_req("""
select event_id, channel, case channel when 'SMS' then k % 4 when 'MMS' then k % 2 when 'RCS' then k % 1 when 'EMAIL' then k % 3 end as send_lane
from (select *, row_number() over (partition by channel order by priority, requested_us, tx_id) - 1 as k from req) z""")


def due_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = intake.due_requests(requests(spark, sf), _at("2024-01-16 12:00:00"))
    return rows.groupBy("channel", txid.method_code(F.col("tx_id")).alias("method")).agg(
        F.count("*").alias("n"), F.max(F.unix_micros(due_at())).alias("last_due_us")
    )


DUE_REQUESTS = on_req("""
select channel, substr(tx_id, 14, 2) as method, count(*) as n, max(due_us) as last_due_us from req
where length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' and due_us <= epoch_us(timestamp '2024-01-16 12:00:00') group by 1, 2""")


QUERIES = {
    "txid_build": (txid_build, TXID_BUILD),
    "txid_validate_reasons": (txid_validate_reasons, TXID_VALIDATE),
    "txid_parse": (txid_parse, TXID_PARSE),
    "txid_consistency": (txid_consistency, TXID_CONSISTENCY),
    "txid_uniqueness": (txid_uniqueness, TXID_UNIQUENESS),
    "duplicate_ids": (duplicate_ids, DUPLICATE_IDS),
    "assign_sequence": (assign_sequence, ASSIGN_SEQUENCE),
    "request_json_parse": (request_json_parse, REQUEST_JSON),
    "result_json_parse": (result_json_parse, RESULT_JSON),
    "unbundle_merge_intakes": (unbundle_merge_intakes, UNBUNDLE),
    "due_batch": (due_batch, DUE_BATCH),
    "due_requests": (due_requests, DUE_REQUESTS),
    "retention_filter": (retention_filter, RETENTION),
    "replay": (replay, REPLAY),
    "sender_codes_loaded": (sender_codes_loaded, SENDER_CODES),
    "enums_and_required": (enums_and_required, ENUMS),
    "sms_receiver_check": (sms_receiver_check, SMS_RECEIVER),
    "sms_body_bytes": (sms_body_bytes, SMS_BODY),
    "mms_attachment_check": (mms_attachment_check, MMS_ATTACHMENT),
    "email_checks": (email_checks, EMAIL_CHECKS),
    "channel_format": (channel_format, CHANNEL_FORMAT),
    "channel_spec": (channel_spec, CHANNEL_SPEC),
    "trace_and_route_requests": (trace_and_route_requests, TRACE_ROUTE),
    "route_results": (route_results, ROUTE_RESULTS),
    "build_results": (build_results, BUILD_RESULTS),
    "retry_messages": (retry_messages, RETRY_MESSAGES),
    "retry_messages_all": (retry_messages_all, RETRY_MESSAGES_ALL),
    "retry_plan": (retry_plan, RETRY_PLAN),
    "classify_failure": (classify_failure, CLASSIFY),
    "select_channel": (select_channel, SELECT_CHANNEL),
    "method_lane": (method_lane, METHOD_LANE),
    "assign_lane": (assign_lane, ASSIGN_LANE),
}
