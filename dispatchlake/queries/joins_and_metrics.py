"""Registered queries: joins, metrics, reconciliation, rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.codes import CHANNELS
from dispatchlake.functions.times import HOUR, MINUTE
from dispatchlake.operators import joins, metrics, ratelimit, reconcile, routing
from dispatchlake.queries.base import ZONE, history, on_hist, on_req, on_res, us
from dispatchlake.sources.workload import folded, requests, results


def register(spark: SparkSession, sf: str) -> DataFrame:
    """Sender codes with an even share of the suppliers' keys as their owner; 007-009 are missing."""
    code = F.lpad((1 + F.col("s_suppkey") % 6).cast("string"), 3, "0")
    return (
        spark.read.parquet(f"{sf}/supplier.parquet")
        .groupBy(code.alias("sender_code"))
        .agg(F.min("s_name").alias("sender_name"))
    )


# --- joins -----------------------------------------------------------------------


def registered(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.registered_only(requests(spark, sf), register(spark, sf))
    return rows.select("event_id", "tx_id", "channel")


REGISTERED = on_req("""
select event_id, tx_id, channel from req where substr(tx_id, 19, 3) in
  (select lpad(cast(1 + s_suppkey % 6 as varchar), 3, '0') from supplier)""")


def unregistered(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.unregistered(requests(spark, sf), register(spark, sf))
    return rows.select("event_id", "tx_id", "refuse_reason")


UNREGISTERED = on_req("""
select event_id, tx_id, 'UNREGISTERED_SENDER' as refuse_reason from req where substr(tx_id, 19, 3) not in
  (select lpad(cast(1 + s_suppkey % 6 as varchar), 3, '0') from supplier)""")


def optout(spark: SparkSession, sf: str) -> DataFrame:
    """Opt-out numbers as people type them: with dashes."""
    dashed = F.concat(F.substring("receiver", 1, 3), F.lit("-"), F.expr("substring(receiver, 4)"))
    return (
        requests(spark, sf)
        .where((F.col("user_id") % 17 == 0) & (F.col("channel") != "EMAIL"))
        .select(dashed.alias("receiver"))
        .distinct()
    )


def opt_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.drop_opted_out(requests(spark, sf), optout(spark, sf))
    return rows.select("event_id", "receiver")


OPT_OUT = on_req("""
select event_id, receiver from req where receiver not in
  (select receiver from req where user_id % 17 = 0 and channel <> 'EMAIL')""")


def opted_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.opted_out(requests(spark, sf), optout(spark, sf))
    return rows.select("event_id", "receiver", "refuse_reason")


OPTED_OUT = on_req("""
select event_id, receiver, 'OPTED_OUT' as refuse_reason from req where receiver in
  (select receiver from req where user_id % 17 = 0 and channel <> 'EMAIL')""")


def permission_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer; those with user_id % 29 = 28 are missing."""
    user = F.col("user_id")
    return (
        requests(spark, sf)
        .where(user % 29 != 28)
        .select(
            "customer_id",
            (user % 11 != 0).alias("sms_agree"),
            (user % 13 != 0).alias("email_agree"),
            F.lit("22:00").alias("night_ban_end"),
        )
        .distinct()
    )


def permissions(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.apply_permissions(requests(spark, sf), permission_table(spark, sf), zone=ZONE)
    return rows.select("event_id", "allowed", "refuse_reason")


PERMISSIONS = on_req("""
select event_id, r is null as allowed, r as refuse_reason from (select event_id, case
    when channel <> 'FAX' and (user_id % 29 = 28 or (channel = 'EMAIL' and user_id % 13 = 0) or (channel <> 'EMAIL' and user_id % 11 = 0)) then 'CONSENT'
    when user_id % 29 <> 28 and (due_us // 60000000) % 1440 >= 1320 then 'NIGHT_BAN' end as r from req) z""")


def correlate(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.correlate(requests(spark, sf), results(spark, sf))
    return rows.select("tx_id", "retry_count", "request_id", "result_code", us("requested_at"))


CORRELATE = on_hist("select tx_id, retry_count, request_id, result_code, requested_us from hist")


def missing(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    rows = joins.missing_results(requests(spark, sf), results(spark, sf).where(eid % 500 != 3))
    return rows.select("event_id", "tx_id", "channel")


MISSING = on_req("""
select event_id, tx_id, channel from req
where event_id % 500 = 3 and length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09'""")


def orphan(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    rows = joins.orphan_results(requests(spark, sf).where(eid % 400 != 5), results(spark, sf))
    return rows.select("tx_id", "retry_count", "error_reason")


ORPHAN = on_res("select tx_id, retry_count, 'NO_REQUEST' as error_reason from res where event_id % 400 = 5")


def explain_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.explain_codes(results(spark, sf))
    return rows.groupBy("result_code", "code_class", "meaning", "next_step").agg(F.count("*").alias("n"))


EXPLAIN_CODES = on_res("""
select result_code, code_class, meaning, next_step, count(*) as n from res left join (values
  ('10000', 'success', 'delivered', 'history'), ('40001', 'permanent', 'bad receiver or transaction id', 'dlq'),
  ('40003', 'permanent', 'network or handset error', 'dlq'), ('40004', 'permanent', 'attachment too large', 'dlq'),
  ('40005', 'permanent', 'fax no answer', 'dlq'), ('40006', 'permanent', 'fax paper out', 'dlq'),
  ('40007', 'permanent', 'mail bounce', 'dlq'), ('40008', 'permanent', 'mail blocked as spam', 'dlq'),
  ('50001', 'retry', 'temporary carrier error', 'retry'), ('50002', 'fallback', 'rich message not supported', 'retry_as_sms'),
  ('50003', 'retry', 'fax busy', 'retry'), ('50004', 'retry', 'temporary mail server error', 'retry'))
  c(result_code, code_class, meaning, next_step) using (result_code) group by 1, 2, 3, 4""")


def fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    return joins.fallback_chain(results(spark, sf)).select(
        "tx_id", "rcs_attempt", us("rcs_delivered_at"), "sms_code", "sms_status", us("sms_dispatched_at")
    )


FALLBACK_CHAIN = on_res("""
select a.tx_id, a.retry_count as rcs_attempt, a.delivered_us as rcs_delivered_us, b.result_code as sms_code,
  b.status as sms_status, b.dispatched_us as sms_dispatched_us
from res a left join res b on a.tx_id = b.tx_id and b.retry_count = a.retry_count + 1 and b.channel = 'SMS'
where a.result_code = '50002' and a.channel = 'RCS'""")


def _late_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every 37th message leaves 90 s late."""
    shift = F.when(F.col("event_id") % 37 == 36, 90_000_000).otherwise(0)
    return results(spark, sf).withColumn(
        "dispatched_at", F.timestamp_micros(F.unix_micros("dispatched_at") + shift)
    )


def schedule_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return joins.schedule_accuracy(requests(spark, sf), _late_results(spark, sf))


SCHEDULE_ACCURACY = on_hist("""
select channel, count(*) as n, count(*) filter (where abs(late) <= 60000000) as n_on_time, max(abs(late)) as max_deviation_us,
  count(*) filter (where abs(late) <= 60000000) / count(*) as on_time_share,
  count(*) filter (where abs(late) <= 60000000) / count(*) >= 0.99 as ok
from (select channel, dispatched_us + case when event_id % 37 = 36 then 90000000 else 0 end - due_us as late
      from hist where retry_count = 0 and substr(tx_id, 14, 2) in ('01', '02')) z group by channel""")


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    batch_id = F.concat(
        F.lit("B_"),
        "channel",
        F.lit("_"),
        F.floor(F.unix_micros("requested_at") / 3_600_000_000).cast("string"),
    )
    members = requests(spark, sf).where(F.col("event_id") % 5 < 2).withColumn("batch_id", batch_id)
    schedule = members.groupBy("batch_id", "channel").agg(
        F.count("*").alias("total_requests"), F.min("scheduled_at").alias("scheduled_at")
    )
    return schedule, members


def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    schedule, members = _batches(spark, sf)
    return joins.batch_progress(schedule, members, results(spark, sf)).select(
        "batch_id", "channel", "total_requests", us("scheduled_at"), "processed", "delivered", "complete"
    )


BATCH_PROGRESS = on_res("""
select batch_id, channel, count(*) as total_requests, min(due_us) as scheduled_us,
  count(*) filter (where done) as processed, count(*) filter (where ok) as delivered, count(*) filter (where done) >= count(*) as complete
from (select event_id, channel, due_us, 'B_' || channel || '_' || (requested_us // 3600000000) as batch_id from req where event_id % 5 < 2) m
left join (select event_id, bool_or(decision in ('DONE', 'DLQ')) as done, bool_or(status = 'DELIVERED') as ok from res group by 1) s using (event_id)
group by 1, 2""")


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """One contact record per customer seen in the requests."""
    user = F.col("user_id").cast("string")
    number = F.lpad(user, 8, "0")
    phones = F.array(
        F.struct(
            F.lit("MOBILE").alias("type"),
            F.concat(F.lit("010-"), number).alias("number"),
            F.lit(True).alias("primary"),
        ),
        F.struct(
            F.lit("HOME").alias("type"),
            F.concat(F.lit("02"), number).alias("number"),
            F.lit(False).alias("primary"),
        ),
    )
    mails = F.array(
        F.struct(
            F.lit("PERSONAL").alias("type"),
            F.concat(F.lit("User"), user, F.lit("@example.com")).alias("address"),
            F.lit(True).alias("primary"),
        )
    )
    people = requests(spark, sf).select("customer_id", "user_id").distinct()
    return people.select(
        "customer_id",
        "user_id",
        F.struct(phones.alias("phoneNumbers"), mails.alias("emailAddresses")).alias("contacts"),
    )


def resolve_customer(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.resolve_customer(results(spark, sf).drop("user_id"), contacts(spark, sf))
    return rows.select("tx_id", "retry_count", "receiver", "customer_id")


RESOLVE_CUSTOMER = on_res("""
select s.tx_id, s.retry_count, s.receiver,
  case when s.receiver like '010%' or s.receiver like '02%' or s.receiver like '%@%' then r.customer_id end as customer_id
from res s join req r using (event_id)""")


def customer_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format("requested_at", "yyyyMM")
    sends = (
        requests(spark, sf)
        .groupBy("customer_id", month.alias("year_month"))
        .agg(F.count("*").alias("n_sends"))
    )
    profile = (
        contacts(spark, sf)
        .where(F.col("user_id") % 7 != 6)
        .select(
            "customer_id",
            F.lit("202401").alias("year_month"),
            F.col("contacts.phoneNumbers")[0]["number"].alias("primary_number"),
            (F.col("user_id") % 11 != 0).alias("sms_agree"),
        )
    )
    return joins.customer_snapshot(sends, profile)


CUSTOMER_SNAPSHOT = on_req("""
select customer_id, year_month, n_sends,
  case when year_month = '202401' and user_id % 7 <> 6 then '010-' || lpad(cast(user_id as varchar), 8, '0') end as primary_number,
  case when year_month = '202401' and user_id % 7 <> 6 then user_id % 11 <> 0 end as sms_agree
from (select customer_id, user_id, strftime(make_timestamp(requested_us), '%Y%m') as year_month, count(*) as n_sends from req group by 1, 2, 3) z""")


# --- metrics ---------------------------------------------------------------------


def minute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.minute_metrics(results(spark, sf)).select(
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


MINUTE_METRICS = on_res("""
select delivered_us // 60000000 * 60000000 as metric_us, channel, substr(tx_id, 14, 2) as send_method_code, count(*) as total_count,
  count(*) filter (where result_code = '10000') as success_count, count(*) filter (where result_code like '4%') as fail_count,
  count(*) filter (where result_code like '5%') as retry_count, count(*) filter (where decision = 'DLQ') as dlq_count,
  cast(round(avg(elapsed_ms)) as int) as avg_latency_ms, round(quantile_cont(elapsed_ms, 0.95), 3) as p95_ms
from res group by 1, 2, 3""")


def success_rate_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.success_rate(results(spark, sf), HOUR).select(
        "channel", us("bucket", "hour_us"), "total", "success", "rate"
    )


SUCCESS_RATE = on_res("""
select channel, delivered_us // 3600000000 * 3600000000 as hour_us, count(*) as total,
  count(*) filter (where status = 'DELIVERED') as success, count(*) filter (where status = 'DELIVERED') / count(*) as rate
from res group by 1, 2""")


def tps_peak(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).withColumn("dispatched_at", folded(F.col("dispatched_at")))
    return metrics.tps(rows)


TPS = on_res("""
select channel, max(n) as peak_tps, count(*) as busy_seconds, cast(sum(n) as bigint) as total,
  cast(sum(n) as bigint) / (max(s) - min(s) + 1) as mean_tps
from (select channel, dispatched_us % 600000000 // 1000000 as s, count(*) as n from res group by 1, 2) z group by channel""")


def pipeline_delay(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pipeline_delay(requests(spark, sf), results(spark, sf))


PIPELINE_DELAY = on_hist("""
select channel, count(*) as n, cast(sum(dispatched_us - due_us) as bigint) / 1000 / count(*) as mean_delay_ms,
  count(*) filter (where dispatched_us - due_us <= 500000) / count(*) as within_share
from hist where retry_count = 0 group by channel""")


def retry_panel(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.retry_panel(results(spark, sf))


RETRY_PANEL = on_res("""
select channel, count(*) filter (where decision = 'RETRY') as retry_count, count(*) filter (where decision = 'DLQ') as dlq_count
from res group by channel""")


def failure_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.failure_patterns(results(spark, sf))


_PATTERNS = """
, ranges as (select channel, case when channel <> 'EMAIL' then substr(receiver, 1, 7) when receiver like '%@%' then split_part(receiver, '@', 2) else '' end as prefix,
    count(*) as n, count(*) filter (where result_code like '4%') as failed from res group by 1, 2),
patterns as (select *, failed / n as fail_rate,
    cast(sum(failed) over (partition by channel) as bigint) / cast(sum(n) over (partition by channel) as bigint) as channel_rate from ranges),
flags as (select *, n >= 20 and failed > 0 and fail_rate >= 2 * channel_rate as flagged from patterns) """
FAILURE_PATTERNS = on_res(_PATTERNS + "select * from flags")


def worst_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.worst_prefixes(results(spark, sf), 2, min_messages=5).select(
        "channel", "prefix", "n", "failed", "fail_rate", "rank"
    )


WORST_PREFIXES = on_res(_PATTERNS + """
select channel, prefix, n, failed, fail_rate, rank from (select *, cast(row_number() over (partition by channel order by fail_rate desc, n desc, prefix) as int) as rank
  from flags where n >= 5) z where rank <= 2""")


def send_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.send_counters(results(spark, sf))


SEND_COUNTERS = on_res("""
select channel, status, case when channel = 'FAX' then case result_code when '10000' then 'none' when '50003' then 'busy' when '40006' then 'paper_out' when '40005' then 'no_answer' end
  when channel = 'EMAIL' then case result_code when '10000' then 'none' when '40001' then 'invalid_address' when '40007' then 'bounce' when '40008' then 'spam' when '50004' then 'smtp_error' end end as fail_reason,
  count(*) as n from res group by 1, 2, 3""")


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_histogram(results(spark, sf)).select("channel", "le", "n")


LATENCY_HISTOGRAM = on_res("""
, bounds as (
  select 'SMS' as channel, unnest([10, 30, 50, 80, 100, 150, 200, 300, 500, 1000, 999999999]) as le
  union all select 'MMS', unnest([20, 50, 80, 120, 160, 200, 300, 500, 800, 1500, 999999999])
  union all select 'RCS', unnest([10, 30, 60, 100, 150, 200, 300, 500, 1000, 999999999])
  union all select 'FAX', unnest([50, 100, 150, 200, 300, 500, 800, 1200, 2000, 999999999])
  union all select 'EMAIL', unnest([5, 10, 20, 30, 50, 80, 120, 200, 400, 999999999]))
select b.channel, case when b.le = 999999999 then '+Inf' else cast(b.le as varchar) end as le, count(s.tx_id) as n
from bounds b left join res s on s.channel = b.channel and s.elapsed_ms <= b.le group by b.channel, b.le""")


def attachment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.attachment_histogram(requests(spark, sf)).select("channel", "le", "n")


ATTACHMENT_HISTOGRAM = on_req("""
select 'MMS' as channel, case when b.le = 999999999 then '+Inf' else cast(b.le as varchar) end as le, count(r.tx_id) as n
from (select unnest([0, 1, 2, 3, 5, 10, 999999999]) as le) b left join req r on r.channel = 'MMS' and r.n_files <= b.le group by b.le""")


def success_alert(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).withColumn("delivered_at", folded(F.col("delivered_at")))
    return metrics.success_alert(rows).select(
        "channel", us("bucket", "window_us"), "total", "success", "rate"
    )


SUCCESS_ALERT = on_res("""
select * from (select channel, delivered_us % 600000000 // 60000000 * 60000000 as window_us, count(*) as total,
  count(*) filter (where status = 'DELIVERED') as success, count(*) filter (where status = 'DELIVERED') / count(*) as rate
  from res group by 1, 2) z where rate <= 0.95""")


def fallback_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fallback_count(results(spark, sf))


FALLBACK_COUNT = on_res("""
select count(*) filter (where result_code = '50002') as fallbacks, count(*) as rcs_attempts from res where channel = 'RCS'""")


def dlq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.dlq_summary(routing.dead_letters(results(spark, sf)))


DLQ_SUMMARY = on_res("""
select channel, reason as error_reason, count(*) as n from res where decision = 'DLQ' group by 1, 2""")


def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily_volume(requests(spark, sf), ZONE)


DAILY_VOLUME = on_req("""
select strftime(make_timestamp(requested_us), '%Y-%m-%d') as day, count(*) as n, count(*) / 50000000 as target_share from req group by 1""")


def campaign_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.campaign_report(history(spark, sf))


CAMPAIGN_REPORT = on_hist("""
select source, campaign_id, template_id, count(*) as n, count(*) filter (where status = 'DELIVERED') as delivered,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'RETRYING') as retrying
from hist group by 1, 2, 3""")


def channel_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """SMS is down on the 10th of the month; the hourly counts show who was hit."""
    down = (F.col("channel") == "SMS") & (F.dayofmonth("dispatched_at") == 10)
    return metrics.channel_isolation(results(spark, sf).where(~down), CHANNELS, HOUR)


CHANNEL_ISOLATION = on_res("""
, up as (select *, dispatched_us // 3600000000 as h from res where not (channel = 'SMS' and extract(day from make_timestamp(dispatched_us)) = 10)),
cells as (select c.channel, h.h, count(u.tx_id) filter (where u.channel = c.channel) as n, count(u.tx_id) filter (where u.channel <> c.channel) as others
  from (select distinct h from up) h cross join (select unnest(['SMS', 'MMS', 'RCS', 'FAX', 'EMAIL']) as channel) c join up u on u.h = h.h group by 1, 2),
sums as (select channel, count(*) filter (where n = 0) as idle_buckets, count(*) filter (where n > 0) as busy_buckets,
  cast(sum(others) filter (where n = 0) as bigint) as a, cast(sum(others) filter (where n > 0) as bigint) as b from cells group by 1)
select channel, idle_buckets, busy_buckets, a / nullif(idle_buckets, 0) as others_when_idle, b / nullif(busy_buckets, 0) as others_when_busy,
  a / nullif(idle_buckets, 0) >= 0.5 * (b / nullif(busy_buckets, 0)) as isolated from sums""")


def channel_minutes(spark: SparkSession, sf: str) -> DataFrame:
    wide = metrics.channel_minutes(results(spark, sf), CHANNELS, HOUR, "dispatched_at")
    return wide.withColumn("bucket", F.unix_micros("bucket"))


CHANNEL_MINUTES = on_res("""
select dispatched_us // 3600000000 * 3600000000 as bucket, count(*) filter (where channel = 'SMS') as sms, count(*) filter (where channel = 'MMS') as mms,
  count(*) filter (where channel = 'RCS') as rcs, count(*) filter (where channel = 'FAX') as fax, count(*) filter (where channel = 'EMAIL') as email,
  count(*) as total from res group by 1""")


def mixed_load_impact(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mixed_load_impact(requests(spark, sf), results(spark, sf), 10 * MINUTE)


MIXED_LOAD = on_hist("""
, b as (select dispatched_us // 600000000 as t, count(*) filter (where substr(tx_id, 14, 2) in ('01', '02')) as batch,
    count(*) filter (where substr(tx_id, 14, 2) = '03') as n, sum(case when substr(tx_id, 14, 2) = '03' then dispatched_us - due_us end) as delay
  from hist where retry_count = 0 group by 1),
p as (select cast(sum(n) filter (where batch > 0) as bigint) as n_mixed, cast(sum(n) filter (where batch = 0) as bigint) as n_alone,
    cast(sum(delay) filter (where batch > 0) as bigint) as dm, cast(sum(delay) filter (where batch = 0) as bigint) as da from b where n > 0),
q as (select n_mixed, n_alone, dm / 1000 / n_mixed as mixed_delay_ms, da / 1000 / n_alone as alone_delay_ms from p)
select *, mixed_delay_ms / alone_delay_ms as ratio, abs(mixed_delay_ms / alone_delay_ms - 1) <= 0.2 as ok from q""")


def sliding_success(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).withColumn("delivered_at", folded(F.col("delivered_at")))
    return metrics.sliding_success(rows).select(
        "tx_id", "retry_count", "channel", "window_total", "window_success", "window_rate"
    )


SLIDING_SUCCESS = on_res("""
, f as (select *, delivered_us % 600000000 as t from res)
select tx_id, retry_count, channel, count(*) over w as window_total, count(*) filter (where status = 'DELIVERED') over w as window_success,
  count(*) filter (where status = 'DELIVERED') over w / count(*) over w as window_rate
from f window w as (partition by channel order by t range between 60000000 preceding and current row)""")


def burst_backlog(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf).withColumn("requested_at", folded(F.col("requested_at")))
    return metrics.burst_backlog(rows, 3).select(
        "channel", us("second", "second_us"), "arrived", "backlog"
    )


BURST_BACKLOG = on_req("""
, s as (select channel, requested_us % 600000000 // 1000000 as s, count(*) as n from req group by 1, 2),
l as (select *, cast(sum(n) over w as bigint) - 3 * (s - min(s) over (partition by channel) + 1) as level from s
  window w as (partition by channel order by s rows unbounded preceding)),
m as (select *, min(level - n + 3) over (partition by channel order by s rows unbounded preceding) as lowest from l)
select channel, s * 1000000 as second_us, n as arrived, level - least(level, lowest) as backlog from m""")


def burst_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf).withColumn("requested_at", folded(F.col("requested_at")))
    return metrics.burst_check(rows, 3)


BURST_CHECK = f"""with backlog as ({BURST_BACKLOG})
select channel, cast(sum(arrived) as bigint) as total, max(arrived) as peak_arrivals, max(backlog) as peak_backlog,
  cast(ceil(arg_max(backlog, second_us) / 3) as bigint) as drain_seconds from backlog group by channel"""


# --- rate limit ------------------------------------------------------------------


def _limit(spark: SparkSession, sf: str, cap: object) -> DataFrame:
    rows = requests(spark, sf).withColumn("burst_at", folded(F.col("requested_at")))
    return ratelimit.rate_limit(rows, cap, at="burst_at", order=["burst_at", "event_id"])


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _limit(spark, sf, 3).select("event_id", "channel", us("burst_at"), us("release_at"))


def rate_limit_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.when(F.col("channel") == "SMS", 5).when(F.col("channel") == "FAX", 2).otherwise(4)
    return ratelimit.delayed(_limit(spark, sf, cap), "burst_at")


def _limit_sql(cap: str) -> str:
    return f"""
, k as (select event_id, channel, requested_us % 600000000 as burst_us, {cap} as cap,
    row_number() over (partition by channel order by requested_us % 600000000, event_id) - 1 as k from req),
limited as (select event_id, channel, burst_us, max(burst_us - k // cap * 1000000) over (partition by channel, k % cap order by k
    rows between unbounded preceding and current row) + k // cap * 1000000 as release_us from k) """


RATE_LIMIT = on_req(_limit_sql("3") + "select * from limited")
RATE_LIMIT_PER_CHANNEL = on_req(
    _limit_sql("case channel when 'SMS' then 5 when 'FAX' then 2 else 4 end")
    + """select channel, count(*) as n, count(*) filter (where release_us > burst_us) as n_delayed, max(release_us - burst_us) as max_wait_us
from limited group by channel"""
)


# --- reconciliation --------------------------------------------------------------


def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    loaded = results(spark, sf).where(F.col("event_id") % 500 != 3)
    return reconcile.reconcile(requests(spark, sf).where(F.col("event_id") % 400 != 5), loaded)


RECONCILE = on_res("""
, i as (select distinct tx_id from req where length(tx_id) = 35 and substr(tx_id, 14, 2) <> '09' and event_id % 400 <> 5),
o as (select distinct tx_id from res where event_id % 500 <> 3),
c as (select (select count(*) from i) as submitted, (select count(*) from o) as loaded,
  (select count(*) from i anti join o using (tx_id)) as missing, (select count(*) from o anti join i using (tx_id)) as orphaned)
select *, loaded / submitted as ratio, loaded >= 0.999 * submitted and loaded <= submitted as ok from c""")


def retry_success(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.retry_success(results(spark, sf))


RETRY_SUCCESS = on_res("""
, m as (select tx_id, max_by(status, retry_count) as last, max(retry_count) as n, bool_or(result_code like '5%') as retried from res group by 1),
c as (select count(*) as retried, count(*) filter (where last = 'DELIVERED') as resolved, count(*) filter (where n > 0) as reloaded from m where retried)
select *, resolved / retried as resolved_share, reloaded / retried as reloaded_share from c""")


def submitted_except_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.submitted_except_loaded(requests(spark, sf), results(spark, sf))


SUBMITTED_EXCEPT = on_res("select tx_id from req except select tx_id from res")


QUERIES = {
    "minute_metrics": (minute_metrics, MINUTE_METRICS),
    "registered": (registered, REGISTERED),
    "unregistered": (unregistered, UNREGISTERED),
    "opt_out": (opt_out, OPT_OUT),
    "opted_out": (opted_out, OPTED_OUT),
    "permissions": (permissions, PERMISSIONS),
    "correlate": (correlate, CORRELATE),
    "missing": (missing, MISSING),
    "orphan": (orphan, ORPHAN),
    "explain_codes": (explain_codes, EXPLAIN_CODES),
    "fallback_chain": (fallback_chain, FALLBACK_CHAIN),
    "schedule_accuracy": (schedule_accuracy, SCHEDULE_ACCURACY),
    "batch_progress": (batch_progress, BATCH_PROGRESS),
    "resolve_customer": (resolve_customer, RESOLVE_CUSTOMER),
    "customer_snapshot": (customer_snapshot, CUSTOMER_SNAPSHOT),
    "success_rate_hourly": (success_rate_hourly, SUCCESS_RATE),
    "tps_peak": (tps_peak, TPS),
    "pipeline_delay": (pipeline_delay, PIPELINE_DELAY),
    "retry_panel": (retry_panel, RETRY_PANEL),
    "failure_patterns": (failure_patterns, FAILURE_PATTERNS),
    "worst_prefixes": (worst_prefixes, WORST_PREFIXES),
    "send_counters": (send_counters, SEND_COUNTERS),
    "latency_histogram": (latency_histogram, LATENCY_HISTOGRAM),
    "attachment_histogram": (attachment_histogram, ATTACHMENT_HISTOGRAM),
    "success_alert": (success_alert, SUCCESS_ALERT),
    "fallback_count": (fallback_count, FALLBACK_COUNT),
    "dlq_summary": (dlq_summary, DLQ_SUMMARY),
    "daily_volume": (daily_volume, DAILY_VOLUME),
    "campaign_report": (campaign_report, CAMPAIGN_REPORT),
    "channel_isolation": (channel_isolation, CHANNEL_ISOLATION),
    "channel_minutes": (channel_minutes, CHANNEL_MINUTES),
    "mixed_load_impact": (mixed_load_impact, MIXED_LOAD),
    "sliding_success": (sliding_success, SLIDING_SUCCESS),
    "burst_backlog": (burst_backlog, BURST_BACKLOG),
    "burst_check": (burst_check, BURST_CHECK),
    "rate_limit": (rate_limit, RATE_LIMIT),
    "rate_limit_per_channel": (rate_limit_per_channel, RATE_LIMIT_PER_CHANNEL),
    "reconcile": (reconcile_counts, RECONCILE),
    "retry_success": (retry_success, RETRY_SUCCESS),
    "submitted_except_loaded": (submitted_except_loaded, SUBMITTED_EXCEPT),
}
