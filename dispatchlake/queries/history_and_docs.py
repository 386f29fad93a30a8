"""Registered queries: history, look-ups, customer-month documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators import documents, history as hist_ops, metrics, reconcile
from dispatchlake.queries.base import ZONE, history, message_store, on_hist, on_res, us
from dispatchlake.session import stage
from dispatchlake.sources import lookups
from dispatchlake.sources.workload import requests, results


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Message states, with a third of all steps delivered twice."""
    steps = hist_ops.stage_events(requests(spark, sf), results(spark, sf))
    twice = steps.unionAll(steps.where(F.pmod(F.unix_micros("at"), F.lit(3)) == 0))
    return hist_ops.latest_status(twice).select(
        "tx_id",
        "retry_count",
        "status",
        "result_code",
        us("requested_at"),
        us("dispatched_at"),
        us("delivered_at"),
    )


LATEST_STATUS = on_res("""
select r.tx_id, coalesce(l.retry_count, 0) as retry_count, coalesce(l.status, 'PENDING') as status, l.result_code,
  r.requested_us, l.dispatched_us, l.delivered_us
from req r left join (select * from res qualify row_number() over (partition by tx_id order by retry_count desc) = 1) l using (tx_id)""")


def attempt_chain(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf)
    twice = res.unionByName(res.where(F.col("event_id") % 50 == 7))
    return hist_ops.attempt_chain(twice).select(
        "tx_id", "retry_count", "result_code", "previous_code", "next_code", "gap_us"
    )


ATTEMPT_CHAIN = on_res("""
select tx_id, retry_count, result_code, lag(result_code) over w as previous_code, lead(result_code) over w as next_code,
  dispatched_us - lag(delivered_us) over w as gap_us from res window w as (partition by tx_id order by retry_count)""")


def _one_tx(spark: SparkSession, sf: str) -> str:
    """The id a caller would ask for: message 88, which always fails and is retried."""
    return requests(spark, sf).where("event_id = 88").first().tx_id


def history_by_tx(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookups.by_tx(spark, message_store(spark, sf, "by_tx"), _one_tx(spark, sf))
    return rows.select(
        "tx_id", "retry_count", "channel", "status", "result_code", us("dispatched_at"), us("delivered_at")
    )


HISTORY_BY_TX = on_hist("""
select tx_id, retry_count::smallint as retry_count, channel, status, result_code, dispatched_us, delivered_us from hist where event_id = 88""")


def history_by_receiver(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.by_receiver(spark, message_store(spark, sf, "by_receiver"), "01000000042", 20).select(
        "tx_id", "retry_count", "channel", "status", us("requested_at")
    )


HISTORY_BY_RECEIVER = on_hist("""
select tx_id, retry_count::smallint as retry_count, channel, status, requested_us from hist where receiver = '01000000042'
order by requested_us desc, tx_id, retry_count desc limit 20""")


def retry_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookups.in_status(spark, message_store(spark, sf, "by_status"), "RETRYING", "FAX")
    return rows.select("tx_id", "retry_count", "result_code", us("delivered_at"))


RETRY_CANDIDATES = on_hist("""
select tx_id, retry_count::smallint as retry_count, result_code, delivered_us from hist where status = 'RETRYING' and channel = 'FAX'""")


def recent_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = hist_ops.recent_metrics(metrics.minute_metrics(results(spark, sf)), 5)
    return rows.select(
        "channel", us("metric_time", "metric_us"), "total_count", "success_count", "age"
    )


RECENT_METRICS = on_res("""
select * from (select channel, metric_us, total_count, success_count, cast(row_number() over (partition by channel order by metric_us desc) as int) as age
  from (select channel, delivered_us // 60000000 * 60000000 as metric_us, count(*) as total_count,
          count(*) filter (where status = 'DELIVERED') as success_count from res group by 1, 2) a) b where age <= 5""")


# --- documents -------------------------------------------------------------------


def _sends_digest() -> Column:
    """The ordered sends of a document as one text hash."""
    line = F.transform(
        "sends",
        lambda s: F.concat_ws(
            ":", s["txId"], s["retryCount"].cast("string"), s["status"], s["meta"]["templateId"]
        ),
    )
    return F.md5(F.array_join(line, ",")).alias("sends_md5")


def _stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history as the service has it: a table, not a join."""
    return stage(history(spark, sf), "history")


def _docs(spark: SparkSession, sf: str, max_sends: int = 60) -> DataFrame:
    return documents.customer_month_docs(_stored_history(spark, sf), ZONE, max_sends)


def customer_month_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of at most 60 sends, so that heavy customers show several parts."""
    return _docs(spark, sf).select(
        "doc_id",
        "customer_id",
        "year_month",
        "part",
        "total_count",
        F.size("sends").alias("n_sends"),
        us("updated_at"),
        _sends_digest(),
    )


_DOC_ROWS = """
, months as (select *, strftime(make_timestamp(requested_us), '%Y%m') as year_month from hist),
numbered as (select *, count(*) over (partition by customer_id, year_month) as total_count,
    row_number() over (partition by customer_id, year_month order by requested_us, tx_id, retry_count) - 1 as k from months),
parts as (select *, case when total_count > 60 then k // 60 else 0 end as part from numbered) """
CUSTOMER_MONTH_DOCS = on_hist(_DOC_ROWS + """
select customer_id || '_' || year_month || case when part > 0 then '_p' || part else '' end as doc_id, customer_id, year_month, part,
  min(total_count) as total_count, cast(count(*) as int) as n_sends, max(delivered_us) as updated_us,
  md5(string_agg(tx_id || ':' || retry_count || ':' || status || ':' || template_id, ',' order by requested_us, tx_id, retry_count)) as sends_md5
from parts group by customer_id, year_month, part""")


def heavy_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly documents of customers above 70 sends a month."""
    docs = documents.heavy_week_docs(_stored_history(spark, sf), 70, ZONE, max_sends=15)
    return docs.select(
        "doc_id", "customer_id", "week", "part", F.size("sends").alias("n_sends"), _sends_digest()
    )


HEAVY_CUSTOMERS = on_hist("""
, months as (select *, strftime(make_timestamp(requested_us), '%Y%m') as year_month,
    cast((extract(day from make_timestamp(requested_us)) - 1) // 7 + 1 as int) as week from hist),
heavy as (select * from months qualify count(*) over (partition by customer_id, year_month) > 70),
numbered as (select *, count(*) over (partition by customer_id, year_month, week) as n,
    row_number() over (partition by customer_id, year_month, week order by requested_us, tx_id, retry_count) - 1 as k from heavy),
parts as (select *, case when n > 15 then k // 15 else 0 end as part from numbered)
select customer_id || '_' || year_month || '_w' || week || case when part > 0 then '_p' || part else '' end as doc_id, customer_id, week, part,
  cast(count(*) as int) as n_sends,
  md5(string_agg(tx_id || ':' || retry_count || ':' || status || ':' || template_id, ',' order by requested_us, tx_id, retry_count)) as sends_md5
from parts group by customer_id, year_month, week, part""")


def customer_history(spark: SparkSession, sf: str) -> DataFrame:
    store = message_store(spark, sf, "by_customer")
    rows = lookups.customer_history(spark, store, "CUS0000000042", "202401", "202402", ZONE)
    return rows.select(
        "customer_id", "year_month", "txId", "retryCount", "channel", "status", us("requestedAt", "requested_us")
    )


CUSTOMER_HISTORY = on_hist(_DOC_ROWS + """
select customer_id, year_month, tx_id as "txId", retry_count as "retryCount", channel, status, requested_us
from parts where customer_id = 'CUS0000000042' and year_month between '202401' and '202402'""")


def find_send_in_docs(spark: SparkSession, sf: str) -> DataFrame:
    store = message_store(spark, sf, "by_tx", "by_customer")
    found = lookups.documents_with(spark, store, _one_tx(spark, sf), ZONE)
    return documents.sends_of(found).select(
        "customer_id", "year_month", "txId", "retryCount", "status"
    )


FIND_SEND = on_hist(_DOC_ROWS + """
select customer_id, year_month, tx_id as "txId", retry_count as "retryCount", status from parts where event_id = 88""")


def docs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return documents.docs_by_status(_docs(spark, sf))


DOCS_BY_STATUS = on_hist("""
select status, channel, count(*) as n, count(distinct customer_id) as customers from hist group by 1, 2""")


def history_equals_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents were loaded without every 250th message: those must show."""
    hist = _stored_history(spark, sf)
    lost = F.expr("cast(substring(tx_id, 22) as bigint)") % 250 == 9
    docs = documents.customer_month_docs(hist.where(~lost), ZONE)
    return reconcile.history_equals_docs(hist, docs)


HISTORY_EQUALS_DOCS = on_hist("""
select tx_id, retry_count, status, cast(1 as bigint) as surplus, 'history' as only_in from hist where event_id % 250 = 9""")


QUERIES = {
    "latest_status": (latest_status, LATEST_STATUS),
    "attempt_chain": (attempt_chain, ATTEMPT_CHAIN),
    "history_by_tx": (history_by_tx, HISTORY_BY_TX),
    "history_by_receiver": (history_by_receiver, HISTORY_BY_RECEIVER),
    "retry_candidates": (retry_candidates, RETRY_CANDIDATES),
    "recent_metrics": (recent_metrics, RECENT_METRICS),
    "customer_month_docs": (customer_month_docs, CUSTOMER_MONTH_DOCS),
    "heavy_customers": (heavy_customers, HEAVY_CUSTOMERS),
    "customer_history": (customer_history, CUSTOMER_HISTORY),
    "find_send_in_docs": (find_send_in_docs, FIND_SEND),
    "docs_by_status": (docs_by_status, DOCS_BY_STATUS),
    "history_equals_docs": (history_equals_docs, HISTORY_EQUALS_DOCS),
}
