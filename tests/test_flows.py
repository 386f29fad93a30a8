"""The whole jobs as streams: all tables of a batch or none, rows equal to the batch plans."""

import json
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from dispatchlake.codes import DLQ_FEED, REQUEST_FEED, RESULT_FEED, RETRY_FEED
from dispatchlake.functions.times import due_at
from dispatchlake.operators import metrics
from dispatchlake.operators.joins import resolve_customer
from dispatchlake.plans.dispatch import dispatch_requests, screen_requests
from dispatchlake.plans.settle import settle_results
from dispatchlake.queries.base import ZONE
from dispatchlake.queries.joins_and_metrics import contacts, optout, permission_table, register
from dispatchlake.session import configure_streaming
from dispatchlake.sources import feeds
from dispatchlake.sources.workload import folded, requests, results
from dispatchlake.streaming import commits, flows


class Killed(Exception):
    pass


@pytest.fixture()
def place(tmp_path):
    return lambda name: str(tmp_path / name)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def die_at(monkeypatch, table):
    """The next write of this table kills the attempt, after the tables before it."""
    append = commits.Batch.append

    def dying(self, name, *args, **kwargs):
        if name == table:
            raise Killed(name)
        return append(self, name, *args, **kwargs)

    monkeypatch.setattr(commits.Batch, "append", dying)


def test_dispatch_job_survives_a_kill(spark, sf, place, monkeypatch):
    configure_streaming(spark)
    req = requests(spark, sf).drop("user_id", "customer_id").where("event_id < 400")
    arrive = F.unix_micros(folded(due_at()))
    middle = 300_000_000

    def job():
        return flows.dispatch_stream(
            feeds.read_feed(spark, REQUEST_FEED, place("feed")),
            register(spark, sf),
            optout(spark, sf),
            permission_table(spark, sf),
            contacts(spark, sf),
            1,
            place("out"),
            place("ck"),
            folded(due_at()),
            zone=ZONE,
            location=place("published"),
        )

    feeds.write_feed(feeds.to_feed(req.where(arrive < middle), REQUEST_FEED), place("feed"))
    job().awaitTermination()
    before = {t: rows_of(commits.stored(spark, place("out"), t)) for t in flows.DISPATCH_TABLES}
    feeds.write_feed(feeds.to_feed(req.where(arrive >= middle), REQUEST_FEED), place("feed"))
    with monkeypatch.context() as patch:
        die_at(patch, "dispatch")
        with pytest.raises(Exception, match="Killed"):
            job().awaitTermination()
    after = {t: rows_of(commits.stored(spark, place("out"), t)) for t in flows.DISPATCH_TABLES}
    assert after == before  # nothing of the dead attempt is visible
    job().awaitTermination()

    known = resolve_customer(req, contacts(spark, sf)).withColumn("arrive_at", folded(due_at()))
    screened = screen_requests(
        known, register(spark, sf), optout(spark, sf), permission_table(spark, sf), zone=ZONE
    )
    want = dispatch_requests(screened, 1, "arrive_at")
    got = commits.stored(spark, place("out"), "requests")
    columns = ["tx_id", "request_id", "body", "send_channel", "release_at", "customer_id"]
    assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    sent = commits.stored(spark, place("out"), "dispatch")
    assert rows_of(sent.select(F.col("key").alias("tx_id"), "topic")) == rows_of(want.select("tx_id", "topic"))
    refused = commits.stored(spark, place("out"), "rejects").select("tx_id", "reject_reason")
    assert rows_of(refused) == rows_of(screened.where("refuse_reason is not null").select("tx_id", "refuse_reason"))
    published = spark.read.parquet(place("published"))
    assert set(rows_of(published.select("key", "topic"))) == set(rows_of(sent.select("key", "topic")))
    assert commits.Commits(spark, place("out")).segments("releases")[0]["rows"] <= 5


@pytest.mark.parametrize("table", ["metrics"])
def test_settle_job_survives_a_kill(spark, sf, place, monkeypatch, table):
    configure_streaming(spark)
    req, res = requests(spark, sf), results(spark, sf).where("event_id < 400")
    odd = F.when(F.col("event_id") % 79 == 78, "X1").otherwise(F.col("tx_id"))
    res = res.withColumn("tx_id", odd).drop("user_id", "event_id")
    late = F.col("delivered_at") >= F.lit("2024-01-15").cast("timestamp")
    orphans = requests(spark, sf).where("event_id <> 7")  # results of event 7 have no request

    def job():
        feed = feeds.read_feed(spark, RESULT_FEED, place("feed"))
        return flows.settle_stream(
            feed,
            lambda: orphans,
            place("out"),
            place("ck"),
            forget_us=40 * 24 * 3600 * 1_000_000,
            location=place("published"),
        )

    def feed(df):
        feeds.write_feed(feeds.to_feed(df, RESULT_FEED, F.col("delivered_at")), place("feed"))

    def outputs():
        return {t: rows_of(commits.stored(spark, place("out"), t).drop("received_at", "created_at")) for t in flows.SETTLE_TABLES}

    feed(res.where(~late))
    feed(res.where(~late).limit(20))  # copies in the same batch
    job().awaitTermination()
    before = outputs()
    feed(res.where(late))
    feed(res.where(~late).orderBy("delivered_at").limit(30))  # copies in a later batch
    with monkeypatch.context() as patch:
        die_at(patch, table)
        with pytest.raises(Exception, match="Killed"):
            job().awaitTermination()
    assert outputs() == before
    job().awaitTermination()

    want = settle_results(res)
    columns = ["tx_id", "channel", "retry_count", "result_code", "delivered_at"]

    def got(table):
        return commits.stored(spark, place("out"), table)

    history = got("history")
    assert rows_of(history.select(*columns)) == rows_of(want["history"].select(*columns))
    asked = history.join(req.select("tx_id", F.col("request_id").alias("own")), "tx_id")
    seven = req.where("event_id = 7").first().tx_id
    assert asked.where(~F.col("own").eqNullSafe(F.col("request_id"))).select("tx_id").distinct().collect() == [(seven,)]
    minutes = flows.stored_metrics(spark, place("out"))
    assert rows_of(minutes) == rows_of(want["metrics"].select(*minutes.columns))
    plan = ["tx_id", "send_channel", "next_retry_count", "due_at"]
    retries = got("retry")
    assert rows_of(retries.select(*plan)) == rows_of(want["retry"].select(*plan))
    assert retries.where("has_request and meta.retryCount <> next_retry_count").count() == 0
    letters = ["tx_id", "channel", "error_reason"]
    assert rows_of(got("dlq").select(*letters)) == rows_of(want["dlq"].select(*letters))
    assert rows_of(got("errors").select(*columns)) == rows_of(want["errors"].select(*columns))
    log = got("log")
    assert log.count() == res.distinct().count() and log.where("flow_step <> 'RESULT_RECEIVED'").count() == 0
    published = spark.read.parquet(place("published"))
    for feed_name, n in ((RETRY_FEED, retries.count()), (DLQ_FEED, got("dlq").count())):
        own = published.where(F.col("topic") == feed_name)
        assert own.distinct().count() == n > 0
    record = json.loads(published.where(F.col("topic") == RETRY_FEED).first().value)
    assert {"txId", "body", "retryResultCode", "meta", "receiver"} <= set(record)


def test_segments_merge_by_levels(spark, place):
    tables = {"rows": commits.Layout(by=("k",), order=("v",))}
    for number in range(20):
        df = spark.createDataFrame([(number, number % 2)], "v long, k long")
        commits.in_one_commit(place("t"), tables, lambda rows, batch: batch.append("rows", rows))(df, number)
    store = commits.Commits(spark, place("t"))
    assert [s["level"] for s in store.segments("rows")].count(1) == 2
    assert len(store.segments("rows")) == 2 + 20 % commits.FAN_IN
    got = store.read("rows")
    assert got.columns == ["v", "k"]
    assert rows_of(got) == rows_of(spark.createDataFrame([(n, n % 2) for n in range(20)], "v long, k long"))
    assert commits.stored(spark, place("nothing"), "rows", got.schema).count() == 0


def test_p95_on_a_half_rounds_as_the_sql_does(spark):
    """Latencies whose 95th percentile often lies on a half, in one and in several parts."""
    chosen = random.Random(3)
    rows = [
        (datetime(2024, 1, 1) + timedelta(minutes=m), chosen.choice([None, *range(0, 1000)]))
        for m in range(1500)
        for _ in range(chosen.choice([1, 2, 3, 7, 9, 11]))
    ]
    res = spark.createDataFrame(rows, "delivered_at timestamp, elapsed_ms int").withColumns(
        {
            "channel": F.lit("FAX"),
            "tx_id": F.lit("1704067200000" + "04" + "0" * 20),
            "result_code": F.lit("10000"),
            "retry_count": F.lit(0),
        }
    )
    con = duckdb.connect()
    con.execute("create table t (minute timestamp, ms int)")
    con.executemany("insert into t values (?, ?)", rows)
    want = dict(con.sql("select epoch_us(minute), cast(round(quantile_cont(ms, 0.95)) as int) from t group by 1").fetchall())
    halves = metrics.latency_counts(res.where("elapsed_ms % 2 = 0 or elapsed_ms is null"))
    halves = halves.unionByName(metrics.latency_counts(res.where("elapsed_ms % 2 = 1")))
    for got in (metrics.minute_metrics(res), metrics.merged_minute_metrics(halves)):
        got = got.select(F.unix_micros("metric_time"), "p95_latency_ms")
        assert {r[0]: r[1] for r in got.collect()} == want
