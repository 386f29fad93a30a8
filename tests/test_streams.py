"""Streams in several micro-batches, with restarts, against their batch twins."""

import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from dispatchlake.codes import CHANNELS
from dispatchlake.operators import metrics, routing
from dispatchlake.operators.ratelimit import rate_limit
from dispatchlake.queries import streams_and_sinks
from dispatchlake.session import configure_streaming
from dispatchlake.sources import feeds, sinks
from dispatchlake.sources.workload import requests, results
from dispatchlake.streaming import commits, correlate, hold, jobs, runs


@pytest.fixture()
def place(tmp_path):
    return lambda name: str(tmp_path / name)


def append(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, schema, path):
    configure_streaming(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def thirds(df, at):
    """The rows in three parts by time."""
    q = df.select(F.unix_micros(at).alias("u")).approxQuantile("u", [0.33, 0.66], 0.001)
    us = F.unix_micros(at)
    return [df.where(us <= q[0]), df.where((us > q[0]) & (us <= q[1])), df.where(us > q[1])]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_minute_metrics_restart_and_closed_windows(spark, sf, place):
    res = results(spark, sf)
    src, out, ck = place("src"), place("out"), place("ck")
    for part in thirds(res, "delivered_at"):
        append(part, src)
        # stop and start again from the checkpoint for every part
        runs.to_table(
            jobs.stream_minute_metrics(stream_of(spark, res.schema, src)), out, ck
        ).awaitTermination()
    got = spark.read.parquet(out)
    last = res.agg(F.max("delivered_at")).first()[0]
    closed = metrics.minute_metrics(res).where(
        F.col("metric_time") <= F.lit(last - timedelta(minutes=11))
    )
    assert closed.count() > 100
    keys = got.columns
    within = got.where(F.col("metric_time") <= F.lit(last - timedelta(minutes=11)))
    assert rows_of(within.select(*keys)) == rows_of(closed.select(*keys))


def test_dedup_across_batches(spark, sf, place):
    res = results(spark, sf)
    src, out, ck = place("src"), place("out"), place("ck")
    append(res.where("event_id < 500"), src)
    append(res.where("event_id < 500 and event_id >= 498"), src)
    runs.to_table(jobs.stream_dedup(stream_of(spark, res.schema, src), "40 days"), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == res.where("event_id < 500").count()
    assert got.select("tx_id", "retry_count").distinct().count() == got.count()


def test_retries_leave_once_and_survive_restart(spark, sf, place):
    """The clock of a retry job is that of its failures here: the latest `delivered_at` of a part."""
    res = results(spark, sf)
    src, out, ck = place("src"), place("out"), place("ck")
    clocks = []
    for part in thirds(res, "delivered_at"):
        append(part, src)
        runs.retry_stream(stream_of(spark, res.schema, src), out, ck, "delivered_at").awaitTermination()
        clocks.append(jobs.retry_steps(part).agg(F.max("delivered_at")).first()[0])
    got = hold.released(spark, out)
    retries = routing.plan_retries(res)
    gone = retries.where(F.col("due_at") <= F.lit(clocks[-1]))
    cols = ["tx_id", "send_channel", "next_retry_count", "due_at"]
    assert gone.count() > 20
    assert rows_of(got.where("decision = 'RETRY'").select(*cols)) == rows_of(gone.select(*cols))
    left = hold.held(spark, out, got.drop("released_at", "batch_id").schema, "due_at")
    assert rows_of(left.select(*cols)) == rows_of(retries.where(F.col("due_at") > F.lit(clocks[-1])).select(*cols))
    for row in got.where("decision = 'RETRY'").collect():
        assert row.released_at == min(c for c in clocks if c >= row.due_at)
    assert got.where("decision <> 'RETRY'").count() == routing.dead_letters(res).count()


def test_a_repeated_batch_releases_the_same_rows(spark, place):
    def rows(*pairs):
        df = spark.createDataFrame(pairs, "tx_id string, due_s int, at_s int")
        at = [F.timestamp_seconds(c).alias(n) for c, n in (("due_s", "due"), ("at_s", "at"))]
        return df.select("tx_id", *at, F.lit(False).alias(hold.TICK))

    out = place("out")
    first = rows(("a", 1, 5), ("b", 700, 5), ("c", None, 5), ("d", 6, 5))
    second = rows(("e", 650, 640), ("f", 641, 650), ("g", 9_000, 1))
    third = rows(("h", None, 9_500))
    for batch_id, batch in enumerate([first, first.limit(0), second, third]):
        for _ in range(2):
            hold.release(batch, batch_id, out, "due", "at")
    got = hold.released(spark, out)
    assert rows_of(got.select("tx_id", "batch_id")) == [
        ("a", 0), ("b", 3), ("c", 0), ("d", 2), ("e", 2), ("f", 2), ("g", 3), ("h", 3)
    ]
    assert commits.Commits(spark, out).segments("held") == []
    assert hold.held(spark, out, first.drop(hold.TICK).schema, "due").count() == 0


def test_rows_leave_on_time_while_nothing_arrives(spark, place):
    src, out, ck = place("src"), place("out"), place("ck")
    now = time.time()
    req = spark.createDataFrame(
        [("soon", now + 6), ("later", now + 3600), ("past", now - 5), ("open", None)],
        "tx_id string, s double",
    ).select("tx_id", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("scheduled_at"))
    append(req, src)
    query = runs.hold_stream(stream_of(spark, req.schema, src), out, ck, every="1 second")
    try:
        gone = {}
        while "soon" not in gone and time.time() < now + 60:
            time.sleep(1)
            assert query.exception() is None
            gone = {r.tx_id: r for r in hold.released(spark, out).collect()}
    finally:
        query.stop()
    assert set(gone) == {"soon", "past", "open"}
    late = gone["soon"].released_at.timestamp() - (now + 6)
    assert 0 <= late < 30


def numbered(spark, start, n, due_every=7, wait=1000):
    """Rows with a due time up to `wait` seconds after `start`; every `due_every`-th without."""
    k = F.col("id")
    due = F.when(k % due_every != 0, F.timestamp_seconds(start + 1 + k * 37 % wait))
    rows = spark.range(n).select(
        (k + start * 1000).alias("tx_id"), due.alias("due"), F.timestamp_seconds(F.lit(start)).alias("at")
    )
    return rows.withColumn(hold.TICK, F.lit(False))


def files_below(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_held_files_stay_few_and_rows_leave_once(spark, place):
    out, all_rows = place("out"), []
    for batch_id in range(18):
        rows = numbered(spark, 100 * batch_id, 50)
        all_rows += [(r.tx_id, r.due) for r in rows.collect()]
        hold.release(rows, batch_id, out, "due", "at")
        held = commits.Commits(spark, out)
        assert len(held.segments("held")) <= 2 * commits.FAN_IN
        assert len(held.segments("released")) <= 2 * commits.FAN_IN
    # only live segments and those of the last commit are on disk: four files each at most
    assert files_below(out + "/held") <= 4 * 3 * commits.FAN_IN
    gone = hold.released(spark, out).collect()
    now = 1700
    due = {t for t, d in all_rows if d is None or d.timestamp() <= now}
    assert sorted(r.tx_id for r in gone) == sorted(due)
    for r in gone:
        arrived = r.tx_id // 1000
        first = max(arrived, -(-r.due.timestamp() // 100) * 100 if r.due else arrived)
        assert r.released_at.timestamp() == first and r.batch_id == first // 100
    left = hold.held(spark, out, numbered(spark, 0, 1).drop(hold.TICK).schema, "due")
    assert {r.tx_id for r in left.collect()} == {t for t, _ in all_rows} - due


def test_files_of_the_passed_time_only_are_opened(spark, place, monkeypatch):
    out = place("out")
    hold.release(numbered(spark, 0, 4000, wait=100_000), 0, out, "due", "at")
    read = commits.Commits(spark, out)
    schema = numbered(spark, 0, 1).drop(hold.TICK).withColumn(hold.DUE, F.lit(0).cast("long")).schema
    some = read.read("held", schema, 0, 10_000_000_000)
    every = read.read("held", schema)
    assert 0 < len(some.inputFiles()) < len(every.inputFiles())


def test_ticks_alone_leave_no_files(spark, place):
    out = place("out")
    tick = numbered(spark, 5, 1).withColumn(hold.TICK, F.lit(True))
    for batch_id in range(6):
        hold.release(tick, batch_id, out, "due")
    assert files_below(out) == 0 and hold.released(spark, out).count() == 0
    assert len(os.listdir(out + "/_commits")) <= 2 * (commits.KEPT_MANIFESTS + 1)  # with checksums


def test_an_attempt_that_dies_leaves_nothing(spark, place, monkeypatch):
    out = place("out")
    rows = numbered(spark, 0, 40)
    hold.release(rows, 0, out, "due", "at")
    before = rows_of(hold.released(spark, out))
    append_rows, calls = commits.Batch.append, []

    def dies(self, table, *args, **kwargs):
        if calls:
            raise RuntimeError("killed between two tables")
        calls.append(table)
        return append_rows(self, table, *args, **kwargs)

    monkeypatch.setattr(commits.Batch, "append", dies)
    with pytest.raises(RuntimeError):
        hold.release(numbered(spark, 100, 40), 1, out, "due", "at")
    assert rows_of(hold.released(spark, out)) == before
    monkeypatch.undo()
    hold.release(numbered(spark, 100, 40), 1, out, "due", "at")
    hold.release(numbered(spark, 200, 40), 1, out, "due", "at")  # committed: does nothing
    got = hold.released(spark, out)
    assert got.count() == got.select("tx_id").distinct().count()
    assert got.agg(F.max("tx_id")).first()[0] < 200_000
    assert len(os.listdir(out + "/released")) == 2  # the dead attempt's folder is gone


def test_rate_limit_goes_on_across_batches(spark, sf, place):
    req = requests(spark, sf).withColumn(
        "burst_at", F.timestamp_micros(F.pmod(F.unix_micros("requested_at"), F.lit(60_000_000)))
    )
    src, out, ck = place("src"), place("out"), place("ck")
    for part in thirds(req, "burst_at"):
        append(part, src)
        runs.rate_limit_stream(stream_of(spark, req.schema, src), 2, out, ck, "burst_at").awaitTermination()
    got = runs.limited_rows(spark, out)
    assert commits.Commits(spark, out).manifest["batch"] == 2
    assert commits.Commits(spark, out).segments("state")[0]["rows"] <= 2 * len(CHANNELS)
    shared = os.listdir(spark.conf.get("spark.checkpoint.dir"))
    assert not [n for n in shared if n.startswith("scratch-")]
    cols = ["tx_id", "channel", "release_at"]
    want = rate_limit(req, 2, "burst_at").select(*cols)
    assert rows_of(got.select(*cols)) == rows_of(want)


def test_repeated_micro_batch_replaces_itself(spark, sf, place):
    res = results(spark, sf)
    for _ in range(2):
        sinks.append_history(res, place("h"), batch_id=4)
        sinks.write_dlq(res, place("d"), batch_id=4)
        sinks.write_result_log(res, place("l"), batch_id=4)
    assert spark.read.parquet(place("h")).count() == res.count()
    assert spark.read.parquet(place("l")).count() == res.count()
    assert spark.read.parquet(place("d")).count() == routing.dead_letters(res).count()


def test_correlate_flags_missing(spark, sf, place):
    req, res = requests(spark, sf), results(spark, sf).where("retry_count = 0 and event_id % 10 <> 3")
    a, b, out, ck = place("a"), place("b"), place("out"), place("ck")
    for x, y in zip(thirds(req, "requested_at"), thirds(res, "delivered_at")):
        append(x, a)
        append(y, b)
    feeds_of = stream_of(spark, req.schema, a), stream_of(spark, res.schema, b)
    correlate.correlate_stream(*feeds_of, out, ck, "2 hours", "8 days").awaitTermination()
    got = correlate.correlated(spark, out)
    assert got.where("not missing").count() == res.count()
    early = req.agg(F.max("requested_at")).first()[0] - timedelta(days=9)
    lost = req.join(res, "tx_id", "left_anti").where(F.col("requested_at") < F.lit(early))
    flagged = got.where("missing").where(F.col("requested_at") < F.lit(early))
    assert flagged.count() == lost.count() > 0


def tx(letter):
    return f"170406720000001001001{ord(letter):014d}"


def test_correlate_counts_from_the_due_time(spark, place):
    """Scheduled three days ahead and answered then; late, unknown and missing answers;
    copies on both sides, before and after a restart; bad ids."""
    req = spark.sql("""select * from values
        ('a', 'ra', timestamp'2024-01-01 10:00:00', timestamp'2024-01-04 10:00:00'),
        ('a', 'ra', timestamp'2024-01-01 10:00:00', timestamp'2024-01-04 10:00:00'),
        ('b', 'rb', timestamp'2024-01-01 10:00:00', null),
        ('c', 'rc', timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 12:00:00'),
        ('X', 'rx', timestamp'2024-01-01 10:00:00', null),
        ('X', 'rx', timestamp'2024-01-01 10:00:00', null),
        (null, 'rn', timestamp'2024-01-01 10:00:00', null)
        as t(tx_id, request_id, requested_at, scheduled_at)""")
    res = spark.sql("""select *, '10000' as result_code, 'DELIVERED' as status from values
        ('a', 0, timestamp'2024-01-04 10:00:30'), ('a', 1, timestamp'2024-01-04 10:59:00'),
        ('a', 0, timestamp'2024-01-04 10:00:30'), ('X', 0, timestamp'2024-01-01 10:00:30'),
        ('b', 0, timestamp'2024-01-01 11:30:00'), ('d', 0, timestamp'2024-01-01 11:00:00')
        as t(tx_id, retry_count, delivered_at)""")
    end = "timestamp'2024-01-20 00:00:00'"
    marks = (
        spark.sql(f"select 'z' as tx_id, 'rz' as request_id, {end} as requested_at, cast(null as timestamp) as scheduled_at"),
        spark.sql(f"select 'z' as tx_id, 0 as retry_count, {end} as delivered_at, '10000' as result_code, 'DELIVERED' as status"),
    )
    known = F.when(F.col("tx_id") == "X", "X").otherwise(
        F.concat(F.lit("170406720000001001001"), F.lpad(F.ascii("tx_id").cast("string"), 14, "0"))
    )
    a, b, out, ck = place("a"), place("b"), place("out"), place("ck")
    # requests alone, all results, copies of a request, then the marks: a restart each time
    nothing = res.limit(0)
    for x, y in ((req, nothing), (req.limit(0), res), (req.where("tx_id = 'a'"), nothing), marks):
        append(x.withColumn("tx_id", known), a)
        append(y.withColumn("tx_id", known), b)
        feeds_of = stream_of(spark, req.schema, a), stream_of(spark, res.schema, b)
        correlate.correlate_stream(*feeds_of, out, ck).awaitTermination()
    got = correlate.correlated(spark, out).where(F.coalesce("tx_id", F.lit("")) != tx("z"))
    assert rows_of(got.select("tx_id", "request_id", "retry_count", "missing", "late")) == sorted(
        [
            (tx("a"), "ra", 0, False, False),
            (tx("a"), "ra", 1, False, False),
            (tx("b"), "rb", None, True, False),
            (tx("b"), None, 0, False, True),
            (tx("c"), "rc", None, True, False),
            (tx("d"), None, 0, False, True),
            ("X", "rx", None, True, False),
            ("X", "rx", None, True, False),
            ("X", None, 0, False, True),
            (None, "rn", None, True, False),
        ],
        key=str,
    )
    left = commits.Commits(spark, out)
    assert sum(s["rows"] for t in ("requests", "answered", "results", "matched") for s in left.segments(t)) <= 4


def test_copies_of_a_hot_id_do_not_multiply(spark, place):
    """Half of all rows are copies of one request and of its result."""
    req = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, tx("a")).otherwise(F.concat(F.lit("170406720000001001001"), F.lpad((F.col("id") + 1000).cast("string"), 14, "0"))).alias("tx_id"),
        F.lit("r").alias("request_id"),
        F.lit("2024-01-01 10:00:00").cast("timestamp").alias("requested_at"),
        F.lit(None).cast("timestamp").alias("scheduled_at"),
    )
    res = req.select(
        "tx_id", F.lit(0).alias("retry_count"), F.lit("2024-01-01 10:00:09").cast("timestamp").alias("delivered_at"),
        F.lit("10000").alias("result_code"), F.lit("DELIVERED").alias("status"),
    )
    append(req, place("a"))
    append(res, place("b"))
    feeds_of = stream_of(spark, req.schema, place("a")), stream_of(spark, res.schema, place("b"))
    correlate.correlate_stream(*feeds_of, place("out"), place("ck")).awaitTermination()
    got = correlate.correlated(spark, place("out"))
    assert got.count() == got.select("tx_id").distinct().count() == 2001
    assert got.where("missing or late").count() == 0


def test_one_channel_down_leaves_the_others_running(spark, sf, place):
    req = requests(spark, sf)
    sinks.fan_out(req, place("feeds"))
    configure_streaming(spark)

    def job(stream):
        return stream.select("key", F.get_json_object("value", "$.channel").alias("ch"))

    with pytest.raises(Exception):
        feeds.read_feed(spark, "topic.send.dispatch.push", place("feeds"))
    queries = runs.channel_streams(spark, job, place("out"), place("ck"), place("feeds"))
    queries["SMS"].stop()
    for channel, query in queries.items():
        if channel != "SMS":
            query.awaitTermination()
            got = spark.read.parquet(place("out") + f"/channel={channel}")
            assert got.count() == req.where(F.col("channel") == channel).count()
    assert set(queries) == set(CHANNELS)


def test_broker_options():
    read = feeds.kafka_read_options("broker:9092", "topic.send.result", "latest", 500)
    assert read["startingOffsets"] == "latest" and read["maxOffsetsPerTrigger"] == "500"
    assert read["minPartitions"] == "12"
    write = feeds.kafka_write_options("broker:9092")
    assert write["kafka.acks"] == "all" and write["kafka.enable.idempotence"] == "true"
    assert feeds.kafka_write_options("b", {"kafka.linger.ms": "9"})["kafka.linger.ms"] == "9"


def test_weekly_feed_is_derived_once(spark, sf):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def counted(at):
        seen.add(1)
        return at

    req = requests(spark, sf).where("event_id % 9 = 0").withColumn("requested_at", counted("requested_at"))
    got = streams_and_sinks._held_by_week(req, "hold", "requested_at", "scheduled_at", runs.hold_stream)
    n = got.count()
    assert n == requests(spark, sf).where("event_id % 9 = 0").count()
    assert seen.value == n
