"""Copies, plans and the shared folder."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dispatchlake import session
from dispatchlake.operators import history, intake, joins, metrics
from dispatchlake.session import configure
from dispatchlake.sources.workload import requests, results


def copies(df, n):
    """A third and more of the rows are copies of one message."""
    one = df.where("event_id = 88")
    return df.unionByName(one.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("c"))


def test_copies_do_not_multiply(spark, sf):
    req, res = requests(spark, sf), results(spark, sf)
    many_req, many_res = copies(req, 600), copies(res, 150)
    assert history.history_rows(many_req, many_res).count() == many_res.count()
    assert joins.correlate(many_req, many_res).count() == many_res.count()
    assert joins.fallback_chain(many_res).count() == joins.fallback_chain(res).count()
    assert metrics.dispatch_delays(many_req, res).count() == metrics.dispatch_delays(req, res).count()
    assert history.attempt_chain(many_res).count() == res.count()
    once = history.latest_status(history.stage_events(req, res))
    many = history.latest_status(history.stage_events(many_req, many_res))
    assert sorted(map(str, once.collect())) == sorted(map(str, many.collect()))


def test_scan_reads_only_needed_columns(spark, sf):
    plan = metrics.minute_metrics(results(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_no_product_joins(spark, sf):
    req, res = requests(spark, sf), results(spark, sf)
    frames = [
        joins.schedule_accuracy(req, res),
        metrics.sliding_success(res),
        metrics.latency_histogram(res),
        metrics.mixed_load_impact(req, res),
        joins.fallback_chain(res),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_retention_of_one_feed(spark):
    now = datetime(2024, 1, 10)
    df = spark.createDataFrame(
        [(datetime(2024, 1, 9, 0, 0, 1),), (datetime(2024, 1, 8, 23, 59, 59),)], "timestamp timestamp"
    )
    kept = intake.retain_feed(df, "topic.send.request", F.lit(now))
    assert [r[0] for r in kept.collect()] == [datetime(2024, 1, 9, 0, 0, 1)]


def test_unknown_feed_is_kept(spark):
    df = spark.createDataFrame(
        [("other", datetime(2020, 1, 1)), ("topic.monitor.metrics", datetime(2020, 1, 1))],
        "topic string, timestamp timestamp",
    )
    kept = intake.retain(df, F.lit(datetime(2024, 1, 1)))
    assert [r.topic for r in kept.collect()] == ["other"]


def test_staged_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    staged = session.stage(spark.range(5), "numbers")
    assert staged.count() == 5 and folder in staged.inputFiles()[0]


class FakeCluster:
    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "yarn"


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeCluster())


def test_a_task_reads_a_bounded_share_of_a_large_shuffle(spark):
    """About 100 MB, by four cores: more tasks than cores, none above 16 MB by much."""
    configure(spark)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "true")
    try:
        rows = spark.range(4_000_000).select("id", *[F.rand(i).alias(f"r{i}") for i in range(3)])
        assert rows.repartition(F.col("id")).rdd.getNumPartitions() >= 6
    finally:
        spark.conf.set(merging, "false")
