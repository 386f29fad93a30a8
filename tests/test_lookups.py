from pyspark.sql import functions as F

from dispatchlake.operators import documents, history
from dispatchlake.operators.channels import ChannelSpec, cap_of, default_specs, latency_bounds
from dispatchlake.operators.history import history_rows
from dispatchlake.operators.metrics import latency_bin, latency_histogram
from dispatchlake.operators.ratelimit import last_releases
from dispatchlake.queries import base
from dispatchlake.sources import lookups
from dispatchlake.sources.workload import requests, results
from dispatchlake.streaming.commits import Commits


def rows_of(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def hist(spark, sf):
    """Half of all sends go to one receiver; some rows have no receiver or a bad id."""
    rows = history_rows(requests(spark, sf), results(spark, sf))
    n = F.pmod(F.xxhash64("tx_id"), F.lit(100))
    return rows.withColumn(
        "receiver", F.when(n < 50, "HOT").when(n == 99, None).otherwise(F.col("receiver"))
    ).withColumn("tx_id", F.when(n == 98, "bad").otherwise(F.col("tx_id")))


def test_lookups_equal_scans_and_open_few_files(spark, sf, tmp_path):
    rows, path = hist(spark, sf).cache(), str(tmp_path / "store")
    part = F.pmod(F.crc32(F.coalesce("receiver", F.lit(""))), F.lit(9))
    for i in range(9):
        assert lookups.add_messages(rows.where(part == i), path, i)
    assert not lookups.add_messages(rows, path, 8)  # a repeated batch does nothing
    lookups.add_messages(rows.where("retry_count = 0"), path, 9)  # copies

    store = Commits(spark, path)
    assert len(store.segments("by_tx")) <= 3  # nine became one of the next level and the rest
    tx = rows.where("retry_count = 1 and tx_id <> 'bad'").first().tx_id
    for table, value in (("by_tx", tx), ("by_receiver", "01000000042")):
        files = sum(len(s["files"]) for s in store.segments(table))
        opened = len(store.read(table, points=[lookups._key_of(spark, value)]).inputFiles())
        assert 0 < opened <= len(store.segments(table)) < files

    cols = lookups.LISTED
    assert rows_of(lookups.by_tx(spark, path, tx), cols) == rows_of(history.history_by_tx(rows, tx), cols)
    assert lookups.by_tx(spark, path, "bad").count() == rows.where("tx_id = 'bad'").distinct().count()
    for receiver, limit in (("HOT", None), ("HOT", 7), ("01000000042", 20), ("nobody", 5)):
        got = lookups.by_receiver(spark, path, receiver, limit).select(*cols).collect()
        want = history.history_by_receiver(rows, receiver, limit).select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    got = lookups.in_status(spark, path, "RETRYING", "FAX")
    assert rows_of(got, cols) == rows_of(history.retry_candidates(rows, "RETRYING", "FAX"), cols)


def test_hot_receiver_spans_files(spark, sf, tmp_path):
    path = str(tmp_path / "store")
    lookups.add_messages(hist(spark, sf).where("receiver = 'HOT'"), path, 0)
    assert len(Commits(spark, path).segments("by_receiver")[0]["files"]) > 1


def test_documents_with_late_results(spark, sf, tmp_path):
    rows, path = hist(spark, sf).cache(), str(tmp_path / "store")
    one = rows.where("tx_id <> 'bad' and retry_count = 1").first()
    late = (F.col("tx_id") == one.tx_id) & (F.col("retry_count") == 1)
    first = rows.withColumn("status", F.when(late, "RETRYING").otherwise(F.col("status")))
    lookups.add_messages(first, path, 0)
    before = {s["path"] for s in Commits(spark, path).segments("by_customer")}
    lookups.add_messages(rows.where(late).withColumn("status", F.lit("DELIVERED")), path, 1)
    assert before < {s["path"] for s in Commits(spark, path).segments("by_customer")}  # not rewritten

    now = rows.withColumn("status", F.when(late, "DELIVERED").otherwise(F.col("status")))
    docs = documents.customer_month_docs(now, "UTC", 20)
    want = documents.find_send_in_docs(docs, one.tx_id).drop("updated_at").collect()
    got = lookups.documents_with(spark, path, one.tx_id, "UTC", 20).drop("updated_at")
    assert got.select(*documents.find_send_in_docs(docs, "x").drop("updated_at").columns).collect() == want
    assert [s.status for d in want for s in d.sends if s.retryCount == 1] == ["DELIVERED"]
    cols = ["txId", "retryCount", "status"]
    mine = lookups.customer_history(spark, path, one.customer_id, "202401", "202412", "UTC")
    assert rows_of(mine, cols) == rows_of(
        documents.customer_history(docs, one.customer_id, "202401", "202412"), cols
    )


def test_empty_store(spark, sf, tmp_path):
    path = str(tmp_path / "store")
    lookups.add_messages(hist(spark, sf).limit(0), path, 0)
    assert lookups.by_tx(spark, path, "x").count() == 0
    assert lookups.in_status(spark, path).count() == 0
    assert lookups.documents_with(spark, path, "x").count() == 0


def test_latency_bins_are_few_and_close(spark):
    wide = spark.range(0, 2**31 - 1, 1049).select(F.col("id").cast("int").alias("ms"))
    near = spark.range(-5000, 10_000).select(F.col("id").cast("int").alias("ms"))
    rows = wide.unionAll(near).withColumn("bin", latency_bin(F.col("ms")))
    off = rows.select(F.max(F.abs(F.col("bin") - F.col("ms")) / F.greatest(F.abs("ms"), F.lit(1))))
    assert off.first()[0] <= 1 / 2048
    assert rows.where("ms between -2047 and 2047 and bin <> ms").count() == 0
    assert wide.select(latency_bin(F.col("ms"))).distinct().count() <= 2048 + 1024 * 20
    assert spark.sql("select cast(null as int) ms").select(latency_bin(F.col("ms"))).first()[0] is None


def test_specs_give_caps_and_bounds(spark):
    specs = [*default_specs(), ChannelSpec("PUSH", latency_bounds_ms=[5, 50], cap=2)]
    df = spark.createDataFrame([("PUSH", i) for i in range(60)] + [("SMS", 1), ("X", 2)], "channel string, elapsed_ms int")
    caps = {r.channel: r.c for r in df.select("channel", cap_of(F.col("channel"), specs, 9).alias("c")).collect()}
    assert caps == {"PUSH": 2, "SMS": 9, "X": 9}
    rows = latency_histogram(df, latency_bounds(specs)).where("channel = 'PUSH'").collect()
    assert len(rows) == 3 and max(r[-1] for r in rows) == 60
    sent = df.select("channel", F.col("elapsed_ms").cast("string").alias("id"), F.timestamp_micros(F.col("elapsed_ms").cast("bigint")).alias("release_at"))
    none = sent.select("channel", "id", F.col("release_at").alias("at")).limit(0)
    kept = last_releases(sent, none, cap_of(F.col("channel"), specs), "at", "id", most=2)
    assert sorted((r.channel, r.id) for r in kept.collect()) == [("PUSH", "58"), ("PUSH", "59")]


def test_message_store_loads_a_layout_when_a_query_needs_it(spark, sf):
    base._stores.clear()
    path = base.message_store(spark, sf, "by_status")
    one = Commits(spark, path)
    assert {t for t in lookups.TABLES if one.segments(t)} == {"by_status"}
    assert base.message_store(spark, sf, "by_tx", "by_status") == path
    both = Commits(spark, path)
    assert {t for t in lookups.TABLES if both.segments(t)} == {"by_tx", "by_status"}
    assert both.segments("by_status") == one.segments("by_status")  # not loaded again
    rows = base.history(spark, sf)
    assert lookups._newest(both.read("by_tx")).count() == rows.count()
    got = lookups.in_status(spark, path, "RETRYING", "FAX")
    cols = ["tx_id", "retry_count", "result_code", "delivered_at"]
    assert rows_of(got, cols) == rows_of(history.retry_candidates(rows, "RETRYING", "FAX"), cols)
