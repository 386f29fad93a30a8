from pyspark.sql import functions as F

from dispatchlake.operators import documents, reconcile
from dispatchlake.operators.history import history_rows
from dispatchlake.sources.workload import requests, results


def hist(spark, sf):
    """Half of all sends belong to one customer."""
    rows = history_rows(requests(spark, sf), results(spark, sf))
    hot = F.expr("cast(substring(tx_id, 22) as bigint)") % 2 == 0
    return rows.withColumn("customer_id", F.when(hot, "HOT").otherwise(F.col("customer_id")))


def test_hot_customer_is_split_and_nothing_is_lost(spark, sf):
    rows = hist(spark, sf)
    docs = documents.customer_month_docs(rows, "UTC", max_sends=50).cache()
    assert docs.agg(F.max(F.size("sends"))).first()[0] <= 50
    hot = docs.where("customer_id = 'HOT'").orderBy("year_month", "part").collect()
    assert len(hot) > 5 and hot[0].doc_id == f"HOT_{hot[0].year_month}"
    assert hot[1].doc_id.endswith("_p1")
    month = [s for d in hot if d.year_month == hot[0].year_month for s in d.sends]
    assert month == sorted(month, key=lambda s: (s.requestedAt, s.txId, s.retryCount))
    assert hot[0].total_count == len(month)
    assert documents.sends_of(docs).count() == rows.count()
    assert reconcile.history_equals_docs(rows, docs).count() == 0


def test_lookups_in_documents(spark, sf):
    docs = documents.customer_month_docs(hist(spark, sf), "UTC").cache()
    tx = documents.sends_of(docs).where("retryCount = 1").first().txId
    found = documents.find_send_in_docs(docs, tx).collect()
    assert len(found) == 1 and {s.txId for s in found[0].sends} == {tx}
    mine = documents.customer_history(docs, "HOT", "202401", "202401")
    assert mine.count() == docs.where("customer_id = 'HOT' and year_month = '202401'").first().total_count


def test_heavy_customers_get_weeks(spark, sf):
    rows = hist(spark, sf)
    assert [r.customer_id for r in documents.heavy_customers(rows, 100, "UTC").collect()] == ["HOT"]
    weeks = documents.heavy_week_docs(rows, 100, "UTC")
    assert {r.week for r in weeks.collect()} == {1, 2, 3, 4, 5}
    assert documents.sends_of(weeks).count() == rows.where("customer_id = 'HOT'").count()


def test_missing_and_extra_sends_show(spark, sf):
    rows = hist(spark, sf)
    docs = documents.customer_month_docs(rows.where("channel <> 'FAX'"), "UTC")
    diff = reconcile.history_equals_docs(rows.where("channel <> 'RCS'"), docs)
    got = {r.only_in: r.n for r in diff.groupBy("only_in").agg(F.count("*").alias("n")).collect()}
    assert got == {
        "history": rows.where("channel = 'FAX'").count(),
        "documents": rows.where("channel = 'RCS'").count(),
    }
