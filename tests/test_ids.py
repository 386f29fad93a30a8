from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import ids

SAMPLE = "12345678901230308400700000000000001"


def rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "tx_id string")


def test_sample_id_is_valid_and_parses(spark):
    df = ids.txid_parse(ids.txid_validate(rows(spark, [SAMPLE])))
    r = df.first()
    assert r.tx_valid and r.reject_reason is None
    assert (r.message_id, r.send_method_code, r.day_of_year) == ("1234567890123", "03", 84)
    assert (r.sender_code, r.sequence) == ("007", 1)


@pytest.mark.parametrize(
    "tx, reason",
    [
        (None, "NULL_OR_EMPTY"),
        ("", "NULL_OR_EMPTY"),
        ("1234", "LENGTH"),
        ("uuid-v4-not-35chars", "LENGTH"),
        ("A" * 35, "NON_DIGIT"),
        ("9" * 34, "LENGTH"),
        ("12345678901234503084007000000000000001", "LENGTH"),
        ("9" * 35, "METHOD_CODE"),
        (SAMPLE[:34] + "\n", "NON_DIGIT"),
        (SAMPLE[:34] + "١", "NON_DIGIT"),
        (SAMPLE[:13] + "06" + SAMPLE[15:], "METHOD_CODE"),
    ],
)
def test_rejects(spark, tx, reason):
    r = ids.txid_parse(ids.txid_validate(rows(spark, [tx]))).first()
    assert not r.tx_valid and r.reject_reason == reason
    assert r.sequence is None and r.sender_code is None


def test_build_then_validate(spark):
    df = spark.createDataFrame(
        [(c, "7", datetime(2024, 3, 24, 16, 0), i) for i, c in enumerate(["01", "02", "03", "04", "05"])],
        "send_method_code string, sender_code string, requested_at timestamp, sequence bigint",
    )
    built = ids.txid_build(df).withColumnRenamed("built_tx_id", "tx_id")
    got = ids.txid_validate(built.select("tx_id")).collect()
    assert all(r.tx_valid and len(r.tx_id) == 35 for r in got)
    # 16:00 UTC is already the next day in the business zone: day 85
    assert {r.tx_id[15:21] for r in got} == {"085007"}


@pytest.mark.parametrize(
    "method, sender, message, seq, error",
    [
        ("09", "7", "1", 1, "METHOD_CODE"),
        ("01", "1234", "1", 1, "SENDER_CODE"),
        ("01", "-1", "1", 1, "SENDER_CODE"),
        ("01", "7", "12345678901234", 1, "MESSAGE_ID"),
        ("01", "7", "12x", 1, "MESSAGE_ID"),
        ("01", "7", "1", 10**14, "SEQUENCE"),
        ("01", "7", "1", None, "SEQUENCE"),
    ],
)
def test_build_errors_never_cut_parts(spark, method, sender, message, seq, error):
    df = spark.createDataFrame(
        [(method, sender, message, datetime(2024, 1, 1), seq)],
        "send_method_code string, sender_code string, message string, requested_at timestamp, sequence bigint",
    )
    r = ids.txid_build(df, message="message").first()
    assert r.built_tx_id is None and r.build_error == error


def test_hundred_built_ids_are_distinct(spark):
    df = spark.range(100).select(
        F.lit("03").alias("send_method_code"),
        F.lit("007").alias("sender_code"),
        F.lit(datetime(2024, 1, 1)).alias("requested_at"),
    )
    numbered = ids.assign_sequence(
        df.withColumn("n", F.monotonically_increasing_id()), ["n"]
    )
    built = ids.txid_build(numbered).withColumnRenamed("built_tx_id", "tx_id")
    r = ids.txid_uniqueness(built).first()
    assert (r.n_rows, r.n_distinct, r.all_unique) == (100, 100, True)
    assert numbered.agg(F.min("sequence"), F.max("sequence")).first()[:] == (1, 100)
