from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dispatchlake import schemas
from dispatchlake.functions import status
from dispatchlake.operators import history, intake, joins, routing

TX = "12345678901230308400700000000000001"


@pytest.mark.parametrize(
    "tx, code, tries, decision, reason",
    [
        (TX, "10000", 0, "DONE", None),
        (TX, "40003", 0, "DLQ", "PERMANENT"),
        (TX, "50001", 2, "RETRY", "50001"),
        (TX, "50001", 3, "DLQ", "RETRY_EXHAUSTED"),
        (TX, "50002", 0, "RETRY", "50002"),
        (TX, "90000", 0, "ERROR", "UNKNOWN_CODE"),
        ("1234", "10000", 0, "DLQ", "INVALID_TX_ID"),
        (None, "10000", 0, "DLQ", "INVALID_TX_ID"),
    ],
)
def test_decision(spark, tx, code, tries, decision, reason):
    df = spark.createDataFrame([(tx, code, tries)], "tx_id string, result_code string, retry_count int")
    r = routing.classify_failure(df).first()
    assert (r.decision, r.reason) == (decision, reason)


def test_back_off_and_fallback(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(TX, "RCS", "50002", 0, at), (TX, "SMS", "50001", 1, at), (TX, "SMS", "50001", 2, at)],
        "tx_id string, channel string, result_code string, retry_count int, delivered_at timestamp",
    )
    rows = routing.plan_retries(df).orderBy("next_retry_count").collect()
    assert [(r.due_at - at).total_seconds() for r in rows] == [30, 60, 120]
    assert [r.send_channel for r in rows] == ["SMS", "SMS", "SMS"]


def test_result_of_request_without_meta_and_with_bad_id(spark):
    schema = "tx_id string, channel string, receiver string, sender string, source string, meta struct<retryCount:int>, result_code string, error_detail string, elapsed_ms int"
    df = spark.createDataFrame(
        [(TX, "SMS", None, None, None, None, "10000", None, 5), ("", "SMS", "1", "2", "CI", (3,), "10000", None, 5)],
        schema,
    )
    good, bad = routing.build_result(df, F.lit(datetime(2024, 1, 1))).collect()
    assert (good.status, good.retry_count, good.receiver, good.source) == ("DELIVERED", 0, "", "")
    assert (bad.tx_id, bad.status, bad.result_code, bad.retry_count) == ("INVALID_TX_ID", "FAILED", "40001", 3)
    assert [f for f in good.asDict()] == [c.split()[0] for c in schemas.RESULT.split(", ")]


def test_malformed_json_keeps_its_text(spark):
    good = '{"txId":"%s","channel":"SMS","attachments":[{"name":"a"}],"scheduledAt":null,"requestedAt":"2026-03-26T10:00:00+09:00","meta":{"retryCount":0}}' % TX
    df = spark.createDataFrame([(good,), ('{"txId":',), ("nothing",), (None,)], "value string")
    rows = intake.parse_requests(df).collect()
    assert [r.parse_ok for r in rows] == [True, False, False, False]
    assert rows[0].requested_at == datetime(2026, 3, 26, 1, 0) and rows[0].scheduled_at is None
    assert rows[0].attachments[0].size_mb is None
    assert [r.raw for r in rows[1:]] == ['{"txId":', "nothing", None]


def test_seed_codes_are_inserted_if_absent(spark):
    existing = spark.createDataFrame([("001",)], "sender_code string")
    assert [r.sender_code for r in intake.load_codes(spark, existing).collect()] == ["002"]


def test_permissions(spark):
    schema = "customer_id string, channel string, scheduled_at timestamp, requested_at timestamp"
    noon, late = datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 13, 30)  # 12:00 and 22:30 in KST
    req = spark.createDataFrame(
        [
            ("a", "SMS", None, noon),
            ("a", "SMS", late, noon),
            ("a", "EMAIL", None, noon),
            ("a", "FAX", None, late),
            ("b", "FAX", None, late),
            ("b", "SMS", None, noon),
        ],
        schema,
    )
    perms = spark.createDataFrame(
        [("a", True, False, "22:00")],
        "customer_id string, sms_agree boolean, email_agree boolean, night_ban_end string",
    )
    got = {
        (r.customer_id, r.channel, r.scheduled_at is not None): r.refuse_reason
        for r in joins.apply_permissions(req, perms).collect()
    }
    assert got == {
        ("a", "SMS", False): None,
        ("a", "SMS", True): "NIGHT_BAN",
        ("a", "EMAIL", False): "CONSENT",
        ("a", "FAX", False): "NIGHT_BAN",
        ("b", "FAX", False): None,
        ("b", "SMS", False): "CONSENT",
    }


def test_latest_status_order(spark):
    t = [datetime(2024, 1, 1, 0, 0, i) for i in range(6)]
    schema = "tx_id string, retry_count int, status string, result_code string, at timestamp, requested_at timestamp, dispatched_at timestamp, delivered_at timestamp"
    rows = [
        ("x", 0, "PENDING", None, t[0], t[0], None, None),
        ("x", 0, "SENT", None, t[1], None, t[1], None),
        ("x", 0, "RETRYING", "50001", t[2], None, None, t[2]),
        ("x", 1, "SENT", None, t[5], None, t[5], None),
        ("x", 1, "DELIVERED", "10000", t[4], None, None, t[4]),
    ]
    r = history.latest_status(spark.createDataFrame(rows[::-1], schema)).first()
    assert (r.retry_count, r.status, r.result_code) == (1, "DELIVERED", "10000")
    assert (r.requested_at, r.dispatched_at, r.delivered_at) == (t[0], t[5], t[4])


def test_method_lane_of_unknown_code(spark):
    df = spark.createDataFrame([(TX,), (TX[:13] + "09" + TX[15:],)], "tx_id string")
    assert [r.lane for r in df.select(status.method_lane(F.col("tx_id")).alias("lane")).collect()] == ["online", None]


def test_retry_messages_of_all_attempts(spark, sf):
    """One message per resend that `plan_retries` plans; first attempts alone are fewer."""
    from dispatchlake.queries import ALL
    from dispatchlake.sources.workload import results

    got = ALL["retry_messages_all"][0](spark, sf).select("tx_id", "retry_count", "retry_result_code")
    plan = routing.plan_retries(results(spark, sf)).selectExpr(
        "tx_id", "next_retry_count - 1 as retry_count", "result_code"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plan.collect()))
    assert {r.retry_count for r in got.collect()} == {0, 1, 2}


def test_the_first_copy_of_a_request_counts(spark):
    copies = spark.sql("""select * from values
        ('t', 'r2', null, timestamp'2024-01-01 10:00:02', null, 'b2'),
        ('t', 'r1', null, timestamp'2024-01-01 10:00:01', null, 'b1'),
        ('t', 'r3', null, timestamp'2024-01-01 10:00:03', null, 'b3')
        as v(tx_id, request_id, scheduled_at, requested_at, meta, body)""")
    results = spark.sql("select 't' as tx_id, 0 as retry_count")
    for frame in (copies, copies.orderBy("request_id"), copies.repartition(3)):
        assert [r.request_id for r in joins.correlate(frame, results).collect()] == ["r1"]
