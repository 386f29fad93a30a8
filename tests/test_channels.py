import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dispatchlake.functions.text import clean_phone, euckr_length, is_email, is_mobile
from dispatchlake.operators import channels

ADDRESS = re.compile(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_bytes_of_known_texts(spark):
    values = ["abc", "안녕", "뷁", "a안", "", None, "😀", "안" * 41, "뷁" * 11]
    got = [r.n for r in texts(spark, values).select("i", euckr_length(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [3, 4, 8, 3, 0, None, 0, 82, 88]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(max_size=60), min_size=20, max_size=60))
def test_bytes_equal_codec(spark, values):
    values = [v for v in values if not any("\ud800" <= c <= "\udfff" for c in v)]
    got = texts(spark, values).select(
        "t",
        euckr_length(F.col("t")).alias("n"),
        channels.over_sms_bytes(F.col("t")).alias("over"),
    )
    for r in got.collect():
        size = len(r.t.encode("euc-kr", errors="ignore"))
        assert r.n == size and r.over == (size > 80)


@pytest.mark.parametrize(
    "address",
    ["a@b.c", "a@b", "a b@c.d", "a@b.c\n", "a@b.c\r", "a@　b.c", "a@b.\x1cc", "@b.c", "a@@b.c", "", "a@b.c "],
)
def test_email_rule_equals_pattern(spark, address):
    got = texts(spark, [address]).select(is_email(F.col("t")).alias("ok")).first().ok
    assert got == bool(ADDRESS.match(address))


def test_mobile_rule(spark):
    values = ["010-1234-5678", "01012345678", "0101234567", "010123456", "0212345678", None, "010 1234 5678"]
    got = [r.ok for r in texts(spark, values).select("i", is_mobile(F.col("t")).alias("ok")).orderBy("i").collect()]
    assert got == [True, True, True, False, False, False, True]
    assert texts(spark, ["0 1-0"]).select(clean_phone(F.col("t"))).first()[0] == "010"


def test_first_oversize_attachment_counts(spark):
    schema = "channel string, attachments array<struct<name:string,size_mb:double>>"
    df = spark.createDataFrame(
        [
            ("MMS", [("a", 1.0), ("b", 3.0), ("c", 5.0)]),
            ("MMS", [("a", None), ("b", 2.0)]),
            ("MMS", []),
            ("MMS", None),
        ],
        schema,
    )
    got = [r.fail_detail for r in channels.mms_attachment_check(df).collect()]
    assert got == ["첨부파일 크기 초과 (3.0MB)", None, None, None]


def test_new_channel_needs_only_its_spec(spark):
    push = channels.ChannelSpec("PUSH", failures={"40001": (F.col("receiver") == "", F.lit("none"))})
    df = spark.createDataFrame(
        [("PUSH", ""), ("PUSH", "x"), ("FAX", ""), ("OTHER", "")], "channel string, receiver string"
    )
    got = [(r.channel_known, r.fail_code) for r in channels.apply_channels(df, [push]).collect()]
    assert got == [(True, "40001"), (True, None), (False, None), (False, None)]
