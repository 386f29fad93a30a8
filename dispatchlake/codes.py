"""Domain constants and the small reference tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: identifiers -------------------------------------------------
TX_LENGTH = 35
METHOD_CODES = ["01", "02", "03", "04", "05"]
METHOD_LANES = {
    "01": "batch",
    "02": "batch",
    "03": "online",
    "04": "near_real_time",
    "05": "near_real_time",
}
SEQUENCE_DIGITS = 14
SEQUENCE_LIMIT = 10**14
BUSINESS_ZONE = "Asia/Seoul"
ADAPTER_VERSION = "1.0.0"

# --- fixed values: allow-lists -------------------------------------------------
CHANNELS = ["SMS", "MMS", "RCS", "FAX", "EMAIL"]
SOURCES = ["CI", "AB_CAMPAIGN", "CRM", "DIRECT_API"]
STATUSES = ["PENDING", "SENT", "DELIVERED", "FAILED", "RETRYING"]
STATUS_RANK = {"PENDING": 0, "SENT": 1, "RETRYING": 2, "FAILED": 3, "DELIVERED": 3}
SUCCESS = "10000"
BAD_RECEIVER = "40001"
OVERSIZE = "40004"
FALLBACK = "50002"

# --- fixed values: result codes (code, class, meaning, next step) --------------
RESULT_CODES = [
    ("10000", "success", "delivered", "history"),
    ("40001", "permanent", "bad receiver or transaction id", "dlq"),
    ("40002", "permanent", "timeout", "dlq"),
    ("40003", "permanent", "network or handset error", "dlq"),
    ("40004", "permanent", "attachment too large", "dlq"),
    ("40005", "permanent", "fax no answer", "dlq"),
    ("40006", "permanent", "fax paper out", "dlq"),
    ("40007", "permanent", "mail bounce", "dlq"),
    ("40008", "permanent", "mail blocked as spam", "dlq"),
    ("50001", "retry", "temporary carrier error", "retry"),
    ("50002", "fallback", "rich message not supported", "retry_as_sms"),
    ("50003", "retry", "fax busy", "retry"),
    ("50004", "retry", "temporary mail server error", "retry"),
]
FAIL_REASONS = [
    ("FAX", "10000", "none"),
    ("FAX", "50003", "busy"),
    ("FAX", "40006", "paper_out"),
    ("FAX", "40005", "no_answer"),
    ("EMAIL", "10000", "none"),
    ("EMAIL", "40001", "invalid_address"),
    ("EMAIL", "40007", "bounce"),
    ("EMAIL", "40008", "spam"),
    ("EMAIL", "50004", "smtp_error"),
]

# --- fixed values: histogram bounds --------------------------------------------
LATENCY_BOUNDS_MS = {
    "SMS": [10, 30, 50, 80, 100, 150, 200, 300, 500, 1000],
    "MMS": [20, 50, 80, 120, 160, 200, 300, 500, 800, 1500],
    "RCS": [10, 30, 60, 100, 150, 200, 300, 500, 1000],
    "FAX": [50, 100, 150, 200, 300, 500, 800, 1200, 2000],
    "EMAIL": [5, 10, 20, 30, 50, 80, 120, 200, 400],
}
ATTACHMENT_BOUNDS = [0, 1, 2, 3, 5, 10]

# --- fixed values: policies ----------------------------------------------------
MAX_RETRIES = 3
RETRY_BASE_S = 30
SMS_BYTE_LIMIT = 80
ATTACHMENT_LIMIT_MB = 2.0
ON_TIME_S = 60
ONLINE_DELAY_MS = 500
SUCCESS_FLOOR = 0.95
CONSISTENCY_FLOOR = 0.999
HEAVY_SENDS = 500
DAILY_TARGET = 50_000_000

# --- fixed values: feeds (partitions, retention in hours) ----------------------
FEEDS = {
    "topic.send.request": (12, 24),
    "topic.send.dispatch.sms": (6, 6),
    "topic.send.dispatch.mms": (6, 6),
    "topic.send.dispatch.rcs": (6, 6),
    "topic.send.dispatch.fax": (3, 6),
    "topic.send.dispatch.email": (3, 6),
    "topic.send.result": (12, 48),
    "topic.send.retry": (6, 72),
    "topic.send.dlq": (3, 168),
    "topic.monitor.metrics": (3, 1),
}
REQUEST_FEED = "topic.send.request"
DISPATCH_FEED = "topic.send.dispatch"
RESULT_FEED = "topic.send.result"
RETRY_FEED = "topic.send.retry"
DLQ_FEED = "topic.send.dlq"

# --- fixed values: sender register seed, message texts -------------------------
SENDER_SEED = [
    ("001", "CI_CAMPAIGN", "CI Campaign 발송"),
    ("002", "RATER", "Rater 실시간 발송"),
]
TEXT_BAD_TXID = "txId 형식 오류 (35자리 숫자 아님)"
TEXT_BAD_ADDRESS = "이메일 주소 형식 오류: "
TEXT_OVERSIZE = "첨부파일 크기 초과"


def lookup(pairs: dict[str, object]) -> Column:
    """A literal map column; for constant tables of a few entries."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RESULT_CODES, "result_code string, code_class string, meaning string, next_step string"
    )


def retention_table(spark: SparkSession) -> DataFrame:
    rows = [(feed, hours) for feed, (_, hours) in FEEDS.items()]
    return spark.createDataFrame(rows, "feed string, retention_hours int")


def bounds_table(spark: SparkSession, bounds: dict[str, list[int]]) -> DataFrame:
    """One row per channel and bucket; the open last bucket is `+Inf`."""
    rows = [
        (channel, i, str(le))
        for channel, les in bounds.items()
        for i, le in enumerate([*les, "+Inf"])
    ]
    return spark.createDataFrame(rows, "channel string, bucket int, le string")
