"""Record and table schemas. Feed schemas use the JSON (camelCase) names."""

from __future__ import annotations

ATTACHMENTS = "array<struct<name:string,size_mb:double>>"
META = "struct<campaignId:string,templateId:string,retryCount:int>"

# Times arrive as ISO-8601 text; they are cast after parsing so that one bad
# time does not spoil the rest of the record.
REQUEST_JSON = (
    "txId string, requestId string, channel string, priority int, sender string, "
    "receiver string, subject string, body string, "
    f"attachments {ATTACHMENTS}, scheduledAt string, requestedAt string, "
    f"source string, meta {META}"
)
RESULT_JSON = (
    "txId string, channel string, receiver string, sender string, status string, "
    "resultCode string, errorDetail string, retryCount int, source string, "
    "dispatchedAt string, deliveredAt string, elapsedMs int, adapterVersion string"
)
FEED = "key string, value string, topic string, timestamp timestamp"

REQUEST = (
    "tx_id string, request_id string, channel string, priority int, sender string, "
    f"receiver string, subject string, body string, attachments {ATTACHMENTS}, "
    f"scheduled_at timestamp, requested_at timestamp, source string, meta {META}"
)
RESULT = (
    "tx_id string, channel string, receiver string, sender string, status string, "
    "result_code string, error_detail string, retry_count int, source string, "
    "dispatched_at timestamp, delivered_at timestamp, elapsed_ms int, adapter_version string"
)
HISTORY = (
    "tx_id string, request_id string, channel string, sender string, receiver string, "
    "status string, result_code string, retry_count smallint, source string, "
    "scheduled_at timestamp, requested_at timestamp, dispatched_at timestamp, "
    "delivered_at timestamp, created_at timestamp"
)
METRICS = (
    "metric_time timestamp, channel string, send_method_code string, total_count bigint, "
    "success_count bigint, fail_count bigint, retry_count bigint, dlq_count bigint, "
    "avg_latency_ms int, p95_latency_ms int"
)
SCHEDULE = (
    "batch_id string, channel string, total_requests int, status string, scheduled_at timestamp"
)
DLQ = "tx_id string, channel string, error_reason string, payload string, created_at timestamp"
SENDER_CODE = "sender_code string, sender_name string, description string"

REQUEST_NAMES = {
    "txId": "tx_id",
    "requestId": "request_id",
    "scheduledAt": "scheduled_at",
    "requestedAt": "requested_at",
}
RESULT_NAMES = {
    "txId": "tx_id",
    "resultCode": "result_code",
    "errorDetail": "error_detail",
    "retryCount": "retry_count",
    "dispatchedAt": "dispatched_at",
    "deliveredAt": "delivered_at",
    "elapsedMs": "elapsed_ms",
    "adapterVersion": "adapter_version",
}
