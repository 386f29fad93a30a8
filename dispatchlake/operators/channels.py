"""Channel rules as data: a new channel is one more `ChannelSpec`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import (
    ATTACHMENT_LIMIT_MB,
    BAD_RECEIVER,
    LATENCY_BOUNDS_MS,
    OVERSIZE,
    SMS_BYTE_LIMIT,
    TEXT_BAD_ADDRESS,
    TEXT_OVERSIZE,
)
from dispatchlake.functions.text import euckr_length, is_email, is_mobile


@dataclass(frozen=True)
class ChannelSpec:
    """What the engine needs to know about a channel.

    `warnings` maps a flag to the condition that raises it (the message is
    still sent); `failures` maps a result code to (condition, detail text) and
    stops the message. `cap` is the sends per second (none: the job's own), see
    `cap_of`; `latency_bounds_ms` are the bounds of its histogram, see `latency_bounds`.
    """

    name: str
    warnings: dict[str, Column] = field(default_factory=dict)
    failures: dict[str, tuple[Column, Column]] = field(default_factory=dict)
    latency_bounds_ms: list[int] = field(default_factory=list)
    cap: int | None = None


def over_sms_bytes(body: Column) -> Column:
    size = euckr_length(F.coalesce(body, F.lit("")), only_above=SMS_BYTE_LIMIT)
    return F.coalesce(size > SMS_BYTE_LIMIT, F.lit(False))


def oversize_mb(attachments: Column, limit: float = ATTACHMENT_LIMIT_MB) -> Column:
    """Size of the first attachment over the limit, null when all fit."""
    over = F.filter(attachments, lambda a: F.coalesce(a["size_mb"], F.lit(0.0)) > limit)
    return F.get(over, F.lit(0))["size_mb"]


def default_specs() -> list[ChannelSpec]:
    """The five channels of the service."""
    too_big = oversize_mb(F.col("attachments"))
    receiver = F.coalesce(F.col("receiver"), F.lit(""))
    bounds = LATENCY_BOUNDS_MS
    sms_body = F.when(F.col("channel") == "SMS", F.col("body"))
    return [
        ChannelSpec(
            "SMS",
            warnings={
                "receiver_suspect": ~is_mobile(F.col("receiver")),
                "mms_recommended": over_sms_bytes(sms_body),
            },
            latency_bounds_ms=bounds["SMS"],
        ),
        ChannelSpec(
            "MMS",
            failures={
                OVERSIZE: (
                    too_big.isNotNull(),
                    F.concat(F.lit(f"{TEXT_OVERSIZE} ("), too_big.cast("string"), F.lit("MB)")),
                )
            },
            latency_bounds_ms=bounds["MMS"],
        ),
        ChannelSpec("RCS", latency_bounds_ms=bounds["RCS"]),
        ChannelSpec("FAX", latency_bounds_ms=bounds["FAX"]),
        ChannelSpec(
            "EMAIL",
            warnings={"subject_missing": F.coalesce(F.col("subject"), F.lit("")) == ""},
            failures={
                BAD_RECEIVER: (
                    ~is_email(F.col("receiver")),
                    F.concat(F.lit(TEXT_BAD_ADDRESS), receiver),
                )
            },
            latency_bounds_ms=bounds["EMAIL"],
        ),
    ]


def cap_of(channel: Column, specs: list[ChannelSpec], default: int | None = None) -> Column:
    """Sends per second of a row's channel: its spec's `cap`, else `default` (null: no limit)."""
    cap = F.lit(default).cast("bigint")
    for spec in specs:
        if spec.cap is not None:
            cap = F.when(channel == spec.name, spec.cap).otherwise(cap)
    return cap


def latency_bounds(specs: list[ChannelSpec]) -> dict[str, list[int]]:
    """Histogram bounds by channel, for `latency_histogram`; channels without bounds are left out."""
    return {s.name: s.latency_bounds_ms for s in specs if s.latency_bounds_ms}


def apply_channels(df: DataFrame, specs: list[ChannelSpec]) -> DataFrame:
    """Add `channel_known`, `warnings`, `fail_code` and `fail_detail`."""
    channel = F.col("channel")
    flags, codes, details = [], [], []
    for spec in specs:
        here = channel == spec.name
        flags += [F.when(here & cond, flag) for flag, cond in spec.warnings.items()]
        codes += [F.when(here & cond, code) for code, (cond, _) in spec.failures.items()]
        details += [F.when(here & cond, text) for cond, text in spec.failures.values()]
    null = F.lit(None).cast("string")
    return df.withColumns(
        {
            "channel_known": F.coalesce(channel.isin([s.name for s in specs]), F.lit(False)),
            "warnings": F.array_compact(F.array(*flags, null)),
            "fail_code": F.coalesce(*codes, null),
            "fail_detail": F.coalesce(*details, null),
        }
    )


def sms_receiver_check(df: DataFrame) -> DataFrame:
    """Add `receiver_suspect`; a warning only."""
    return df.withColumn("receiver_suspect", ~is_mobile(F.col("receiver")))


def sms_body_check(df: DataFrame) -> DataFrame:
    """Add `mms_recommended` for bodies over 80 EUC-KR bytes; nothing is cut."""
    return df.withColumn("mms_recommended", over_sms_bytes(F.col("body")))


def mms_attachment_check(df: DataFrame, limit: float = ATTACHMENT_LIMIT_MB) -> DataFrame:
    """Add `oversize_mb`, and `fail_code` / `fail_detail` when it is set."""
    size = oversize_mb(F.col("attachments"), limit)
    return df.withColumns(
        {
            "oversize_mb": size,
            "fail_code": F.when(size.isNotNull(), OVERSIZE),
            "fail_detail": F.concat(
                F.lit(f"{TEXT_OVERSIZE} ("), size.cast("string"), F.lit("MB)")
            ),
        }
    )


def email_address_check(df: DataFrame) -> DataFrame:
    """Add `fail_code` / `fail_detail` for malformed addresses."""
    bad = ~is_email(F.col("receiver"))
    text = F.concat(F.lit(TEXT_BAD_ADDRESS), F.coalesce(F.col("receiver"), F.lit("")))
    return df.withColumns(
        {"fail_code": F.when(bad, BAD_RECEIVER), "fail_detail": F.when(bad, text)}
    )


def email_subject_check(df: DataFrame) -> DataFrame:
    """Add `subject_missing`; a warning only."""
    return df.withColumn("subject_missing", F.coalesce(F.col("subject"), F.lit("")) == "")


def format_for_channel(df: DataFrame) -> DataFrame:
    """Project requests to the dispatch shape of their channel.

    SMS is plain text (flagged, never cut, over 80 bytes), MMS and FAX carry
    media, RCS is a card with a title, EMAIL has a subject.
    """
    channel, subject = F.col("channel"), F.coalesce(F.col("subject"), F.lit(""))
    titled = channel.isin("MMS", "RCS", "EMAIL")
    with_media = channel.isin("MMS", "RCS", "FAX", "EMAIL")
    sms_body = F.when(channel == "SMS", F.col("body"))
    return df.withColumns(
        {
            "layout": F.when(channel == "SMS", "text")
            .when(channel == "MMS", "multimedia")
            .when(channel == "RCS", "card")
            .when(channel == "FAX", "document")
            .when(channel == "EMAIL", "mail"),
            "title": F.when(titled & (subject != ""), subject),
            "text": F.col("body"),
            "media": F.when(with_media, F.col("attachments")),
            "over_limit": over_sms_bytes(sms_body),
        }
    )
