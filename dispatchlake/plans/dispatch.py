"""From send request to dispatch: one plan for the whole way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import BUSINESS_ZONE
from dispatchlake.functions import txid
from dispatchlake.functions.text import address_key
from dispatchlake.operators.channels import ChannelSpec, apply_channels, cap_of, default_specs
from dispatchlake.operators.intake import check_enums
from dispatchlake.operators.joins import apply_permissions, resolve_customer, sender_register
from dispatchlake.operators.ratelimit import rate_limit
from dispatchlake.operators.routing import route_requests, select_channel, with_dispatch_feed

ADDED = ["refuse_reason", "refuse_detail"]


def screen_requests(
    req: DataFrame,
    register: DataFrame,
    optout: DataFrame,
    permissions: DataFrame,
    specs: list[ChannelSpec] | None = None,
    zone: str = BUSINESS_ZONE,
    contacts: DataFrame | None = None,
) -> DataFrame:
    """Add `refuse_reason` (null: may be sent) and `refuse_detail`.

    Requests as parsed from the feed have no customer_id; with `contacts` it is
    found by the receiver's address and added.

    Rules in order: transaction id, sender register, opt-out list, consent and
    night ban, allowed values, channel failures. All rules are columns of one
    pass, so refused requests are kept without a second scan; only the opt-out
    and consent joins may shuffle.
    """
    specs = specs or default_specs()
    if contacts is not None and "customer_id" not in req.columns:
        req = resolve_customer(req, contacts)
    codes = sender_register(register).withColumn("_known", F.lit(True))
    blocked = optout.select(
        address_key(F.col("receiver")).alias("_address"), F.lit(True).alias("_blocked")
    ).distinct()
    rows = (
        route_requests(req)
        .join(codes, txid.sender_code(F.col("tx_id")) == F.col("_code"), "left")
        .join(blocked, address_key(F.col("receiver")) == F.col("_address"), "left")
    )
    rows = apply_permissions(rows, permissions, zone=zone).withColumnRenamed(
        "refuse_reason", "_consent"
    )
    rows = apply_channels(
        check_enums(rows, [s.name for s in specs]), specs
    )
    reason = F.coalesce(
        F.col("reject_reason"),
        F.when(F.col("_known").isNull(), "UNREGISTERED_SENDER"),
        F.when(F.col("_blocked"), "OPTED_OUT"),
        F.col("_consent"),
        F.when(F.size("bad_enums") > 0, "BAD_VALUE"),
        F.col("fail_code"),
    )
    return rows.select(
        *req.columns,
        reason.alias("refuse_reason"),
        F.when(reason == F.col("fail_code"), F.col("fail_detail")).alias("refuse_detail"),
        "warnings",
    )


def dispatch_requests(
    screened: DataFrame,
    cap: int | None,
    at: str = "requested_at",
    specs: list[ChannelSpec] | None = None,
) -> DataFrame:
    """Choose the channel of the accepted requests and pace them.

    Adds `send_channel`, `release_at` and the dispatch `topic`. A rate limit
    applies to the channel a message really leaves on: its spec's `cap`, or
    `cap` for channels that name none.
    """
    accepted = screened.where("refuse_reason is null").drop(*ADDED)
    chosen = select_channel(accepted, code=None)
    pace = cap_of(F.col("send_channel"), specs or default_specs(), cap)
    paced = rate_limit(chosen, pace, at, key="send_channel")
    return with_dispatch_feed(paced, "send_channel")
