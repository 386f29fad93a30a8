"""Counts, rates and latency figures over results and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dispatchlake.codes import (
    ATTACHMENT_BOUNDS,
    BUSINESS_ZONE,
    DAILY_TARGET,
    FAIL_REASONS,
    FALLBACK,
    LATENCY_BOUNDS_MS,
    ONLINE_DELAY_MS,
    SUCCESS_FLOOR,
    bounds_table,
)
from dispatchlake.functions import status, txid
from dispatchlake.functions.text import number_range
from dispatchlake.functions.times import (
    DAY,
    HOUR,
    MINUTE,
    SECOND,
    bucket_start,
    gap_us,
    local,
)
from dispatchlake.operators.joins import due_times


def code() -> Column:
    return F.col("result_code")


EXACT_BITS = 11


def latency_bin(ms: Column) -> Column:
    """`ms` itself below 2048, above it the middle of one of 1024 equal bins per power of two.

    A percentile over bins is off by 1 in 2048 at most, and holds no more than
    2048 + 1024 x 20 counters, however many distinct latencies come in. Bins of
    partial results merge by adding counters.
    """
    size = F.abs(ms.cast("bigint"))
    drop = F.length(F.bin(size)) - EXACT_BITS
    low = F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)
    middle = low + F.call_function("shiftleft", F.lit(1).cast("bigint"), drop - 1)
    return F.when(size < 1 << EXACT_BITS, ms.cast("bigint")).otherwise(F.signum(ms).cast("bigint") * middle)


def metric_columns() -> list[Column]:
    """The aggregates of one metric row; shared by the batch and stream jobs."""
    decided = status.decision(F.col("tx_id"), code(), F.col("retry_count"))
    return [
        F.count("*").alias("total_count"),
        F.count_if(status.is_success(code())).alias("success_count"),
        F.count_if(status.is_permanent(code())).alias("fail_count"),
        F.count_if(status.is_retryable(code())).alias("retry_count"),
        F.count_if(decided == "DLQ").alias("dlq_count"),
        F.avg("elapsed_ms").alias("_avg"),
    ]


def minute_metrics(res: DataFrame) -> DataFrame:
    """Per delivered minute, channel and method: counts, mean and p95 latency.

    Rows are first counted per latency, partly before the shuffle, so a hot minute
    never gathers its rows.
    """
    return merged_minute_metrics(latency_counts(res))


METRIC_KEYS = ["metric_time", "channel", "send_method_code"]


def latency_counts(res: DataFrame) -> DataFrame:
    """`minute_metrics` in parts that add up: per minute, channel, method and latency
    the numbers of results. Parts of any split of the results give the same sums."""
    counts = metric_columns()[:-1]
    return res.select(
        bucket_start(F.col("delivered_at"), MINUTE).alias("metric_time"),
        "channel",
        txid.method_code(F.col("tx_id")).alias("send_method_code"),
        "tx_id",
        "result_code",
        "retry_count",
        "elapsed_ms",
    ).groupBy(*METRIC_KEYS, "elapsed_ms").agg(*counts)


def merged_minute_metrics(parts: DataFrame) -> DataFrame:
    """`minute_metrics` from stored `latency_counts`."""
    names = ["total_count", "success_count", "fail_count", "retry_count", "dlq_count"]
    known = F.when(F.col("elapsed_ms").isNotNull(), F.col("total_count"))
    mean = F.sum(F.col("elapsed_ms") * known) / F.sum(known)
    minute = Window.partitionBy(*METRIC_KEYS)
    upto = minute.orderBy("elapsed_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumns(
        {"_place": (F.sum(known).over(minute) - 1) * F.lit(0.95), "_upto": F.sum(known).over(upto)}
    )

    def at(place: Column) -> Column:
        """The latency at a place of the minute's order."""
        return F.min(F.when(F.col("_upto") > place, F.col("elapsed_ms"))).cast("double")

    return (
        placed.groupBy(*METRIC_KEYS)
        .agg(
            *[F.sum(n).alias(n) for n in names],
            mean.alias("_avg"),
            at(F.floor("_place")).alias("_low"),
            at(F.ceil("_place")).alias("_high"),
            F.first("_place").alias("_place"),
        )
        .withColumn("_p95", between("_low", "_high", F.col("_place") - F.floor("_place")))
        .withColumns(
            {
                "avg_latency_ms": F.round("_avg").cast("int"),
                "p95_latency_ms": F.round("_p95").cast("int"),
                "p95_exact": F.round("_p95", 3),
            }
        )
        .drop("_avg", "_low", "_high", "_place", "_p95")
    )


def between(low: str, high: str, share: Column) -> Column:
    """The point at `share` of the way from `low` to `high`; null without values.

    The sum is rounded once, as `quantile_cont` of the comparison SQL does: a value
    that lies on a half then rounds to the same whole number.
    """
    fma = [F.lit("java.lang.Math"), F.lit("fma"), F.col(low), 1 - share, F.col(high) * share]
    return F.when(F.col(low).isNotNull(), F.java_method(*fma).cast("double"))


def success_rate(res: DataFrame, width_us: int = HOUR, at: str = "delivered_at") -> DataFrame:
    """Delivered share of all attempts per channel and time bucket."""
    return (
        res.groupBy("channel", bucket_start(F.col(at), width_us).alias("bucket"))
        .agg(F.count("*").alias("total"), F.count_if(status.is_success(code())).alias("success"))
        .withColumn("rate", F.col("success") / F.col("total"))
    )


def per_second(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy("channel", bucket_start(F.col(at), SECOND).alias("second")).agg(
        F.count("*").alias("n")
    )


def tps(res: DataFrame, at: str = "dispatched_at") -> DataFrame:
    """Peak and mean messages per second per channel.

    The mean runs over the whole span of the channel, idle seconds included.
    """
    seconds = per_second(res, at)
    span = gap_us(F.max("second"), F.min("second")) / SECOND + 1
    return seconds.groupBy("channel").agg(
        F.max("n").alias("peak_tps"),
        F.count("*").alias("busy_seconds"),
        F.sum("n").alias("total"),
        (F.sum("n") / span).alias("mean_tps"),
    )


def dispatch_delays(req: DataFrame, res: DataFrame) -> DataFrame:
    """First attempts with the delay between due time and dispatch."""
    due = due_times(req)
    first = res.where("retry_count = 0").select("tx_id", "channel", "dispatched_at")
    return first.join(due, "tx_id").withColumns(
        {
            "delay_us": gap_us(F.col("dispatched_at"), F.col("due_at")),
            "lane": status.method_lane(F.col("tx_id")),
        }
    )


def pipeline_delay(req: DataFrame, res: DataFrame, limit_ms: int = ONLINE_DELAY_MS) -> DataFrame:
    """Mean delay per channel and the share within the limit."""
    return (
        dispatch_delays(req, res)
        .groupBy("channel")
        .agg(
            F.count("*").alias("n"),
            F.sum("delay_us").alias("sum_delay_us"),
            F.count_if(F.col("delay_us") <= limit_ms * 1000).alias("n_within"),
        )
        .select(
            "channel",
            "n",
            (F.col("sum_delay_us") / 1000 / F.col("n")).alias("mean_delay_ms"),
            (F.col("n_within") / F.col("n")).alias("within_share"),
        )
    )


def retry_panel(res: DataFrame) -> DataFrame:
    """Retries and dead letters per channel, in one pass."""
    decided = status.decision(F.col("tx_id"), code(), F.col("retry_count"))
    return res.groupBy("channel").agg(
        F.count_if(decided == "RETRY").alias("retry_count"),
        F.count_if(decided == "DLQ").alias("dlq_count"),
    )


def failure_patterns(
    res: DataFrame, min_messages: int = 20, factor: float = 2.0, digits: int = 7
) -> DataFrame:
    """Failure rate per channel and number range against the channel's rate.

    Failed means a permanent code. Flagged from `min_messages` messages and
    `factor` times the channel rate.
    """
    ranges = res.groupBy(
        "channel", number_range(F.col("channel"), F.col("receiver"), digits).alias("prefix")
    ).agg(F.count("*").alias("n"), F.count_if(status.is_permanent(code())).alias("failed"))
    channels = ranges.groupBy("channel").agg(
        (F.sum("failed") / F.sum("n")).alias("channel_rate")
    )
    return (
        ranges.join(channels, "channel")
        .withColumn("fail_rate", F.col("failed") / F.col("n"))
        .withColumn(
            "flagged",
            (F.col("n") >= min_messages)
            & (F.col("failed") > 0)
            & (F.col("fail_rate") >= factor * F.col("channel_rate")),
        )
    )


def worst_prefixes(res: DataFrame, k: int, min_messages: int, digits: int = 7) -> DataFrame:
    """The k number ranges of at least `min_messages` with the highest failure rate per channel."""
    rank = Window.partitionBy("channel").orderBy(F.desc("fail_rate"), F.desc("n"), "prefix")
    return (
        failure_patterns(res, min_messages, digits=digits)
        .where(F.col("n") >= min_messages)
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
    )


def _reason(channel: Column, code: Column) -> Column:
    reason = F.lit(None).cast("string")
    for name, known, text in FAIL_REASONS:
        reason = F.when((channel == name) & (code == known), text).otherwise(reason)
    return reason


def send_counters(res: DataFrame) -> DataFrame:
    """Sends by channel and status; FAX and EMAIL also by failure reason."""
    return res.groupBy(
        "channel", "status", _reason(F.col("channel"), code()).alias("fail_reason")
    ).agg(F.count("*").alias("n"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Index of the first bound >= value; len(bounds) beyond the last."""
    index = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        index = F.when(value <= bounds[i], i).otherwise(index)
    return index


def _cumulative(df: DataFrame, value: Column, bounds: dict[str, list[int]]) -> DataFrame:
    # never null: otherwise the join's null check on it is pushed down to the rows
    bucket = F.lit(-1)
    for channel, les in bounds.items():
        bucket = F.when(F.col("channel") == channel, _bucket(F.col("_value"), les)).otherwise(bucket)
    counts = (
        df.where(F.col("channel").isin(list(bounds)))
        .groupBy("channel", value.alias("_value"))
        .agg(F.count("*").alias("_c"))
        .groupBy("channel", bucket.alias("bucket"))
        .agg(F.sum("_c").alias("_n"))
    )
    up_to = Window.partitionBy("channel").orderBy("bucket")
    n = F.coalesce(F.sum("_n").over(up_to), F.lit(0))
    # at most one count row per channel and bound
    return (
        bounds_table(df.sparkSession, bounds)
        .join(F.broadcast(counts), ["channel", "bucket"], "left")
        .select("channel", "bucket", "le", n.alias("n"))
    )


def latency_histogram(res: DataFrame, bounds: dict[str, list[int]] | None = None) -> DataFrame:
    """Cumulative latency counts per channel for every bound and +Inf.

    Rows are counted per latency value, the few values are put in buckets, and
    the running sum is taken over the bucket rows.
    """
    return _cumulative(res, F.col("elapsed_ms"), bounds or LATENCY_BOUNDS_MS)


def attachment_histogram(req: DataFrame) -> DataFrame:
    """Cumulative attachment counts of multimedia requests."""
    size = F.coalesce(F.size("attachments"), F.lit(0))
    return _cumulative(req, size, {"MMS": ATTACHMENT_BOUNDS})


def success_alert(
    res: DataFrame,
    width_us: int = MINUTE,
    floor: float = SUCCESS_FLOOR,
    at: str = "delivered_at",
) -> DataFrame:
    """Windows in which a channel's success rate is at or below the floor."""
    return success_rate(res, width_us, at).where(F.col("rate") <= floor)


def fallback_count(res: DataFrame) -> DataFrame:
    """Fallbacks from rich messages to SMS, against all rich messages."""
    return res.where("channel = 'RCS'").agg(
        F.count_if(code() == FALLBACK).alias("fallbacks"), F.count("*").alias("rcs_attempts")
    )


def dlq_summary(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("channel", "error_reason").agg(F.count("*").alias("n"))


def daily_volume(req: DataFrame, zone: str = BUSINESS_ZONE, target: int = DAILY_TARGET) -> DataFrame:
    """Messages per local day and their share of the daily target."""
    day = F.date_format(local(F.col("requested_at"), zone), "yyyy-MM-dd")
    return (
        req.groupBy(day.alias("day"))
        .agg(F.count("*").alias("n"))
        .withColumn("target_share", F.col("n") / target)
    )


def channel_minutes(res: DataFrame, channels: list[str], width_us: int, at: str) -> DataFrame:
    """Sends per time bucket, one column per channel."""
    return (
        res.groupBy(bucket_start(F.col(at), width_us).alias("bucket"))
        .agg(
            *[F.count_if(F.col("channel") == c).alias(c.lower()) for c in channels],
            F.count("*").alias("total"),
        )
    )


def channel_isolation(
    res: DataFrame,
    channels: list[str],
    width_us: int = MINUTE,
    tolerance: float = 0.5,
    at: str = "dispatched_at",
) -> DataFrame:
    """Does a channel's outage slow the others down?

    For each channel: buckets in which it sent nothing, and the other
    channels' mean sends in those and in the remaining buckets. Isolated means
    the others lost at most `tolerance` of their mean.
    """
    wide = channel_minutes(res, channels, width_us, at)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.col(c.lower()).alias("n")) for c in channels
        ]
    )
    rows = wide.select("bucket", "total", F.explode(cells).alias("c")).select(
        "c.channel", "c.n", (F.col("total") - F.col("c.n")).alias("others")
    )
    idle = F.col("n") == 0
    return (
        rows.groupBy("channel")
        .agg(
            F.count_if(idle).alias("idle_buckets"),
            F.count_if(~idle).alias("busy_buckets"),
            F.sum(F.when(idle, F.col("others"))).alias("_idle_sum"),
            F.sum(F.when(~idle, F.col("others"))).alias("_busy_sum"),
        )
        .select(
            "channel",
            "idle_buckets",
            "busy_buckets",
            F.try_divide("_idle_sum", "idle_buckets").alias("others_when_idle"),
            F.try_divide("_busy_sum", "busy_buckets").alias("others_when_busy"),
        )
        .withColumn(
            "isolated",
            F.col("others_when_idle") >= (1 - tolerance) * F.col("others_when_busy"),
        )
    )


def mixed_load_impact(
    req: DataFrame, res: DataFrame, width_us: int = MINUTE, tolerance: float = 0.2
) -> DataFrame:
    """Online delay in time buckets with and without batch traffic."""
    delays = dispatch_delays(req, res).withColumn(
        "bucket", bucket_start(F.col("dispatched_at"), width_us)
    )
    online = F.col("lane") == "online"
    buckets = delays.groupBy("bucket").agg(
        F.count_if(F.col("lane") == "batch").alias("batch"),
        F.count_if(online).alias("n"),
        F.sum(F.when(online, F.col("delay_us"))).alias("delay"),
    )
    mixed = F.col("batch") > 0
    parts = buckets.where("n > 0").agg(
        F.sum(F.when(mixed, F.col("n"))).alias("n_mixed"),
        F.sum(F.when(~mixed, F.col("n"))).alias("n_alone"),
        F.sum(F.when(mixed, F.col("delay"))).alias("_mixed"),
        F.sum(F.when(~mixed, F.col("delay"))).alias("_alone"),
    )
    return (
        parts.select(
            "n_mixed",
            "n_alone",
            F.try_divide(F.col("_mixed") / 1000, F.col("n_mixed")).alias("mixed_delay_ms"),
            F.try_divide(F.col("_alone") / 1000, F.col("n_alone")).alias("alone_delay_ms"),
        )
        .withColumn("ratio", F.try_divide("mixed_delay_ms", "alone_delay_ms"))
        .withColumn("ok", F.abs(F.col("ratio") - 1) <= tolerance)
    )


def campaign_report(hist: DataFrame) -> DataFrame:
    """Outcome per source, campaign and template. Needs the `meta` column."""
    return hist.groupBy(
        "source",
        F.col("meta.campaignId").alias("campaign_id"),
        F.col("meta.templateId").alias("template_id"),
    ).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "DELIVERED").alias("delivered"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "RETRYING").alias("retrying"),
    )


def _sum_before(name: str, keys: list[str], order: str) -> Column:
    """Sum of `name` over the earlier rows of `keys`; 0 for the first."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(earlier), F.lit(0))


def sliding_success(
    res: DataFrame, window_us: int = MINUTE, at: str = "delivered_at", block_us: int = 10 * SECOND
) -> DataFrame:
    """Success rate of the channel over the last minute, at each result.

    A result counts from its own time until `window_us` later, so the window
    total is a running sum of entries minus exits. Entries and exits are summed
    per microsecond, then run inside short time blocks on top of the block's
    opening balance, which is the sum of the day's earlier blocks and of the
    earlier days. A busy channel is spread over its blocks, its blocks over its
    days, and a burst at one instant is one row. `block_us` divides a day.
    """
    us = F.unix_micros(F.col(at))
    ok = F.when(status.is_success(code()), 1).otherwise(0)
    both = F.array(
        F.struct(us.alias("us"), F.lit(1).alias("n"), ok.alias("ok")),
        F.struct((us + window_us + 1).alias("us"), F.lit(-1).alias("n"), (-ok).alias("ok")),
    )
    steps = (
        res.select("channel", F.explode(both).alias("s"))
        .groupBy("channel", F.col("s.us").alias("us"))
        .agg(F.sum("s.n").alias("n"), F.sum("s.ok").alias("ok"))
        .withColumn("block", F.floor(F.col("us") / block_us))
    )
    day = F.floor(F.col("block") * block_us / DAY).alias("day")
    blocks = steps.groupBy("channel", day, "block").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    days = blocks.groupBy("channel", "day").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    days = days.select(
        "channel",
        "day",
        _sum_before("n", ["channel"], "day").alias("n_days"),
        _sum_before("ok", ["channel"], "day").alias("ok_days"),
    )
    opening = blocks.join(days, ["channel", "day"]).select(
        "channel",
        "block",
        (_sum_before("n", ["channel", "day"], "block") + F.col("n_days")).alias("n0"),
        (_sum_before("ok", ["channel", "day"], "block") + F.col("ok_days")).alias("ok0"),
    )
    inside = Window.partitionBy("channel", "block").orderBy("us")
    running = (
        steps.withColumns({"n": F.sum("n").over(inside), "ok": F.sum("ok").over(inside)})
        .join(opening, ["channel", "block"])
        .select(
            "channel",
            "us",
            (F.col("n") + F.col("n0")).alias("window_total"),
            (F.col("ok") + F.col("ok0")).alias("window_success"),
        )
    )
    return (
        res.withColumn("us", us)
        .join(running, ["channel", "us"])
        .drop("us")
        .withColumn("window_rate", F.col("window_success") / F.col("window_total"))
    )


def burst_backlog(req: DataFrame, capacity: int, at: str = "requested_at") -> DataFrame:
    """Messages waiting at the end of each busy second when `capacity` leave per second.

    backlog = S - min(S, lowest earlier S), with S = arrivals so far minus
    capacity so far. An idle second only lowers S, so the lowest value before a
    busy second is the one just before it.

    One row per channel and second, whatever the traffic. Sum and minimum run
    inside each day; a day's own sum and minimum are one row, and only those
    rows run over the whole channel.
    """
    seconds = (
        per_second(req, at)
        .withColumn("s", F.unix_seconds("second"))
        .withColumn("day", F.floor(F.col("s") / (DAY // SECOND)))
    )
    so_far = (
        Window.partitionBy("channel", "day")
        .orderBy("s")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # the level before a second, and the lowest so far, as if the day were the first
    inside = seconds.withColumn(
        "before", F.sum("n").over(so_far) - F.col("n") - capacity * F.col("s")
    ).withColumn("lowest", F.min("before").over(so_far))
    days = (
        inside.groupBy("channel", "day")
        .agg(F.sum("n").alias("n"), F.min("before").alias("lowest"))
        .withColumn("carried", _sum_before("n", ["channel"], "day"))
    )
    past = Window.partitionBy("channel").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        F.col("channel").alias("_channel"),
        F.col("day").alias("_day"),
        "carried",
        F.min(F.col("carried") + F.col("lowest")).over(past).alias("past"),
    )
    lowest = F.least(F.col("carried") + F.col("lowest"), F.col("past"))
    level = F.col("carried") + F.col("before") + F.col("n") - capacity
    # null channels keep their rows
    meet = F.col("channel").eqNullSafe(F.col("_channel")) & F.col("day").eqNullSafe(F.col("_day"))
    return inside.join(days, meet).select(
        "channel",
        "second",
        F.col("n").alias("arrived"),
        F.greatest(level - lowest, F.lit(0)).alias("backlog"),
    )


def burst_check(req: DataFrame, capacity: int, at: str = "requested_at") -> DataFrame:
    """Per channel: total, peak backlog and the seconds needed to drain at the end."""
    rows = burst_backlog(req, capacity, at)
    return rows.groupBy("channel").agg(
        F.sum("arrived").alias("total"),
        F.max("arrived").alias("peak_arrivals"),
        F.max("backlog").alias("peak_backlog"),
        F.ceil(F.max_by("backlog", "second") / capacity).alias("drain_seconds"),
    )
