"""Taking requests and results in: parse, unbundle, merge, check, trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake import schemas
from dispatchlake.codes import CHANNELS, FEEDS, SENDER_SEED, SOURCES, STATUSES, retention_table
from dispatchlake.functions import txid
from dispatchlake.functions.times import DAY, SECOND, due_at

CORRUPT = "_corrupt"
# marks bodies over the size limit, which go to the error path whole
TOO_LARGE = "too_large"


def _parse(df: DataFrame, schema: str, names: dict[str, str], times: list[str]) -> DataFrame:
    record = F.from_json(
        F.col("value"),
        f"{schema}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    parsed = df.withColumn("_r", record)
    fields = [f.name for f in parsed.schema["_r"].dataType.fields if f.name != CORRUPT]
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    if TOO_LARGE in df.columns:
        bad = bad | F.col(TOO_LARGE)

    def field(name: str) -> Column:
        value = F.col(f"_r.{name}")
        value = value.try_cast("timestamp") if name in times else value
        return value.alias(names.get(name, name))

    kept = [c for c in df.columns if c != "value"]
    return parsed.select(
        *kept,
        *[field(f) for f in fields],
        (~bad).alias("parse_ok"),
        F.when(bad, F.col("value")).alias("raw"),
    )


def parse_requests(df: DataFrame) -> DataFrame:
    """JSON `value` to request columns. `parse_ok` is false for the error path,
    whose rows keep their text in `raw`."""
    return _parse(df, schemas.REQUEST_JSON, schemas.REQUEST_NAMES, ["scheduledAt", "requestedAt"])


def parse_results(df: DataFrame) -> DataFrame:
    """JSON `value` to result columns, as in `parse_requests`."""
    return _parse(df, schemas.RESULT_JSON, schemas.RESULT_NAMES, ["dispatchedAt", "deliveredAt"])


def read_due_batch(df: DataFrame, now: Column | str, at: str = "scheduled_at") -> DataFrame:
    """Rows whose scheduled time has come."""
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return df.where(F.col(at) <= moment)


def unbundle(df: DataFrame, items: str = "items") -> DataFrame:
    """N-message bundles to single records; `item_no` keeps the order (from 0).

    An empty or null bundle stays as one row with a null `item_no`, for the error path.
    """
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode_outer(items).alias("item_no", "_item")).select(
        *rest, "item_no", "_item.*"
    )


def merge_intakes(*feeds: DataFrame) -> DataFrame:
    """All intake paths as one request feed; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def load_codes(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """Seed sender codes that `existing` does not have yet."""
    seed = spark.createDataFrame(SENDER_SEED, schemas.SENDER_CODE)
    return seed.join(existing.select("sender_code").distinct(), "sender_code", "left_anti")


# milliseconds of a send are a 32-bit number, and time zones add less than a day
LONGEST_SEND_DAYS = 26


def replay(
    feed: DataFrame,
    history: DataFrame,
    start: Column,
    end: Column,
    at: str = "delivered_at",
    slack_us: int | None = DAY,
) -> DataFrame:
    """Results of [start, end) that history lacks, one row per attempt.

    A result with a bad id is lacking unless history has an equal one of that id
    and count; distinct ones all stay.

    Of the history only the window and `slack_us` on both sides are read: copies of
    an attempt carry its delivery time, give or take that much (None: read all). A
    stored history (`sinks.append_history`) is pruned by its `day` of dispatch too,
    which lies at most `LONGEST_SEND_DAYS` before.
    """
    if slack_us is not None:
        slack = F.make_dt_interval(secs=F.lit(slack_us / SECOND))
        first, last = start - slack, end + slack
        if "day" in history.columns:
            earliest = F.date_sub(F.to_date(first), LONGEST_SEND_DAYS)
            near = F.col("day").between(earliest, F.to_date(last))
            history = history.where(F.col("day").isNull() | near)
        history = history.where(F.col(at).isNull() | ((F.col(at) >= first) & (F.col(at) < last)))
    window = feed.where((F.col(at) >= start) & (F.col(at) < end))
    once = txid.once_per_attempt(window)
    return once.join(
        history.select("tx_id", F.col("retry_count").cast("int").alias("retry_count")),
        ["tx_id", "retry_count"],
        "left_anti",
    )


def retain(df: DataFrame, now: Column, feed: str = "topic", at: str = "timestamp") -> DataFrame:
    """Rows still inside the retention time of their feed; unknown feeds are kept."""
    policy = F.broadcast(retention_table(df.sparkSession).withColumnRenamed("feed", feed))
    keep_from = now - F.make_dt_interval(hours=F.col("retention_hours"))
    return (
        df.join(policy, feed, "left")
        .where(F.col("retention_hours").isNull() | (F.col(at) >= keep_from))
        .drop("retention_hours")
    )


def retain_feed(df: DataFrame, feed: str, now: Column, at: str = "timestamp") -> DataFrame:
    """`retain` for a table that holds one feed: a plain filter the scan can use."""
    return df.where(F.col(at) >= now - F.make_dt_interval(hours=F.lit(FEEDS[feed][1])))


def attach_trace(
    df: DataFrame, step: str, node: str = "spark", received_at: Column | None = None
) -> DataFrame:
    """Trace columns for REQUEST_RECEIVED / RESULT_RECEIVED and the feed key."""
    return df.withColumns(
        {
            "received_at": received_at if received_at is not None else F.current_timestamp(),
            "node": F.lit(node),
            "flow_step": F.lit(step),
            "feed_key": F.col("tx_id"),
        }
    )


def _not_in(name: str, allowed: list[str]) -> Column:
    value = F.col(name)
    return F.when(value.isNull() | ~value.isin(allowed), name)


def check_enums(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Add `bad_enums`: names of channel, source, status columns outside their lists."""
    rules = {"channel": channels or CHANNELS, "source": SOURCES, "status": STATUSES}
    present = [_not_in(name, allowed) for name, allowed in rules.items() if name in df.columns]
    return df.withColumn("bad_enums", F.array_compact(F.array(*present)))


def required_fields(df: DataFrame) -> DataFrame:
    """Add `missing_fields`: required columns that are null or empty.

    Requests and results share the rule; only columns the table has are checked.
    """
    names = ["tx_id", "channel", "receiver", "sender", "body", "result_code"]
    present = [
        F.when(F.col(n).isNull() | (F.col(n) == ""), n) for n in names if n in df.columns
    ]
    return df.withColumn("missing_fields", F.array_compact(F.array(*present)))


def due_requests(df: DataFrame, now: Column) -> DataFrame:
    """Requests that may be dispatched at `now`: due, with a usable id."""
    return df.where(txid.is_valid(F.col("tx_id")) & (due_at() <= now))
