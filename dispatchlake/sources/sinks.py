"""Tables the jobs write.

Batch jobs append. Stream jobs pass the micro-batch number: its rows go to
their own `batch_id=` folder in overwrite mode, so a repeated batch replaces
itself. `rebalance` lets the adaptive planner split large and merge small
output partitions, hence a day or month with most of the rows is still written
by many tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.operators.channels import format_for_channel
from dispatchlake.operators.routing import dead_letters, dispatch_feed, route_results
from dispatchlake.sources.feeds import to_feed, write_feed
from dispatchlake.session import stage


def _write(df: DataFrame, path: str, by: list[str], batch_id: int | None, **options: str) -> None:
    writer = df.write.options(**options)
    if batch_id is None:
        writer = writer.mode("append")
    else:
        writer, path = writer.mode("overwrite"), f"{path}/batch_id={batch_id}"
    (writer.partitionBy(*by) if by else writer).parquet(path)


HISTORY_COLUMNS = [
    "tx_id",
    "request_id",
    "channel",
    "sender",
    "receiver",
    "status",
    "result_code",
    "retry_count",
    "source",
    "scheduled_at",
    "requested_at",
    "dispatched_at",
    "delivered_at",
]


def as_history(res: DataFrame) -> DataFrame:
    """Result rows in the history columns; what results do not carry is null."""
    types = {"retry_count": "smallint", "request_id": "string"}
    cols = []
    for name in HISTORY_COLUMNS:
        kind = types.get(name, "timestamp" if name.endswith("_at") else "string")
        value = F.col(name) if name in res.columns else F.lit(None)
        cols.append(value.cast(kind).alias(name))
    return res.select(*cols, F.current_timestamp().alias("created_at"))


def append_history(res: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append results to the history, by dispatch day.

    Sorted by receiver for row-group pruning of receiver look-ups, with a bloom
    filter for look-ups by id.
    """
    rows = as_history(res).withColumn("day", F.to_date("dispatched_at"))
    laid_out = rows.hint("rebalance", "day").sortWithinPartitions("receiver", "requested_at")
    _write(laid_out, path, ["day"], batch_id, **{"parquet.bloom.filter.enabled#tx_id": "true"})


def write_customer_month(docs: DataFrame, path: str) -> None:
    """Store documents by month; those of the customers and months present are replaced.

    Stored documents of other customers in these months stay: they are read and
    staged first, because a month is written as a whole.
    """
    keys = ["customer_id", "year_month"]
    try:
        stored = docs.sparkSession.read.option("mergeSchema", "false").schema(docs.schema).parquet(path)
    except AnalysisException:  # nothing stored yet
        stored = None
    if stored is not None:
        months = docs.select("year_month").distinct()
        others = stored.join(months, "year_month", "left_semi").join(
            docs.select(*keys).distinct(), keys, "left_anti"
        )
        docs = stage(docs.unionByName(others), "documents")
    laid_out = docs.hint("rebalance", "year_month").sortWithinPartitions("customer_id")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year_month"
    ).parquet(path)


def write_metrics(metrics: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Store minute rows by day.

    A batch run replaces the days it holds (pass whole days); a stream emits
    each closed minute once and appends.
    """
    rows = metrics.withColumn("day", F.to_date("metric_time"))
    if batch_id is None:
        rows.hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(path)
    else:
        _write(rows, path, ["day"], batch_id)


def write_dlq(res: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append the final failures among results with reason and payload."""
    _write(dead_letters(res), path, [], batch_id)


def write_rejects(routed: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Keep refused requests with their reason and full payload."""
    payload = [c for c in routed.columns if c not in ("route", "feed_key")]
    rejects = routed.where("route = 'reject'").select(
        "tx_id",
        "reject_reason",
        F.to_json(F.struct(*payload)).alias("payload"),
        F.col("received_at"),
    )
    _write(rejects, path, ["reject_reason"], batch_id)


def write_result_log(res: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Log rows by level: success info, retry warn, failed and bad records error."""
    rows = route_results(res).select(
        "tx_id",
        "channel",
        "receiver",
        "result_code",
        "error_detail",
        "elapsed_ms",
        "status",
        "route",
        "level",
    )
    _write(rows, path, ["level"], batch_id)


def fan_out(req: DataFrame, location: str | None = None, servers: str | None = None) -> None:
    """Publish formatted requests to the dispatch feed of their channel."""
    write_feed(to_feed(format_for_channel(req), dispatch_feed("channel")), location, servers)


def write_jdbc_history(res: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a relational history table; needs the database's driver jar."""
    as_history(res).write.jdbc(url, table, mode="append", properties=properties)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
