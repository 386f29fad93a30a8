"""Feeds: keyed JSON records, on Kafka or as Parquet files of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake import schemas
from dispatchlake.codes import FEEDS
from dispatchlake.functions.times import iso_text

MAX_BODY_BYTES = 20 * 1024 * 1024


def kafka_read_options(
    servers: str, feed: str, start: str = "earliest", max_per_batch: int | None = None
) -> dict[str, str]:
    """Reader options: offsets live in the checkpoint, never in the broker."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": feed,
        "startingOffsets": start,
        "minPartitions": str(FEEDS[feed][0]) if feed in FEEDS else "1",
    }
    if max_per_batch:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def kafka_write_options(servers: str, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Acknowledged by all replicas, compressed, idempotent; `extra` adds or replaces options.

    The sink is at-least-once, so readers de-duplicate.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": "all",
        "kafka.compression.type": "snappy",
        "kafka.enable.idempotence": "true",
    }
    return options | (extra or {})


def read_feed(
    spark: SparkSession,
    feed: str,
    location: str | None = None,
    servers: str | None = None,
    start: str = "earliest",
    since: Column | None = None,
    max_per_batch: int | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Subscribe to a feed: columns key, value, topic, timestamp.

    With `servers` the feed is a Kafka topic, otherwise a folder
    `location/topic=<feed>`. `start="latest"` skips what is already there; a
    file feed has no offsets, so it takes the records from `since` on (default:
    now). `max_per_batch` limits records per trigger (files for a file feed).
    """
    if servers:
        reader = spark.readStream if streaming else spark.read
        options = kafka_read_options(servers, feed, start, max_per_batch)
        rows = reader.format("kafka").options(**options).load()
        return rows.select(
            F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp"
        )
    schema = "key string, value string, timestamp timestamp"
    path = f"{location}/topic={feed}"
    if streaming:
        reader = spark.readStream.schema(schema)
        if max_per_batch:
            reader = reader.option("maxFilesPerTrigger", max_per_batch)
        rows = reader.parquet(path)
    else:
        rows = spark.read.schema(schema).parquet(path)
    rows = rows.select("key", "value", F.lit(feed).alias("topic"), "timestamp")
    if start == "latest":
        moment = since if since is not None else F.lit(_now(spark))
        rows = rows.where(F.col("timestamp") >= moment)
    return rows


def _now(spark: SparkSession) -> object:
    return spark.range(1).select(F.current_timestamp()).first()[0]


def _record(df: DataFrame, names: dict[str, str]) -> Column:
    """The row as a JSON record with feed names; times as local ISO text."""
    back = {ours: theirs for theirs, ours in names.items()}
    fields = []
    for f in df.schema.fields:
        value = F.col(f.name)
        if f.dataType.typeName() == "timestamp":
            value = iso_text(value)
        fields.append(value.alias(back.get(f.name, f.name)))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_feed(df: DataFrame, feed: Column | str, at: Column | None = None) -> DataFrame:
    """Rows to (key, value, topic, timestamp); the key is the transaction id."""
    topic = F.lit(feed) if isinstance(feed, str) else feed
    names = {**schemas.REQUEST_NAMES, **schemas.RESULT_NAMES}
    return df.select(
        F.col("tx_id").alias("key"),
        _record(df, names).alias("value"),
        topic.alias("topic"),
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
    )


def write_feed(
    records: DataFrame,
    location: str | None = None,
    servers: str | None = None,
    options: dict[str, str] | None = None,
) -> None:
    """Append feed records: one write, whatever the number of topics.

    `options` go to the broker's producer.
    """
    if servers:
        records.select("key", "value", "topic").write.format("kafka").options(
            **kafka_write_options(servers, options)
        ).save()
    else:
        records.write.mode("append").partitionBy("topic").parquet(location)


def ingest_http_dump(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Landed request bodies, one JSON record per line, as feed values.

    Bodies over 20 MB are marked `too_large`; parsing sends them to the error
    path with their text in `raw`.
    """
    reader = spark.readStream if streaming else spark.read
    large = F.octet_length("value") > MAX_BODY_BYTES
    return reader.text(path).select("value", large.alias("too_large"))
