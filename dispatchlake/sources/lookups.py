"""Message store: the history in one layout per look-up, so that a look-up opens few files.

One commit (`streaming.commits`) adds a batch to all layouts. Each is ranged by a
64-bit hash of its key, and the manifest keeps that range for each file: a look-up
opens about one file of each segment, and a table of any age has few segments. A
key with very many rows (a hot receiver or customer) spans several files.

A later batch's row of an attempt replaces the earlier one when rows are read; a
late result is therefore a small segment of its own, and nothing stored before is
rewritten for it but by the merge of equal levels. Rows with a bad id are
copies only if they are equal in all columns. Null keys are stored and counted,
and are found by no look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.codes import BUSINESS_ZONE
from dispatchlake.functions import txid
from dispatchlake.functions.times import year_month
from dispatchlake.operators import documents, history
from dispatchlake.session import scratch_scope, stage
from dispatchlake.streaming.commits import Commits, Layout

KEY = "_key"
BATCH = "_batch"
ADDED = [KEY, BATCH, txid.RECORD]
# what a list of messages shows; the full row is found by its id
LISTED = [
    "tx_id",
    "retry_count",
    "channel",
    "sender",
    "receiver",
    "status",
    "result_code",
    "requested_at",
    "dispatched_at",
    "delivered_at",
]
TABLES = {
    "by_tx": Layout(index=KEY, order=("tx_id", "retry_count")),
    "by_receiver": Layout(index=KEY, order=("receiver", "requested_at")),
    "by_customer": Layout(index=KEY, order=("customer_id", "requested_at")),
    "by_status": Layout(by=("status", "channel"), order=("delivered_at",)),
}
KEY_COLUMNS = {"by_tx": "tx_id", "by_receiver": "receiver", "by_customer": "customer_id"}
# documents looked up by file; with more customers the table is joined as a whole
MANY_CUSTOMERS = 100


def _key(value: Column) -> Column:
    return F.xxhash64(value)


def _key_of(spark: SparkSession, value: str) -> int:
    return spark.range(1).select(_key(F.lit(value))).first()[0]


def add_messages(
    hist: DataFrame, path: str, batch_id: int, tables: tuple[str, ...] = tuple(TABLES)
) -> bool:
    """Add history rows (`history_rows`) to all layouts, or to some, in one commit.

    The rows are read once per layout and are stored first if there are several.
    False if the batch is there already. Batch numbers grow; one writer at a time.
    """
    spark = hist.sparkSession
    batch = Commits(spark, path, TABLES).batch(batch_id)
    if batch is None:
        return False
    with scratch_scope(spark):
        rows = txid.with_record(hist).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        if len(tables) > 1:
            rows = stage(rows, "messages")
        for name in tables:
            batch.append(name, _laid_out(rows, name))
            batch.merge(name)
    batch.commit()
    return True


def _laid_out(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a layout."""
    if table in ("by_receiver", "by_status"):
        rows = rows.select(*LISTED, BATCH, txid.RECORD)
    return rows.withColumn(KEY, _key(F.col(KEY_COLUMNS[table]))) if table in KEY_COLUMNS else rows


def _newest(rows: DataFrame) -> DataFrame:
    """Of each attempt the row of the latest batch."""
    kept = [c for c in rows.columns if c not in ADDED]
    order = F.struct(BATCH, "delivered_at", "result_code")
    newest = rows.groupBy(*txid.ATTEMPT).agg(F.max_by(F.struct(*kept), order).alias("_r"))
    return newest.select("_r.*")


def _rows(spark: SparkSession, path: str, table: str, points: list[int] | None = None) -> DataFrame:
    return Commits(spark, path).read(table, points=points)


def by_tx(spark: SparkSession, path: str, tx_id: str) -> DataFrame:
    """The whole path of one message."""
    rows = _rows(spark, path, "by_tx", [_key_of(spark, tx_id)]).where(F.col("tx_id") == tx_id)
    return history.history_by_tx(_newest(rows), tx_id)


def by_receiver(spark: SparkSession, path: str, receiver: str, limit: int | None = None) -> DataFrame:
    """A receiver's sends (LISTED columns), newest first."""
    rows = _rows(spark, path, "by_receiver", [_key_of(spark, receiver)])
    return history.history_by_receiver(_newest(rows.where(F.col("receiver") == receiver)), receiver, limit)


def in_status(
    spark: SparkSession, path: str, wanted: str = "RETRYING", channel: str | None = None
) -> DataFrame:
    """Attempts in a status (LISTED columns), optionally of one channel: only its folders are read.

    An attempt that a later batch gave another status is listed under both.
    """
    return _newest(history.retry_candidates(_rows(spark, path, "by_status"), wanted, channel))


def customer_documents(
    spark: SparkSession,
    path: str,
    customers: list[str],
    zone: str = BUSINESS_ZONE,
    max_sends: int = documents.MAX_SENDS,
    months: tuple[str, str] | None = None,
) -> DataFrame:
    """Customer-month documents of a few customers, with all that came in so far.

    `months` is a range of YYYYMM, inclusive.
    """
    keys = [_key_of(spark, c) for c in customers]
    rows = _rows(spark, path, "by_customer", keys).where(F.col("customer_id").isin(customers))
    if months:
        rows = rows.where(year_month(F.col("requested_at"), zone).between(*months))
    return documents.customer_month_docs(_newest(rows), zone, max_sends)


def customer_history(
    spark: SparkSession, path: str, customer_id: str, first: str, last: str, zone: str = BUSINESS_ZONE
) -> DataFrame:
    """One customer's sends over a range of months (YYYYMM, inclusive)."""
    docs = customer_documents(spark, path, [customer_id], zone, months=(first, last))
    return documents.customer_history(docs, customer_id, first, last)


def documents_with(
    spark: SparkSession,
    path: str,
    tx_id: str,
    zone: str = BUSINESS_ZONE,
    max_sends: int = documents.MAX_SENDS,
) -> DataFrame:
    """The documents that hold a message, with only its sends.

    The message's rows name its customers; their files are read. An id that more
    than `MANY_CUSTOMERS` share (a bad one) is searched in all documents instead.
    """
    found = by_tx(spark, path, tx_id).where("customer_id is not null")
    names = found.select("customer_id").distinct().limit(MANY_CUSTOMERS + 1).collect()
    if len(names) > MANY_CUSTOMERS:
        rows = _newest(_rows(spark, path, "by_customer"))
        docs = documents.customer_month_docs(rows, zone, max_sends)
    else:
        docs = customer_documents(spark, path, [r.customer_id for r in names], zone, max_sends)
    return documents.find_send_in_docs(docs, tx_id)
