"""Input against output: counts, missing ids, equality of the two stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.codes import CONSISTENCY_FLOOR
from dispatchlake.functions import status, txid


def reconcile(req: DataFrame, res: DataFrame, floor: float = CONSISTENCY_FLOOR) -> DataFrame:
    """Distinct submitted and loaded ids, their ratio and the verdict (one row)."""
    valid = req.where(txid.is_valid(F.col("tx_id")))
    tagged = valid.select("tx_id", F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionAll(
        res.select("tx_id", F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    )
    per_id = tagged.groupBy("tx_id").agg(F.max("_in").alias("_in"), F.max("_out").alias("_out"))
    counts = per_id.agg(
        F.count_if(F.col("_in") == 1).alias("submitted"),
        F.count_if(F.col("_out") == 1).alias("loaded"),
        F.count_if((F.col("_in") == 1) & (F.col("_out") == 0)).alias("missing"),
        F.count_if((F.col("_in") == 0) & (F.col("_out") == 1)).alias("orphaned"),
    )
    return counts.withColumns(
        {
            "ratio": F.try_divide("loaded", "submitted"),
            "ok": (F.col("loaded") >= floor * F.col("submitted"))
            & (F.col("loaded") <= F.col("submitted")),
        }
    )


def retry_success(res: DataFrame) -> DataFrame:
    """Of the messages that ever needed a retry: delivered in the end, and loaded.

    "Loaded" counts those with any later result. The last attempt is the one
    with the highest number; number and outcome fit one integer, so the whole
    job is a partial and a final hash aggregate.
    """
    delivered = F.when(F.col("status") == "DELIVERED", 1).otherwise(0)
    per_id = res.groupBy("tx_id").agg(
        F.max(F.col("retry_count") * 2 + delivered).alias("_last"),
        F.max(F.when(status.is_retryable(F.col("result_code")), 1).otherwise(0)).alias("_retry"),
    )
    return (
        per_id.where("_retry = 1")
        .agg(
            F.count("*").alias("retried"),
            F.count_if(F.col("_last") % 2 == 1).alias("resolved"),
            F.count_if(F.col("_last") >= 2).alias("reloaded"),
        )
        .withColumns(
            {
                "resolved_share": F.try_divide("resolved", "retried"),
                "reloaded_share": F.try_divide("reloaded", "retried"),
            }
        )
    )


def submitted_except_loaded(req: DataFrame, res: DataFrame) -> DataFrame:
    """Ids put in but not loaded."""
    return req.select("tx_id").subtract(res.select("tx_id"))


def history_equals_docs(hist: DataFrame, docs: DataFrame) -> DataFrame:
    """Attempts that only one store has, or holds a different number of times.

    One signed count per attempt replaces a multiset difference in each
    direction. An empty result means that the stores agree.
    """
    keys = ["tx_id", "retry_count", "status"]
    sends = docs.select(F.explode("sends").alias("s")).select(
        F.col("s.txId").alias("tx_id"),
        F.col("s.retryCount").alias("retry_count"),
        F.col("s.status").alias("status"),
        F.lit(-1).alias("_d"),
    )
    rows = hist.select("tx_id", F.col("retry_count").cast("int").alias("retry_count"), "status")
    return (
        rows.withColumn("_d", F.lit(1))
        .unionByName(sends)
        .groupBy(*keys)
        .agg(F.sum("_d").alias("surplus"))
        .where("surplus <> 0")
        .withColumn("only_in", F.when(F.col("surplus") > 0, "history").otherwise("documents"))
    )
