"""From delivery results to history, metrics, retries and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import txid
from dispatchlake.operators.metrics import minute_metrics
from dispatchlake.operators.routing import dead_letters, plan_retries, route_results


def settle_results(res: DataFrame) -> dict[str, DataFrame]:
    """All outputs of a set of results, each attempt counted once.

    Keys: history, metrics, retry, dlq, errors. Each is a lazy plan over the
    same de-duplicated results; write the de-duplicated table first when more
    than one output is needed at scale.
    """
    once = txid.once_per_attempt(res)
    routed = route_results(once)
    good = routed.where("route <> 'error'").drop("route", "level")
    return {
        "history": good,
        "metrics": minute_metrics(good),
        "retry": plan_retries(good),
        "dlq": dead_letters(once, F.col("delivered_at")),
        "errors": routed.where("route = 'error'"),
    }
