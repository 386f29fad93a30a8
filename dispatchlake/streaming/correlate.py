"""Requests met by their results: an interval join over stored tables.

Open requests lie in a table indexed by the time they close, results in one indexed
by delivery; both are keyed by id. A micro-batch joins its new requests with the
stored results and its new results with all open requests, as plain equi-joins that
the planner broadcasts or splits on measured size. Which requests were answered and
which results found a request is kept beside them, under the same times. When the
watermark passes a time, the rows of that time close: unanswered requests are
missing, unmatched results are late. Files of passed times are forgotten, so the
tables hold the horizon; output and state are one commit (`commits`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dispatchlake.functions import txid
from dispatchlake.operators.ranking import same
from dispatchlake.session import scratch_scope, stage
from dispatchlake.streaming.commits import Batch, Layout, in_one_commit, stored
from dispatchlake.streaming.runs import for_each

DELAY = "10 minutes"
CLOSES, DELIVERED = "closes_us", "delivered_us"
REQUEST_KEY = ["tx_id", CLOSES]
RESULT_KEY = ["tx_id", "retry_count", DELIVERED]

TABLES = {
    "out": Layout(),
    "requests": Layout(index=CLOSES),
    "answered": Layout(index=CLOSES),
    "results": Layout(index=DELIVERED),
    "matched": Layout(index=DELIVERED),
}


def _struct(**columns: str) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


REQUESTS = _struct(tx_id="string", request_id="string", requested_us="long", closes_us="long")
RESULTS = _struct(
    tx_id="string", retry_count="integer", result_code="string", status="string", delivered_us="long"
)
OUT = [
    "tx_id", "request_id", "requested_us", "retry_count", "result_code", "status", DELIVERED,
    "missing", "late",
]


def _micros(spark: SparkSession, span: str) -> int:
    seconds = spark.range(1).select(F.expr(f"interval {span}").cast("interval day to second"))
    return int(seconds.first()[0].total_seconds() * 1_000_000)


def _events(req: DataFrame, res: DataFrame, horizon: str) -> DataFrame:
    """Both feeds as one stream: a request or a result per row."""
    due = F.greatest("requested_at", "scheduled_at")
    asked = F.struct(
        "tx_id",
        F.col("request_id").cast("string").alias("request_id"),
        F.unix_micros("requested_at").alias("requested_us"),
        F.unix_micros(due + F.expr(f"interval {horizon}")).alias(CLOSES),
    )
    back = F.struct(
        "tx_id",
        F.col("retry_count").cast("int").alias("retry_count"),
        "result_code",
        "status",
        F.unix_micros("delivered_at").alias(DELIVERED),
    )
    requests = req.select(asked.alias("request"), F.lit(None).cast(RESULTS).alias("result"))
    return requests.unionByName(
        res.select(F.lit(None).cast(REQUESTS).alias("request"), back.alias("result"))
    )


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of the rows that share a key; partly aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_least")
    return rows.groupBy(*keys).agg(least).select(*keys, "_least.*").select(*rows.columns)


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other, same(rows, other, keys), "left_anti")


def _meets(requests: DataFrame, results: DataFrame) -> DataFrame:
    within = F.col(DELIVERED).between(F.col("requested_us"), F.col(CLOSES))
    return requests.join(results, "tx_id").where(within)


def _as_out(rows: DataFrame, missing: bool, late: bool) -> DataFrame:
    types = {f.name: f.dataType for f in [*REQUESTS.fields, *RESULTS.fields]}
    columns = [
        F.col(c) if c in rows.columns else F.lit(None).cast(types[c]).alias(c) for c in OUT[:-2]
    ]
    return rows.select(*columns, F.lit(missing).alias("missing"), F.lit(late).alias("late"))


def correlate_stream(
    req: DataFrame,
    res: DataFrame,
    path: str,
    checkpoint: str,
    horizon: str = "1 hour",
    delay: str = DELAY,
    every: str | None = None,
) -> StreamingQuery:
    """Requests with their results; `correlated` reads the rows.

    A result belongs to the request of its id if it came between the request and
    `horizon` after it was due, so a message may be scheduled any time ahead. A
    request that closes without one is `missing`; a result that finds none is a row
    of its own, `late`. Rows close when the watermark (`delay` behind the slower
    feed) passes their time; none is dropped for being late. Of copies (requests
    of an id that is open, results of an id and count) the first stays. Rows with a
    bad id match nothing and leave at once, each of them.
    """
    spark = req.sparkSession
    delay_us = _micros(spark, delay)

    def step(rows: DataFrame, batch: Batch) -> None:
        with scratch_scope(rows.sparkSession):
            _correlate(rows, batch, delay_us)

    events = _events(req, res, horizon)
    return for_each(events, in_one_commit(path, TABLES, step), checkpoint, every=every)


def _correlate(rows: DataFrame, batch: Batch, delay_us: int) -> None:
    read, state = batch.commits.read, batch.state
    before = state.get("watermark_us", 0)
    events = stage(rows, "events")
    arrived_req = events.where("request is not null").select("request.*")
    arrived_res = events.where("result is not null").select("result.*")
    times = [F.max("request.requested_us"), F.max(f"result.{DELIVERED}")]
    for name, last in zip(("requested", "delivered"), events.agg(*times).first(), strict=True):
        state[name] = max((t for t in (state.get(name), last) if t is not None), default=None)
    if state["requested"] is not None and state["delivered"] is not None:
        state["watermark_us"] = max(before, min(state["requested"], state["delivered"]) - delay_us)
    now = state.get("watermark_us", before)

    usable = F.coalesce(txid.is_valid(F.col("tx_id")), F.lit(False))
    # a row without a time could close never; it leaves at once too
    req_ok, res_ok = usable & F.col(CLOSES).isNotNull(), usable & F.col(DELIVERED).isNotNull()
    open_req = read("requests", REQUESTS, before).where(F.col(CLOSES) > before)
    open_res = read("results", RESULTS, before).where(F.col(DELIVERED) > before)
    new_req = _first(arrived_req.where(req_ok), ["tx_id"], ["requested_us", "request_id"])
    new_req = stage(_without(new_req, open_req, ["tx_id"]), "new-requests")
    new_res = _first(arrived_res.where(res_ok), RESULT_KEY[:2], [DELIVERED, "result_code"])
    new_res = stage(_without(new_res, open_res, RESULT_KEY[:2]), "new-results")

    met = _meets(open_req.unionByName(new_req), new_res).unionByName(_meets(new_req, open_res))
    met = stage(met, "met")
    answered, matched = met.select(*REQUEST_KEY).distinct(), met.select(*RESULT_KEY)
    key_types = {"answered": answered.schema, "matched": matched.schema}

    def known(table: str, new: DataFrame) -> DataFrame:
        return read(table, key_types[table], before, now).unionByName(new)

    shut_req = open_req.unionByName(new_req).where(F.col(CLOSES) <= now)
    missing = _without(shut_req, known("answered", answered), REQUEST_KEY)
    shut_res = open_res.unionByName(new_res).where(F.col(DELIVERED) <= now)
    late = _without(shut_res, known("matched", matched), RESULT_KEY)
    out = _as_out(met, False, False)
    for part in (missing, arrived_req.where(~req_ok)):
        out = out.unionByName(_as_out(part, True, False))
    for part in (late, arrived_res.where(~res_ok)):
        out = out.unionByName(_as_out(part, False, True))
    batch.append("out", out)
    stays = {"requests": new_req, "answered": answered, "results": new_res, "matched": matched}
    for table, new in stays.items():
        index = TABLES[table].index
        batch.append(table, new.where(F.col(index) > now))
        batch.drop(table, now)
        batch.merge(table, F.col(index) > now)


def correlated(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a `correlate_stream` so far."""
    rows = stored(spark, path, "out")
    return rows.select(
        "tx_id",
        "request_id",
        F.timestamp_micros("requested_us").alias("requested_at"),
        "retry_count",
        "result_code",
        "status",
        F.timestamp_micros(DELIVERED).alias("delivered_at"),
        "missing",
        "late",
    )
