"""Send requests and delivery results derived from the `events` table.

The service has no data set of its own here, so every event becomes one request
and a deterministic arithmetic bucket decides each delivery attempt. All
columns are narrow projections of one event row: no shuffle, any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.codes import ADAPTER_VERSION
from dispatchlake.session import configure

BURST_US = 600 * 1_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .selectExpr(
            "event_id",
            "user_id",
            "dayofyear(ts) as day",
            "unix_micros(cast(ts as timestamp)) as us",
            "(event_id div 5) % 5 as ci",
        )
        .selectExpr(
            "event_id",
            "user_id",
            "us",
            "case ci when 0 then 'SMS' when 1 then 'MMS' when 2 then 'RCS' when 3 then 'FAX' else 'EMAIL' end as channel",
            """concat(lpad(us div 1000, 13, '0'),
                 if(event_id % 101 = 100, '09', concat('0', 1 + event_id % 5)),
                 lpad(day, 3, '0'), lpad(1 + user_id % 9, 3, '0'),
                 lpad(event_id, if(event_id % 97 = 96, 11, 14), '0')) as tx_id""",
            """if(ci = 4, concat('user', user_id, if(event_id % 41 = 40, '', '@example.com')),
                 concat(if(event_id % 43 = 42, '02', '010'), lpad(user_id, 8, '0'))) as receiver""",
            "'15881234' as sender",
            "if(ci = 1 and event_id % 7 = 0, 2.5D, 0.5D) as attachment_mb",
            "case event_id % 4 when 0 then 'CI' when 1 then 'AB_CAMPAIGN' when 2 then 'CRM' else 'DIRECT_API' end as source",
            "if(event_id % 5 < 2, us + (event_id % 3600) * 1000000, us) as due_us",
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One send request per event, in the request schema plus test keys.

    Multimedia requests carry 1-6 files; the last one has the size that counts.
    """
    return _base(spark, sf_dir).selectExpr(
        "event_id",
        "user_id",
        "concat('CUS', lpad(user_id, 10, '0')) as customer_id",
        "tx_id",
        "concat('REQ', event_id) as request_id",
        "channel",
        "cast(1 + event_id % 3 as int) as priority",
        "sender",
        "receiver",
        "if(channel in ('MMS', 'EMAIL') and event_id % 3 <> 0, concat('Notice ', event_id), '') as subject",
        "concat(repeat('안', cast(event_id % 50 as int)), ' notice') as body",
        """if(channel = 'MMS',
             transform(sequence(1, cast(1 + event_id % 6 as int)), i -> named_struct(
               'name', concat('file', i), 'size_mb', if(i = 1 + event_id % 6, attachment_mb, 0.5D))),
             cast(array() as array<struct<name:string,size_mb:double>>)) as attachments""",
        "if(event_id % 5 < 2, timestamp_micros(due_us), null) as scheduled_at",
        "timestamp_micros(us) as requested_at",
        "source",
        """named_struct('campaignId', if(source = 'AB_CAMPAIGN', concat('CAMP_', event_id % 12), null),
             'templateId', concat('TPL', lpad(event_id % 7, 4, '0')), 'retryCount', 0) as meta""",
    )


# Share of outcomes per channel, as upper bounds on a bucket 0..999.
OUTCOMES = {
    "SMS": [(950, "10000"), (970, "50001"), (970, "50001"), "40003"],
    "MMS": [(930, "10000"), (950, "50001"), (950, "50001"), "40003"],
    "RCS": [(70, "50002"), (970, "10000"), (980, "50001"), "40003"],
    "FAX": [(850, "10000"), (910, "50003"), (950, "40006"), "40005"],
    "EMAIL": [(980, "10000"), (988, "40007"), (992, "40008"), "50004"],
}


def _outcome(rule: str, n: str) -> str:
    """Code of attempt `n` under a rule struct (bounds x, codes k)."""
    b = f"(event_id * 7919 + 13 + {n} * 331) % 1000"
    steps = " + ".join(f"if({b} >= {rule}.x[{i}], 1, 0)" for i in range(3))
    return f"coalesce(forced, {rule}.k[{steps}])"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery attempt of the requests with a usable id.

    A 5xxxx outcome leads to the next attempt, up to four; rich messages that
    are not supported continue on SMS. Most messages need one attempt; only
    the others fold over the attempt numbers.
    """
    rules = ", ".join(
        f"'{c}', named_struct('x', array({', '.join(str(x) for x, _ in r[:3])}),"
        f" 'k', array({', '.join(repr(k) for _, k in r[:3])}, {r[3]!r}))"
        for c, r in OUTCOMES.items()
    )
    rule = f"element_at(map({rules}), if(array_contains(seen, '50002'), 'SMS', channel))"
    chain = f"""aggregate(sequence(1, 3), array(c0), (seen, n) ->
        if(element_at(seen, -1) like '5%', array_append(seen, {_outcome(rule, "n")}), seen))"""
    df = (
        _base(spark, sf_dir)
        .where("event_id % 97 <> 96 and event_id % 101 <> 100")  # usable ids
        .selectExpr(
            "*",
            """case when channel = 'MMS' and attachment_mb > 2.0 then '40004'
                 when channel = 'EMAIL' and not contains(receiver, '@') then '40001'
                 when event_id % 89 = 88 then '50001' end as forced""",
            f"element_at(map({rules}), channel) as own",
        )
        .selectExpr("*", f"{_outcome('own', '0')} as c0")
        .selectExpr("*", f"if(c0 like '5%', {chain}, array(c0)) as codes")
        .selectExpr("*", "array_position(codes, '50002') as moved")
        # outer: the plain form adds an emptiness filter that computes the chain twice
        .selectExpr("*", "posexplode_outer(codes) as (retry_count, result_code)")
    )
    return df.selectExpr(
        "event_id",
        "user_id",
        "tx_id",
        "if(moved > 0 and retry_count >= moved, 'SMS', channel) as channel",
        "receiver",
        "sender",
        "result_code",
        "retry_count",
        "source",
        """due_us + (event_id * 37 + retry_count * 11) % 900 * 1000
             + (shiftleft(1L, retry_count) - 1) * 30000000 as sent_us""",
        "cast((event_id * 53 + retry_count * 17) % 1000 as int) as elapsed_ms",
    ).selectExpr(
        "event_id",
        "user_id",
        "tx_id",
        "channel",
        "receiver",
        "sender",
        "case when result_code = '10000' then 'DELIVERED' when result_code like '5%' then 'RETRYING' else 'FAILED' end as status",
        "result_code",
        "if(result_code = '10000', null, concat('code ', result_code)) as error_detail",
        "retry_count",
        "source",
        "timestamp_micros(sent_us) as dispatched_at",
        "timestamp_micros(sent_us + elapsed_ms * 1000) as delivered_at",
        "elapsed_ms",
        f"'{ADAPTER_VERSION}' as adapter_version",
    )


def folded(at: Column) -> Column:
    """Fold a time into ten minutes, to get dense traffic out of sparse events."""
    return F.timestamp_micros(F.pmod(F.unix_micros(at), F.lit(BURST_US)))
