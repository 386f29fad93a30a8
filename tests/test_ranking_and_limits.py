"""Brute-force checks of the block-wise operators, with hot keys."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from dispatchlake.operators import metrics
from dispatchlake.operators.ranking import ordered_blocks, ranked
from dispatchlake.operators.ratelimit import delayed, rate_limit

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def traffic(spark, n, seconds, seed, hot=0.6):
    """Rows of three channels, most of them SMS, many at the same instant."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        channel = "SMS" if rnd.random() < hot else rnd.choice(["MMS", "RCS", None])
        us = rnd.choice([rnd.randrange(seconds * 1_000_000), 5_000_000])
        rows.append((f"t{i:06d}", channel, us, rnd.choice(["10000", "40003"])))
    df = spark.createDataFrame(rows, "tx_id string, channel string, us bigint, result_code string")
    return rows, df.withColumn("requested_at", F.timestamp_micros("us"))


def test_rank_is_exact_for_hot_and_null_keys(spark):
    rows, df = traffic(spark, 3000, 20, 1)
    blocks = ordered_blocks(df, ["channel"], ["us", "tx_id"])
    spread = blocks.where("channel = 'SMS'").select("_block").distinct().count()
    assert spread > 1, "the hot channel must span several blocks"
    got = {r.tx_id: r.k for r in ranked(df, ["channel"], ["us", "tx_id"], "k").collect()}
    groups = defaultdict(list)
    for tx, channel, us, _ in rows:
        groups[channel].append((us, tx))
    want = {tx: k for g in groups.values() for k, (_, tx) in enumerate(sorted(g))}
    assert got == want


@pytest.mark.parametrize("cap", [1, 3, 7, 50])
def test_rate_limit_equals_loop(spark, cap):
    rows, df = traffic(spark, 2000, 60, cap)
    got = {
        r.tx_id: r.us
        for r in rate_limit(df, cap).select("tx_id", F.unix_micros("release_at").alias("us")).collect()
    }
    want, sent = {}, defaultdict(list)
    for us, tx, channel in sorted((us, tx, ch) for tx, ch, us, _ in rows):
        past = sent[channel]
        release = us if len(past) < cap else max(us, past[-cap] + 1_000_000)
        past.append(release)
        want[tx] = release
    assert got == want
    for past in sent.values():
        for i in range(cap, len(past)):
            assert past[i] - past[i - cap] >= 1_000_000


def test_rate_limit_with_cap_per_channel(spark):
    _, df = traffic(spark, 500, 10, 9)
    cap = F.when(F.col("channel") == "SMS", 1000).otherwise(1)
    out = {r.channel: r for r in delayed(rate_limit(df, cap)).collect()}
    assert out["SMS"].n_delayed == 0 and out["MMS"].n_delayed > 0
    assert sum(r.n for r in out.values()) == 500


def test_sliding_success_equals_loop(spark):
    rows, df = traffic(spark, 1200, 300, 4)
    rows = [r for r in rows if r[1]]
    df = df.where("channel is not null")
    got = {
        r.tx_id: (r.window_total, r.window_success)
        for r in metrics.sliding_success(df, at="requested_at").collect()
    }
    for tx, channel, us, _ in rows[::7]:
        inside = [r for r in rows if r[1] == channel and us - 60_000_000 <= r[2] <= us]
        assert got[tx] == (len(inside), sum(r[3] == "10000" for r in inside))
    assert len(got) == len(rows)


def test_backlog_equals_loop(spark):
    rows, df = traffic(spark, 800, 100, 5)
    df = df.where("channel = 'SMS'")
    got = {r.second: r.backlog for r in metrics.burst_backlog(df, 6).collect()}
    arrivals = defaultdict(int)
    for _, channel, us, _ in rows:
        if channel == "SMS":
            arrivals[us // 1_000_000] += 1
    waiting, want = 0, {}
    for s in range(min(arrivals), max(arrivals) + 1):
        waiting = max(0, waiting + arrivals[s] - 6)
        if arrivals[s]:
            want[(EPOCH + timedelta(seconds=s)).replace(tzinfo=None)] = waiting
    assert {k.replace(tzinfo=None): v for k, v in got.items()} == want
    total = metrics.burst_check(df, 6).first()
    assert total.total == sum(arrivals.values()) and total.peak_backlog == max(want.values())


def test_backlog_and_success_cross_midnight(spark):
    """A backlog and a minute that begin on one day go on in the next, also over idle days."""
    start = 3 * 86_400 - 40
    seconds = [start + i // 9 for i in range(720)] + [start + 300 + 3 * 86_400] * 50
    rows = [(f"t{i}", ["SMS", None][i % 9 == 8], s * 1_000_000 + i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "tx_id string, channel string, us long").select(
        "tx_id", "channel", F.timestamp_micros("us").alias("requested_at"), F.lit("10000").alias("result_code")
    )
    for channel in ("SMS", None):
        arrivals = defaultdict(int)
        for _, c, us in rows:
            if c == channel:
                arrivals[us // 1_000_000] += 1
        waiting, want = 0, {}
        for s in range(min(arrivals), max(arrivals) + 1):
            waiting = max(0, waiting + arrivals[s] - 3)
            if arrivals[s]:
                want[s] = waiting
        backlog = metrics.burst_backlog(df, 3).where(F.col("channel").eqNullSafe(channel))
        got = {r.s: r.backlog for r in backlog.withColumn("s", F.unix_seconds("second")).collect()}
        assert got == want
    sms = [r for r in rows if r[1]]
    got = {r.tx_id: r.window_total for r in metrics.sliding_success(df, at="requested_at").collect()}
    assert got == {t: sum(us - 60_000_000 <= u <= us for _, _, u in sms) for t, _, us in sms}


def test_scans_run_inside_days(spark):
    """Windows over a whole channel see one row per day."""
    _, df = traffic(spark, 50, 100, 3)
    for out in (metrics.burst_backlog(df, 3), metrics.sliding_success(df, at="requested_at")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        alone = [w for w in plan.splitlines() if "Window [" in w and re.search(r"\], \[channel#\d+\], \[", w)]
        assert alone and all(re.search(r"\[day#\d+L? ASC", w) for w in alone)
