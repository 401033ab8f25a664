import datetime as dt
import random

from pyspark.sql import functions as F
import pytest

from ledgerloom.functions import outcomes
from ledgerloom.operators import metering as ops, prefix

START = dt.datetime(2024, 1, 1)


def log(spark, seed, n=400, span=4000, pools=3):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(span)), "hot" if rng.random() < 0.5 else f"p{rng.randrange(pools)}", rng.randrange(1, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "request_id int, ts timestamp, pool string, tokens int")


@pytest.mark.parametrize("seed", [60, 100, 10**6])
def test_rolling_usage_against_brute_force(spark, seed):
    rows, frame = log(spark, seed)
    found = {r.request_id: (r.used, r.over_budget) for r in ops.rolling_usage(frame, budget=200).collect()}
    assert len(found) == len(rows)
    for i, ts, pool, _ in rows:
        used = sum(t for _, at, p, t in rows if p == pool and ts - dt.timedelta(seconds=60) < at <= ts)
        assert found[i] == (used, used > 200)


def test_usage_of_nulls_and_equal_moments(spark):
    rows = [(1, START, None, 5), (2, START, None, 6), (3, None, "a", 7), (4, START, "a", None), (5, START + dt.timedelta(seconds=60), None, 1)]
    frame = spark.createDataFrame(rows, "request_id int, ts timestamp, pool string, tokens int")
    found = {r.request_id: r.used for r in ops.rolling_usage(frame).collect()}
    assert found == {1: 11, 2: 11, 3: None, 4: 0, 5: 1}
    assert ops.rolling_usage(frame.limit(0)).count() == 0


def test_a_burst_is_many_tasks(spark):
    """A third of the log in one second of one pool still fills as many ranges as its rows."""
    spread = spark.range(20000).select((F.col("id") % 7).cast("string").alias("pool"), (F.col("id") * 90_000).alias("us"), F.lit(1).alias("n"))
    burst = spark.range(10000).select(F.lit("0").alias("pool"), (F.lit(500_000_000) + F.col("id") * 90).alias("us"), F.lit(1).alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spread.unionByName(burst)
        sizes = sorted(r["count"] for r in prefix.ranges(rows, ["pool"], ["us"]).groupBy("__range").count().collect())
        groups = prefix.ranges(rows, ["pool"], ["us"]).filter("pool = '0' and us between 500000000 and 501000000").select("__range").distinct().count()
        totals = prefix.running_totals(rows, ["pool"], ["us"], "n").filter("pool = '0'").orderBy("us").select("total").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and groups >= 5
    assert [r.total for r in totals] == list(range(1, len(totals) + 1))


def test_daily_admission_resets_at_midnight(spark):
    rows = [(i, START + dt.timedelta(hours=6 * i)) for i in range(8)] + [(100, START), (101, START)]
    frame = spark.createDataFrame(rows, "request_id int, ts timestamp")
    admitted = {r.request_id for r in ops.daily_admission(frame, cap=3).filter("admitted").collect()}
    assert admitted == {0, 100, 101, 4, 5, 6}


def test_recent_items(spark):
    rows = [("u", item, i) for i, item in enumerate("abcabdefg")] + [("v", "a", 1)]
    recent = ops.recent_items(spark.createDataFrame(rows, "user_id string, item string, ts int"))
    assert [r.item for r in recent.filter("user_id = 'u'").orderBy("rank").collect()] == ["g", "f", "e", "d", "b"]


@pytest.mark.parametrize("source, code, message, kind, again", [
    ("model", 429, "x", "quota", False), ("model", 503, "x", "overloaded", True), ("embedding", 503, "x", "quota", True),
    ("embedding", 429, "Quota exceeded for metric: a/b_requests, limit", "daily_quota", False),
    ("embedding", 429, "quota exceeded for metric: a/b_input_token_count", "quota", True),
    ("model", None, "ConnectError: refused", "transient", True), ("model", 500, "x", "error", False),
    ("fetch", 403, None, "fetch", True), ("fetch", 404, None, "fetch", False), ("model", 200, None, None, False), ("model", None, None, None, False),
])
def test_error_classes(one, source, code, message, kind, again):
    source, code, message = F.lit(source), F.lit(code).cast("int"), F.lit(message).cast("string")
    found = outcomes.error_class(source, code, message)
    assert one(found, x=1) == kind
    assert one(outcomes.retryable(source, code, found), x=1) is again


@pytest.mark.parametrize("message, seconds", [('"retryDelay": "38s"', 38.0), ("retryDelay=1.5s", 1.5), ("'retryDelay': '500s'", 120.0), ("later", None)])
def test_retry_delay(one, message, seconds):
    assert one(outcomes.retry_seconds(F.lit(message)), x=1) == seconds
