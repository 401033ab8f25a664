"""Rolling budgets, daily caps and per-user lists over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.operators.prefix import running_totals
from ledgerloom.operators.skew import top_k

MICROS = 1_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_usage(
    log: DataFrame,
    pool: str = "pool",
    ts: str = "ts",
    tokens: str = "tokens",
    window_seconds: int = S.RATE_WINDOW_SECONDS,
    budget: int = S.TOKEN_BUDGET,
) -> DataFrame:
    """Tokens used in the (t - window, t] before every request, and whether that is over budget.

    Requests of one moment are added up before they move. What is used at t is the
    pool's running total there less that at t - window, so each moment stands in one
    row of totals twice: with its tokens, and as a question one window back. Totals go
    through ranges of equal size, so a pool's burst is metered by many tasks. A request
    without a time has no usage.
    """
    timed = log.withColumn("__us", micros(ts))
    moments = timed.filter("__us is not null").groupBy(F.col(pool).alias("p"), F.col("__us").alias("us")).agg(F.sum(tokens).cast("bigint").alias("n"))
    reach = F.lit(window_seconds * MICROS)
    points = moments.select("p", F.col("us").alias("at"), F.lit(0).alias("asks"), "n")
    points = points.unionByName(moments.select("p", (F.col("us") - reach).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("n")))
    totals = running_totals(points, ["p"], ["at", "asks"], "n")
    asked = F.col("asks") == 1
    used = totals.groupBy("p", F.when(asked, F.col("at") + reach).otherwise(F.col("at")).alias("us")).agg(F.sum(F.when(asked, -F.col("total")).otherwise(F.col("total"))).alias("used"))
    metered = timed.join(used, F.col(pool).eqNullSafe(F.col("p")) & (F.col("__us") == F.col("us")), "left")
    return metered.withColumn("over_budget", F.col("used") > budget).drop("__us", "p", "us")


def daily_admission(log: DataFrame, ts: str = "ts", request: str = "request_id", cap: int = S.DAILY_CAP) -> DataFrame:
    """Marks the first ``cap`` requests of every UTC day as admitted.

    The day's last admitted request is found by a two-round top-k and compared
    with every row; the table of cut-offs has one row per calendar day.
    """
    dated = log.withColumn("day", F.to_date(F.col(ts).cast("timestamp")))
    first = top_k(dated.select("day", ts, request), ["day"], [F.col(ts), F.col(request)], cap, spread=[request])
    cutoff = first.groupBy("day").agg(F.max(F.struct(ts, request)).alias("__cutoff"))
    marked = dated.join(cutoff, "day")
    return marked.withColumn("admitted", F.struct(ts, request) <= F.col("__cutoff")).drop("__cutoff")


# --- per-user lists ------------------------------------------------------------------

def recent_items(log: DataFrame, keep: int = S.RECENT_ITEMS, user: str = "user_id", item: str = "item", ts: str = "ts") -> DataFrame:
    """The last ``keep`` distinct items of each user, newest first."""
    last = log.groupBy(user, item).agg(F.max(ts).alias("last_used"))
    return top_k(last, [user], [F.desc("last_used"), F.col(item)], keep, spread=[item])
