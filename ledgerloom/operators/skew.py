"""Building blocks that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

def salts_of(df: DataFrame) -> int:
    """As many salts as shuffle partitions, which ``session.size_shuffles`` sets by the size of the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, numbered from 1.

    Two rounds: the winners of each (key, salt) first, so that the rows of a hot
    key are sorted by many tasks, then at most ``k * salts`` rows per key.
    ``spread`` names the columns (a row id, usually) that the salt is taken from.
    Spark cuts groups before the shuffle for a ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); for a greater one the salts
    alone keep a hot key from one task.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts or salts_of(df))))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    local = salted.withColumn("__local", F.row_number().over(first)).filter(F.col("__local") <= k)
    final = Window.partitionBy(*keys).orderBy(*order)
    ranked = local.drop("__local", "__salt").withColumn(rank, F.row_number().over(final))
    return ranked.filter(F.col(rank) <= k)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` of every key, combined before the shuffle.

    ``order`` must be unique within a key. Aggregates instead of a window, so a
    hot key sends one candidate per task.
    """
    rest = [c for c in df.columns if c not in keys]
    winner = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(winner).select(*keys, "__row.*")


def with_halo(df: DataFrame, at: Column, reach: int, bucket: int) -> DataFrame:
    """Copy each row into its bucket of ``at`` and, near the end, into the next one.

    Adds ``__bucket`` and ``__home``. A look-back of up to ``reach`` (<= ``bucket``)
    units can then be taken per (key, bucket) and only the home rows kept, so one
    key is worked on by as many tasks as it has buckets.
    """
    if reach > bucket:
        raise ValueError("the look-back must fit in one bucket")
    home = F.floor(at / F.lit(bucket)).cast("bigint")
    spill = (at + F.lit(reach)) >= (home + 1) * F.lit(bucket)
    own = F.struct(home.alias("b"), F.lit(True).alias("h"))
    copy = F.struct((home + 1).alias("b"), F.lit(False).alias("h"))
    places = F.when(spill, F.array(own, copy)).otherwise(F.array(own))
    return (
        df.withColumn("__place", F.explode(places))
        .withColumn("__bucket", F.col("__place.b"))
        .withColumn("__home", F.col("__place.h"))
        .drop("__place")
    )
