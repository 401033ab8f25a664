"""Running totals in a total order, whatever the sizes of keys and bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import kept


def ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (keys, order) of about equal size, written, with the number of the range in ``__range``."""
    return kept(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` up to each row of its key, the row included.

    Two levels: ranges add up their own rows, and carry on from the sums of the key's
    ranges before them, one small row each. So one key, or one second of it, is worked
    on by as many tasks as its rows fill ranges. Rows alike in ``order`` may stand in
    any order; add them up before where that matters.
    """
    keys = list(keys)
    dealt = ranges(rows, keys, order)
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("__range") == F.col("__r")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return own.join(carried, same).select(*rows.columns, (F.col("__own") + F.col("__carried")).alias(name))
