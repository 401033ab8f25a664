"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.session import remove_folder, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a cluster without that setting is an error."""
    return shared_folder(spark, f"llm/{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``written`` made; nothing may read it any more."""
    for df in tables:
        path = vars(df).get("written_to") if df is not None else None
        if path:
            remove_folder(df.sparkSession, path)


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that later filters and projections reuse their values."""
    row = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(row))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Positions from 0 in a total order, without one task that sees every row.

    Rows are dealt into ranges and written; each range is numbered by itself and
    shifted by the sizes of the ranges before it (one small row per range).
    """
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = written(dealt, "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    joined = ranges.withColumn("__inside", inside).join(starts, "__range")
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).drop("__range", "__inside", "__start")


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of a text column each; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
