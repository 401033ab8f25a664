"""Streaming jobs over filings, chunks and request logs.

Every job takes a streaming DataFrame and returns a started query. Requests in
a log carry (request_id, ts, …); rows later than the watermark are dropped.
``once`` processes what there is and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom import settings as S
from ledgerloom.operators.history import by_forms
from ledgerloom.operators.metering import MICROS, micros
from ledgerloom.operators.skew import best_row, salts_of, top_k, with_halo
from ledgerloom.session import remove_folder, shared_folder
from ledgerloom.sources.keyed import KeyedTable, read_or_empty
from ledgerloom.sources.sinks import insert_analyses
from ledgerloom.streaming.state import InOrder, RollingMeter

# How late a request may come.
LATENESS = "10 minutes"


def read_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).foreachBatch(work)


def _replace_batch(rows: DataFrame, path: str, batch: int, *by: str) -> None:
    """Write the output of one micro-batch; a repeated batch replaces itself."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by, "batch").parquet(path)


def ingest_analyses(stream: DataFrame, path: str, checkpoint: str, order: list[Column], once: bool = False) -> StreamingQuery:
    """Store one analysis per filing, ever."""
    return _start(_each_batch(stream, lambda rows, _: insert_analyses(rows, path, order, returns=False)), checkpoint, once)


COVERAGE = "accession_number string, state string, chunks_indexed bigint, chunks_total bigint, batch bigint"


def track_coverage(chunks: DataFrame, schedule: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Chunks stored so far per filing, joined to the schedule on every micro-batch.

    No state is kept: what a micro-batch brings is added to the counts published for
    its filings, which the table's index finds. A filing may gain chunks at any time,
    and one that is complete costs nothing. A repeated batch adds to what was published
    before it and says the same again.
    """
    def publish(rows: DataFrame, batch: int) -> None:
        table = _coverage(rows.sparkSession, path)
        folder = shared_folder(rows.sparkSession, "coverage")
        rows.groupBy("accession_number").agg(F.count(F.lit(1)).alias("n")).write.parquet(folder)
        added = rows.sparkSession.read.schema("accession_number string, n bigint").parquet(folder)
        earlier = table.matching(added).filter(F.col("batch") < batch)
        earlier = earlier.groupBy(F.col("accession_number").alias("a")).agg(F.max("chunks_indexed").alias("before"))
        stored = added.join(earlier, F.col("accession_number").eqNullSafe(F.col("a")), "left")
        stored = stored.select("accession_number", (F.coalesce("before", F.lit(0)) + F.col("n")).alias("stored"))
        known = schedule.join(added.select("accession_number"), "accession_number", "left_semi")
        joined = stored.join(known, "accession_number", "left")
        state = F.when(F.coalesce(F.col("running"), F.lit(False)), "indexing").otherwise("complete")
        total = F.coalesce(F.col("chunks_total").cast("bigint"), F.col("stored"))
        out = joined.select(
            "accession_number", state.alias("state"), F.col("stored").alias("chunks_indexed"), total.alias("chunks_total"),
            F.lit(batch).cast("bigint").alias("batch"),
        )
        table.append(out, added.count())
        remove_folder(rows.sparkSession, folder)

    return _start(_each_batch(chunks.select("accession_number"), publish), checkpoint, once)


def _coverage(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, COVERAGE, ["accession_number"])


def latest_coverage(spark: SparkSession, path: str, filings: DataFrame | None = None) -> DataFrame:
    """The newest published state of every filing, or of some (accession_number)."""
    table = _coverage(spark, path)
    rows = table.rows() if filings is None else table.matching(filings)
    return best_row(rows, ["accession_number"], [F.col("batch")]).drop("batch")


def closing_mark(spark: SparkSession, log: DataFrame, path: str, lateness: str = LATENESS) -> DataFrame:
    """A stream of one row without a request that lies so far after ``log`` that the watermark passes all of it.

    To be united with the stream of the log: the end of a log, or a heartbeat of one
    that is idle.
    """
    after = F.max(F.col("ts").cast("timestamp")) + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 second")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in log.dtypes if name != "ts"]
    log.agg(after.alias("ts")).select(*none, "ts").select(*log.columns).write.mode("append").parquet(path)
    return read_table(spark, path, spark.read.parquet(path).schema)


def meter_usage(
    log: DataFrame,
    path: str,
    checkpoint: str,
    window_seconds: int = S.RATE_WINDOW_SECONDS,
    budget: int = S.TOKEN_BUDGET,
    bucket_seconds: int | None = None,
    lateness: str = LATENESS,
    once: bool = False,
) -> StreamingQuery:
    """Rolling tokens per pool, each request given out once the watermark has passed it.

    Requests may come in any order within the lateness. State is kept per pool and
    time bucket, so a busy pool is spread, and ends with the bucket.
    """
    bucket_seconds = bucket_seconds or 4 * window_seconds
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    timed = timed.select("pool", "request_id", "tokens", "ts", micros("ts").alias("us"))
    placed = with_halo(timed, F.col("us"), window_seconds * MICROS, bucket_seconds * MICROS)
    keyed = placed.withColumnsRenamed({"__bucket": "bucket", "__home": "home"})
    metered = keyed.groupBy("pool", "bucket").transformWithStateInPandas(
        RollingMeter(window_seconds * MICROS, budget),
        "pool string, request_id bigint, us bigint, used bigint, over_budget boolean",
        "append",
        "EventTime",
    )
    return _start(metered.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, once)


def admit_daily(
    log: DataFrame, path: str, checkpoint: str, cap: int = S.DAILY_CAP, lateness: str = LATENESS, once: bool = False
) -> StreamingQuery:
    """Stores the first ``cap`` requests of every UTC day, by their time and not by their arrival.

    A request waits until the watermark has passed it, so none can come before it any
    more. Waiting is keyed by day and a salt, each holding at most ``cap`` requests, and
    ends with the day. What a micro-batch gives out is later than all before it; it is
    cut to the places that are left.
    """
    salts = salts_of(log)
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    keyed = timed.select(
        F.when(F.col("request_id").isNotNull(), F.to_date("ts")).alias("day"), F.pmod(F.xxhash64("request_id"), F.lit(salts)).alias("salt"),
        "request_id", "ts", micros("ts").alias("us"),
    )
    ordered = keyed.groupBy("day", "salt").transformWithStateInPandas(InOrder(cap), "day date, request_id bigint, us bigint", "append", "EventTime")

    def admit(rows: DataFrame, batch: int) -> None:
        timed = rows.withColumn("ts", F.timestamp_micros("us")).drop("us")
        first = top_k(timed, ["day"], [F.col("ts"), F.col("request_id")], cap, spread=["request_id"], rank="place")
        # One folder per day with at most ``cap`` requests.
        earlier = read_or_empty(rows.sparkSession, path, "day date, batch int").filter(F.col("batch") < batch)
        taken = earlier.join(rows.select("day").distinct(), "day", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("taken"))
        open_places = cap - F.coalesce(F.col("taken"), F.lit(0))
        admitted = first.join(taken, "day", "left").filter(F.col("place") <= open_places).drop("taken", "place")
        _replace_batch(admitted, path, batch, "day")

    return _start(_each_batch(ordered, admit), checkpoint, once)


def alert_new_filings(
    filings: DataFrame, analyses: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Filings newer than the company's last created analysis.

    ``analyses`` gives the analyses of companies (cik), as ``KeyedTable.matching`` does.
    It is called for every micro-batch, so it sees what was stored since, and reads the
    files of the batch's companies only.
    """

    def alert(rows: DataFrame, batch: int) -> None:
        asked = analyses(rows.select("cik"))
        newest = asked.groupBy("cik").agg(F.max_by("filing_date", F.struct("created_at", "id")).alias("analyzed_filing"))
        joined = by_forms(rows).join(newest, "cik", "left")
        newer = F.col("analyzed_filing").isNull() | (F.col("filing_date") > F.col("analyzed_filing"))
        _replace_batch(joined.filter(newer), path, batch)

    return _start(_each_batch(filings, alert), checkpoint, once)
