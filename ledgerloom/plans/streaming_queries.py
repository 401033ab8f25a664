"""The streaming jobs, run to the end of the driver tables, beside their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.functions import documents as fn
from ledgerloom.operators import documents as docs
from ledgerloom.plans import vehicles as V
from ledgerloom.plans.document_queries import _STORED
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_folder
from ledgerloom.sources.keyed import KeyedTable
from ledgerloom.streaming import jobs


def _stream(spark, sf, name) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = V.table(spark, sf, name).schema
    # The glob also matches a table that is a folder of part files.
    return jobs.read_table(spark, f"{sf}/{name}.parquet*", schema)


def _log(events: DataFrame) -> DataFrame:
    tokens = F.ceil(F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("pool"),
        tokens.alias("tokens"),
    )


def _closed_log(spark, sf) -> DataFrame:
    """The requests as a stream, and the mark of their end."""
    mark = jobs.closing_mark(spark, _log(V.table(spark, sf, "events")), shared_folder(spark, "mark"))
    return _log(_stream(spark, sf, "events")).unionByName(mark)


@query(f"""
WITH {V.FILINGS}
SELECT replace(accession_number, '-', '') AS accession_number, 'T' || cik AS ticker, upper(form_type) AS form_type FROM filings""")
def streaming_ingest(spark, sf):
    """A stream of orders stored as analyses, offered twice by two runs."""
    path = shared_folder(spark, "stream-analyses")

    def rows(run: str) -> DataFrame:
        orders = _stream(spark, sf, "orders")
        filing = V.filings_of(orders)
        return filing.select(
            F.replace("accession_number", F.lit("-"), F.lit("")).alias("accession_number"),
            F.concat(F.lit("T"), "cik").alias("ticker"), F.upper("form_type").alias("form_type"), F.col("ord").alias("id"),
            F.lit(run).alias("run"),
        )

    for run in ("first", "second"):
        checkpoint = shared_folder(spark, "checkpoint")
        jobs.ingest_analyses(rows(run), path, checkpoint, [F.col("id")], once=True).awaitTermination()
    stored = spark.read.parquet(path)
    # Nothing of the second run may be stored.
    return stored.filter(F.col("run") == "first").select("accession_number", "ticker", "form_type")


@query(f"""
WITH {V.CHUNKS},
stored AS (SELECT accession_number, count(*) AS n FROM plain_chunks WHERE {_STORED} GROUP BY ALL),
schedule AS (SELECT accession_number, count(*) AS total, doc_id % 6 = 1 AS running FROM plain_chunks WHERE doc_id % 3 <> 0 GROUP BY accession_number, doc_id)
SELECT accession_number, CASE WHEN running THEN 'indexing' ELSE 'complete' END AS state, n AS chunks_indexed, coalesce(total, n) AS chunks_total
FROM stored LEFT JOIN schedule USING (accession_number)""")
def streaming_coverage(spark, sf):
    documents = _stream(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("accession_number"), "text")
    stored = docs.chunks(documents).filter(F.col("chunk_index") < F.col("doc_id") % 4)
    known = V.documents(spark, sf).filter(F.col("doc_id") % 3 != 0)
    schedule = known.select(
        F.col("doc_id").cast("string").alias("accession_number"), F.size(fn.chunk_text(F.col("text"))).alias("chunks_total"),
        (F.col("doc_id") % 6 == 1).alias("running"),
    )
    path = shared_folder(spark, "stream-coverage")
    jobs.track_coverage(stored, schedule, path, shared_folder(spark, "checkpoint"), once=True).awaitTermination()
    return jobs.latest_coverage(spark, path)


@query(f"""
WITH {V.REQUEST_LOG}
SELECT request_id, CAST(sum(tokens) OVER (PARTITION BY pool ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used
FROM request_log""")
def streaming_usage(spark, sf):
    """The whole log; a closing mark takes the watermark past its end."""
    path = shared_folder(spark, "stream-usage")
    jobs.meter_usage(
        _closed_log(spark, sf), path, shared_folder(spark, "checkpoint"), window_seconds=3600, bucket_seconds=86400, once=True,
    ).awaitTermination()
    return spark.read.parquet(path).select("request_id", "used")


@query(f"""
WITH {V.REQUEST_LOG}
SELECT request_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM request_log
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, request_id) <= 200""")
def streaming_admission(spark, sf):
    path = shared_folder(spark, "stream-admission")
    jobs.admit_daily(
        _closed_log(spark, sf), path, shared_folder(spark, "checkpoint"), cap=S.DAILY_CAP, once=True
    ).awaitTermination()
    return spark.read.parquet(path).select("request_id", F.col("day").cast("string").alias("day"))


@query(f"""
WITH {V.FILINGS}, {V.ANALYSES},
newest AS (SELECT cik, CAST(filing_date AS VARCHAR) AS analyzed FROM analyses QUALIFY row_number() OVER (PARTITION BY cik ORDER BY created_at DESC, id DESC) = 1)
SELECT f.cik, f.accession_number, f.filing_date FROM filings f LEFT JOIN newest n ON n.cik = f.cik
WHERE upper(f.form_type) IN ('10-K', '10-Q') AND (n.analyzed IS NULL OR f.filing_date > n.analyzed)""")
def streaming_alerts(spark, sf):
    rows = V.analyses(spark, sf).select("cik", F.col("filing_date").cast("string").alias("filing_date"), "created_at", "id")
    stored = KeyedTable(spark, shared_folder(spark, "analyses-by-company"), rows.schema, ["cik"])
    stored.append(rows, rows.select("cik").distinct().count())
    path = shared_folder(spark, "stream-alerts")
    filings = V.filings_of(_stream(spark, sf, "orders"))
    jobs.alert_new_filings(filings, stored.matching, path, shared_folder(spark, "checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(path).select("cik", "accession_number", "filing_date")
