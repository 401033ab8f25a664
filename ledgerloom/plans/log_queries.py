"""Metering of request logs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import settings as S
from ledgerloom.functions import outcomes
from ledgerloom.operators import metering as ops
from ledgerloom.plans import vehicles as V
from ledgerloom.plans.registry import query


@query(f"""
WITH {V.REQUEST_LOG}
SELECT request_id, CAST(used AS BIGINT) AS used, used > 20000 AS over_budget FROM (
  SELECT request_id, sum(tokens) OVER (PARTITION BY pool ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS used
  FROM request_log)""")
def rolling_usage(spark, sf):
    """An hour's window, as the log holds a request per pool every twenty minutes."""
    metered = ops.rolling_usage(V.request_log(spark, sf), window_seconds=3600, budget=20000)
    return metered.select("request_id", "used", "over_budget")


@query(f"""
WITH {V.REQUEST_LOG}
SELECT request_id, CAST(sum(tokens) OVER (PARTITION BY pool ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used
FROM request_log""")
def minute_usage(spark, sf):
    return ops.rolling_usage(V.request_log(spark, sf)).select("request_id", "used")


@query(f"""
WITH {V.REQUEST_LOG}
SELECT request_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, request_id) <= 200 AS admitted
FROM request_log""")
def daily_admission(spark, sf):
    marked = ops.daily_admission(V.request_log(spark, sf), cap=S.DAILY_CAP)
    return marked.select("request_id", F.col("day").cast("string").alias("day"), "admitted")


@query(f"""
WITH {V.REQUEST_LOG},
last AS (SELECT user_id, item, max(ts) AS last_used FROM request_log GROUP BY ALL)
SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, item) AS rank FROM last QUALIFY rank <= 5""")
def recent_items(spark, sf):
    recent = ops.recent_items(V.request_log(spark, sf))
    return recent.select("user_id", "item", F.col("rank").cast("bigint").alias("rank"))


_CALLS = """
calls AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'embedding' ELSE 'fetch' END AS source,
  CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 500 WHEN 4 THEN 403 WHEN 5 THEN 404 WHEN 6 THEN 502 END AS code,
  CASE WHEN event_type = 'error' THEN 'Quota exceeded for metric: api/embed_content_requests, limit: 1000'
       WHEN event_type = 'click' THEN '{"retryDelay": "' || round(value, 2) || 's"}'
       WHEN event_type = 'view' THEN 'httpx.ReadTimeout: timed out'
       WHEN event_type = 'signup' THEN 'quota exceeded for metric: api/embed_content_input_token_count' END AS message
  FROM events)"""


def _calls(spark, sf):
    events = V.table(spark, sf, "events")
    source = F.when(F.col("event_id") % 3 == 0, "model").when(F.col("event_id") % 3 == 1, "embedding").otherwise("fetch")
    rule = F.get_json_object("props", "$.k").cast("int") % 8
    code = F.lit(None).cast("int")
    for i, value in enumerate([200, 429, 503, 500, 403, 404, 502]):
        code = F.when(rule == i, F.lit(value)).otherwise(code)
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", "Quota exceeded for metric: api/embed_content_requests, limit: 1000")
        .when(kind == "click", F.concat(F.lit('{"retryDelay": "'), F.round("value", 2).cast("string"), F.lit('s"}')))
        .when(kind == "view", "httpx.ReadTimeout: timed out")
        .when(kind == "signup", "quota exceeded for metric: api/embed_content_input_token_count")
    )
    return events.select("event_id", source.alias("source"), code.alias("code"), message.alias("message"))


_CLASS = """CASE WHEN (code IS NULL AND message IS NULL) OR code = 200 THEN NULL WHEN source = 'fetch' AND code IS NOT NULL THEN 'fetch'
  WHEN source = 'embedding' AND code IN (429, 503) THEN CASE WHEN message LIKE '%_requests, %' THEN 'daily_quota' ELSE 'quota' END
  WHEN code = 429 THEN 'quota' WHEN code = 503 THEN 'overloaded' WHEN message LIKE '%ReadTimeout%' THEN 'transient' ELSE 'error' END"""


@query(f"""
WITH {_CALLS},
classed AS (SELECT *, {_CLASS} AS class FROM calls)
SELECT event_id, class, CASE WHEN class = 'fetch' THEN code IN (403, 429, 500, 502, 503, 504) WHEN class = 'transient' THEN true
  WHEN source = 'model' AND class = 'overloaded' THEN true WHEN source = 'embedding' AND class = 'quota' THEN true ELSE false END AS retryable
FROM classed""")
def error_classes(spark, sf):
    source, code = F.col("source"), F.col("code")
    classed = _calls(spark, sf).withColumn("class", outcomes.error_class(source, code, F.col("message")))
    return classed.select("event_id", "class", outcomes.retryable(source, code, F.col("class")).alias("retryable"))


@query(f"""
WITH {_CALLS}
SELECT event_id, CASE WHEN seconds IS NOT NULL THEN least(seconds, 120) END AS delay
FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(message, 'retryDelay["'']?\\s*[:=]\\s*["'']?(\\d+(?:\\.\\d+)?)s', 1), '') AS DOUBLE) AS seconds FROM calls)""")
def retry_delays(spark, sf):
    calls = _calls(spark, sf)
    return calls.select("event_id", outcomes.retry_seconds(F.col("message")).alias("delay"))
