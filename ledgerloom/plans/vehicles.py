"""Filings data derived from the driver tables, as DataFrames and as SQL.

Each vehicle has a DataFrame builder and a common table expression of the same
name in capitals that derives the same rows for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators.documents import chunks


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; the schema is given, so no footer is read to plan a query."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def day_text(ts: str) -> Column:
    return F.col(ts).cast("date").cast("string")


# --- facts -------------------------------------------------------------------------

# (metric, concept, unit, kind, preference)
ANNUAL = [
    ("revenue", "A", "USD", "annual", 0),
    ("revenue", "N", "USD", "annual", 1),
    ("net_income", "R", "USD", "annual", 0),
    ("eps_diluted", "A", "USD/shares", "annual", 0),
    ("eps_diluted", "R", "USD/shares", "annual", 1),
    ("operating_cash_flow", "N", "USD", "annual", 0),
    ("operating_cash_flow", "R", "USD", "annual", 1),
    ("cash", "1-URGENT", "USD", "instant", 0),
    ("cash", "2-HIGH", "USD", "instant", 1),
    ("total_assets", "3-MEDIUM", "USD", "instant", 0),
    ("stockholders_equity", "4-NOT SPECIFIED", "USD", "instant", 0),
    ("stockholders_equity", "5-LOW", "USD", "instant", 1),
]
FLOWS = [c for c in ANNUAL if c[0] in ("revenue", "net_income")]
QUARTERLY = [(metric, concept, unit, "quarterly", pref) for metric, concept, unit, _, pref in FLOWS]


def _values(rows: list[tuple]) -> str:
    return ", ".join("('%s', '%s', '%s', '%s', %d)" % row for row in rows)


def candidates_sql(name: str, rows: list[tuple]) -> str:
    return f"{name}(metric, concept, unit, kind, pref) AS (VALUES {_values(rows)})"


def duration_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Companies are nations, concepts return flags, periods run from order to shipment."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    end = F.when(F.col("l_orderkey") % 97 == 0, F.substring(day_text("l_shipdate"), 1, 7)).otherwise(day_text("l_shipdate"))
    filed = F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber") * 30)
    return joined.select(
        F.col("s_nationkey").cast("string").alias("cik"),
        F.col("l_returnflag").alias("concept"),
        F.when(F.col("l_linenumber") == 7, "USD/shares").otherwise("USD").alias("unit"),
        day_text("o_orderdate").alias("start"),
        end.alias("end"),
        F.col("l_extendedprice").alias("val"),
        filed.cast("string").alias("filed"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )


DURATION_FACTS = """
duration_facts AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS cik, l_returnflag AS concept,
         CASE WHEN l_linenumber = 7 THEN 'USD/shares' ELSE 'USD' END AS unit,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "start",
         CASE WHEN l_orderkey % 97 = 0 THEN substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7)
              ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS "end",
         l_extendedprice AS val,
         CAST(CAST(l_shipdate AS DATE) + CAST(30 * l_linenumber AS INTEGER) AS VARCHAR) AS filed,
         l_orderkey * 8 + l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def instant_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Balances: companies are nations, concepts order priorities; some dates are malformed."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    end = (
        F.when(key % 50 == 0, F.substring(day_text("o_orderdate"), 1, 4))
        .when(key % 51 == 0, "n/a")
        .otherwise(day_text("o_orderdate"))
    )
    filed = F.date_add(F.col("o_orderdate").cast("date"), (key % 90).cast("int"))
    return joined.select(
        F.col("c_nationkey").cast("string").alias("cik"),
        F.col("o_orderpriority").alias("concept"),
        F.lit("USD").alias("unit"),
        F.when(key % 53 == 0, "").alias("start"),
        end.alias("end"),
        F.col("o_totalprice").alias("val"),
        filed.cast("string").alias("filed"),
        key.alias("ord"),
    )


INSTANT_FACTS = """
instant_facts AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS cik, o_orderpriority AS concept, 'USD' AS unit,
         CASE WHEN o_orderkey % 53 = 0 THEN '' END AS "start",
         CASE WHEN o_orderkey % 50 = 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4)
              WHEN o_orderkey % 51 = 0 THEN 'n/a'
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "end",
         o_totalprice AS val,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS VARCHAR) AS filed,
         o_orderkey AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return duration_facts(spark, sf).unionByName(instant_facts(spark, sf))


FACTS = f"""{DURATION_FACTS}, {INSTANT_FACTS},
facts AS (SELECT * FROM duration_facts UNION ALL SELECT * FROM instant_facts)"""

# Every qualifying fact with its kind and period.
_DAY = "CASE WHEN regexp_full_match({0}, '[0-9]+-[0-9]+-[0-9]+') THEN TRY_CAST({0} AS DATE) END"
TYPED_FACTS = f"""{FACTS},
timed AS (
  SELECT *, date_diff('day', {_DAY.format('"start"')}, {_DAY.format('"end"')}) AS days FROM facts
),
typed AS (
  SELECT *, 'annual' AS kind, substr("end", 1, 4) AS period FROM timed
  WHERE days BETWEEN 340 AND 400 AND val IS NOT NULL
  UNION ALL
  SELECT *, 'quarterly', "end" FROM timed WHERE days BETWEEN 80 AND 100 AND val IS NOT NULL
  UNION ALL
  SELECT *, 'instant', CAST(TRY_CAST(substr("end", 1, 4) AS INTEGER) AS VARCHAR) FROM timed
  WHERE "start" IS NULL AND "end" <> '' AND val IS NOT NULL
    AND TRY_CAST(substr("end", 1, 4) AS INTEGER) IS NOT NULL
),
winners AS (
  SELECT cik, concept, unit, kind, period, val,
         min(ord) OVER (PARTITION BY cik, concept, unit, kind, period) AS first_seen
  FROM typed
  QUALIFY row_number() OVER (
    PARTITION BY cik, concept, unit, kind, period ORDER BY filed DESC, ord ASC, val DESC) = 1
)"""


def selected_sql(candidates: list[tuple]) -> str:
    """winners reduced to the chosen concept of every metric."""
    return f"""{TYPED_FACTS},
{candidates_sql('candidates', candidates)},
candidate_values AS (SELECT cik, metric, concept, pref, period, val, first_seen
  FROM winners JOIN candidates USING (concept, unit, kind)),
reach AS (SELECT cik, metric, concept, pref, max(period) AS latest, count(*) AS n
  FROM candidate_values GROUP BY ALL),
chosen AS (SELECT cik, metric, concept FROM reach
  QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY latest DESC, n DESC, pref) = 1),
series AS (SELECT v.* FROM candidate_values v JOIN chosen USING (cik, metric, concept))"""


def frame_sql(candidates: list[tuple], metrics: list[str], last: int, period: str) -> str:
    columns = ", ".join(f"max(val) FILTER (metric = '{m}') AS {m}" for m in metrics)
    return f"""{selected_sql(candidates)},
framed AS (SELECT cik, {period}, {columns} FROM series GROUP BY cik, period
  HAVING count(*) FILTER (metric IN ('revenue', 'net_income')) > 0),
frame AS (SELECT * FROM framed
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY {period.split(' AS ')[-1]} DESC) <= {last})"""


# --- filings and analyses --------------------------------------------------------------

FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A", "8-K")


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers file orders; the index order is the order key."""
    return filings_of(table(spark, sf, "orders"))


def filings_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (key % 5 + 1).cast("int"))
    accession = F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"), F.lpad((key % 100).cast("string"), 2, "0"),
        F.lit("-"), F.lpad(key.cast("string"), 6, "0"),
    )
    return orders.select(
        F.col("o_custkey").cast("string").alias("cik"),
        accession.alias("accession_number"),
        F.when(key % 7 == 0, F.lower(form)).otherwise(form).alias("form_type"),
        day_text("o_orderdate").alias("filing_date"),
        F.concat(F.lit("doc"), key.cast("string"), F.lit(".htm")).alias("primary_document"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("primary_doc_description"),
        key.alias("ord"),
    )


_FORM = "list_extract(['10-K', '10-Q', '10-K/A', '10-Q/A', '8-K'], CAST(o_orderkey % 5 + 1 AS INTEGER))"
FILINGS = f"""
filings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
           || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession_number,
         CASE WHEN o_orderkey % 7 = 0 THEN lower({_FORM}) ELSE {_FORM} END AS form_type,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
         'doc' || o_orderkey || '.htm' AS primary_document,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS primary_doc_description,
         o_orderkey AS ord
  FROM orders
)"""


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Stored analyses, created in another order than filed; some are undated."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    change = F.round(F.col("o_totalprice") % 97 - 48, 2)
    created = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=(key % 97).cast("int"))
    risks = F.array(F.concat(F.lit("Risk of "), F.col("o_orderpriority")), F.concat(F.lit("Status, "), F.col("o_orderstatus")))
    return orders.select(
        key.alias("id"),
        F.lpad(key.cast("string"), 18, "0").alias("accession_number"),
        F.col("o_custkey").cast("string").alias("cik"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.concat(F.lit("Company "), F.col("o_custkey").cast("string"), F.lit(", Inc.")).alias("company_name"),
        F.element_at(F.array(*[F.lit(f) for f in FORMS[:4]]), (key % 4 + 1).cast("int")).alias("form_type"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("filing_date"),
        F.when(key % 10 != 0, F.col("o_totalprice") * 1000).alias("revenue_current"),
        F.when(key % 6 != 0, change).alias("revenue_yoy_change_pct"),
        F.when(key % 8 != 0, F.col("o_totalprice") - 200000).alias("net_income_current"),
        F.when(key % 9 != 0, change / 4).alias("net_income_yoy_change_pct"),
        F.when(key % 12 == 0, F.array().cast("array<string>")).otherwise(risks).alias("risk_factors"),
        F.when(key % 5 != 0, F.concat(F.lit('Guidance "'), F.col("o_orderpriority"), F.lit('"'))).alias("management_guidance"),
        F.concat(F.lit("Line one"), F.when(key % 4 == 0, F.lit("\n")).otherwise(F.lit(" ")), F.lit("two")).alias("summary"),
        created.alias("created_at"),
    )


ANALYSES = """
analyses AS (
  SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS accession_number,
         CAST(o_custkey AS VARCHAR) AS cik, 'T' || o_custkey AS ticker,
         'Company ' || o_custkey || ', Inc.' AS company_name,
         list_extract(['10-K', '10-Q', '10-K/A', '10-Q/A'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS form_type,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS filing_date,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice * 1000 END AS revenue_current,
         CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice % 97 - 48, 2) END AS revenue_yoy_change_pct,
         CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice - 200000 END AS net_income_current,
         CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice % 97 - 48, 2) / 4 END AS net_income_yoy_change_pct,
         CASE WHEN o_orderkey % 12 = 0 THEN CAST([] AS VARCHAR[])
              ELSE ['Risk of ' || o_orderpriority, 'Status, ' || o_orderstatus] END AS risk_factors,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'Guidance "' || o_orderpriority || '"' END AS management_guidance,
         'Line one' || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) ELSE ' ' END || 'two' AS summary,
         o_orderdate + to_days(CAST(o_orderkey % 97 AS INTEGER)) AS created_at
  FROM orders
)"""


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as listed companies: a few tickers are exactly a brand, most start with one."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    key = F.col("p_partkey")
    ticker = F.when(key % 40 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("-"), key.cast("string")))
    return part.select(
        key.cast("string").alias("cik"), ticker.alias("ticker"), F.col("p_name").alias("name"), key.alias("ord")
    )


DIRECTORY = """
directory AS (
  SELECT CAST(p_partkey AS VARCHAR) AS cik,
         CASE WHEN p_partkey % 40 = 0 THEN p_brand ELSE p_brand || '-' || p_partkey END AS ticker,
         p_name AS name, p_partkey AS ord
  FROM part
)"""


# --- chunks ------------------------------------------------------------------------------

def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents with unit declarations appended to some of them."""
    texts = documents(spark, sf).select(F.col("doc_id").cast("string").alias("accession_number"), "text")
    rule = (F.col("accession_number").cast("bigint") + F.col("chunk_index")) % 5
    note = (
        F.when(rule == 0, F.concat(F.lit("\n(amounts in millions, except item "), F.col("chunk_index"), F.lit(" ; ) x\n")))
        .when(rule == 1, "\nDollars in\n  thousands here")
        .when(rule == 2, "\nOne in millions of shoppers")
        .when(rule == 3, "\nAll figures are stated in billions of euros")
        .otherwise("")
    )
    rows = chunks(texts)
    return rows.select("accession_number", "chunk_index", F.concat("content", note).alias("content"))


# Windows of 2,000 characters every 1,800, stripped, as SQL.
def chunks_sql(source: str = "documents") -> str:
    return CHUNKS_OF.replace("FROM documents", f"FROM {source}")


CHUNKS_OF = """
bodies AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS accession_number, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body
  FROM documents
),
pieces AS (
  SELECT doc_id, accession_number, i,
         trim(substr(body, CAST(i * 1800 + 1 AS BIGINT), 2000), chr(32) || chr(9) || chr(10) || chr(13)) AS content
  FROM (SELECT *, unnest(CASE WHEN length(body) <= 2000 THEN [0]
                              ELSE range(0, CAST(ceil(length(body) / 1800.0) AS BIGINT)) END) AS i FROM bodies)
  WHERE length(body) > 0
),
plain_chunks AS (
  SELECT doc_id, accession_number, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, content
  FROM pieces WHERE content <> ''
)"""
CHUNKS = chunks_sql()
CHUNK_ROWS = f"""{CHUNKS},
chunk_rows AS (
  SELECT accession_number, chunk_index, content || CASE (doc_id + chunk_index) % 5
           WHEN 0 THEN chr(10) || '(amounts in millions, except item ' || chunk_index || ' ; ) x' || chr(10)
           WHEN 1 THEN chr(10) || 'Dollars in' || chr(10) || '  thousands here'
           WHEN 2 THEN chr(10) || 'One in millions of shoppers'
           WHEN 3 THEN chr(10) || 'All figures are stated in billions of euros'
           ELSE '' END AS content
  FROM plain_chunks
)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as stored chunks; the label plays the filing."""
    rows = table(spark, sf, "embeddings")
    return rows.select(
        F.col("label").cast("string").alias("accession_number"), F.col("vec_id").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"), "embedding",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Several questions per filing: the vectors of its first chunk and of every chunk whose id 20 divides."""
    rows = vectors(spark, sf)
    first = rows.groupBy("accession_number").agg(F.min("chunk_index").alias("first"))
    asked = rows.join(first, "accession_number").filter((F.col("chunk_index") % 20 == 0) | (F.col("chunk_index") == F.col("first")))
    text = F.concat(F.lit("What about "), F.col("accession_number"), F.lit(", "), F.col("chunk_index").cast("string"), F.lit("?"))
    return asked.select(F.col("chunk_index").alias("question_id"), "accession_number", F.col("embedding").alias("vector"), text.alias("question"))


VECTORS = """
vectors AS (SELECT CAST(label AS VARCHAR) AS accession_number, vec_id AS chunk_index,
                   'chunk ' || vec_id AS content, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
questions AS (SELECT accession_number, chunk_index AS question_id, embedding AS vector,
                     'What about ' || accession_number || ', ' || chunk_index || '?' AS question
              FROM vectors QUALIFY chunk_index % 20 = 0 OR chunk_index = min(chunk_index) OVER (PARTITION BY accession_number)),
matches AS (
  SELECT question_id, q.accession_number, chunk_index, content,
         list_cosine_similarity(vector, embedding) AS similarity,
         row_number() OVER (PARTITION BY question_id
           ORDER BY list_cosine_similarity(vector, embedding) DESC, chunk_index) AS rank
  FROM questions q JOIN vectors v ON q.accession_number = v.accession_number
  QUALIFY rank <= 6
)"""


# --- request log ------------------------------------------------------------------------

def request_log(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("event_type").alias("pool"),
        "user_id",
        F.get_json_object("props", "$.k").alias("item"),
        F.ceil(F.col("value") * 100).cast("bigint").alias("tokens"),
        "value",
    )


REQUEST_LOG = """
request_log AS (
  SELECT event_id AS request_id, ts, event_type AS pool, user_id, json_extract_string(props, '$.k') AS item,
         CAST(ceil(value * 100) AS BIGINT) AS tokens, value
  FROM events
)"""
