"""Raw documents and stored tables as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.strings import bind, document_keys

DIRECTORY_JSON = "map<string, struct<cik_str:bigint, ticker:string, title:string>>"
FILINGS_JSON = (
    "struct<filings:struct<recent:struct<form:array<string>, accessionNumber:array<string>, "
    "filingDate:array<string>, primaryDocument:array<string>, primaryDocDescription:array<string>>>>"
)
UNITS_JSON = "struct<units:map<string, array<struct<start:string, end:string, val:double, filed:string>>>>"

ANALYSES = (
    "id bigint, accession_number string, cik string, ticker string, company_name string, form_type string, "
    "filing_date date, revenue_current double, revenue_yoy_change_pct double, net_income_current double, "
    "net_income_yoy_change_pct double, risk_factors array<string>, management_guidance string, summary string, "
    "created_at timestamp"
)
CHUNKS = "accession_number string, chunk_index int, content string, embedding array<float>"
GOLDEN = (
    "ticker string, cik string, company_name string, accession_number string, primary_document string, "
    "form_type string, fiscal_year int, note string"
)
RECORD = (
    "struct<ticker:string, cik:string, accession_number:string, fiscal_year:int, revenue_current:double, "
    "revenue_yoy_change_pct:double, net_income_current:double, net_income_yoy_change_pct:double, error:string>"
)
RUN = f"run_date string, model string, fallback_model string, max_filing_chars int, records array<{RECORD}>"
EXTRACTION = (
    "revenue struct<current:double, yoy_change_pct:double>, net_income struct<current:double, yoy_change_pct:double>, "
    "risk_factors array<string>, management_guidance string, summary string"
)


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row (path, text) per file."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


# --- raw JSON ---------------------------------------------------------------------

def parse_directory(documents: DataFrame, json: str = "json") -> DataFrame:
    """Company directory documents to (cik, ticker, name, ord); ord is the position in the document."""
    others = [c for c in documents.columns if c != json]
    companies = F.map_values(F.from_json(F.col(json), DIRECTORY_JSON))
    rows = documents.select(*others, F.posexplode(companies).alias("ord", "c"))
    return rows.select(
        *others, F.col("c.cik_str").cast("string").alias("cik"), F.col("c.ticker").alias("ticker"),
        F.col("c.title").alias("name"), "ord",
    )


def parse_filing_index(documents: DataFrame, json: str = "json") -> DataFrame:
    """Filing index documents (parallel arrays) to one row per filing, in index order.

    A description array shorter than the others leaves nulls.
    """
    others = [c for c in documents.columns if c != json]
    recent = F.from_json(F.col(json), FILINGS_JSON)["filings"]["recent"]
    names = {
        "form": "form_type",
        "accessionNumber": "accession_number",
        "filingDate": "filing_date",
        "primaryDocument": "primary_document",
        "primaryDocDescription": "primary_doc_description",
    }
    parsed = documents.select(*others, recent.alias("r"))
    zipped = F.arrays_zip(*[F.col(f"r.{field}") for field in names])
    rows = parsed.select(*others, F.size("r.form").alias("n"), F.posexplode(zipped).alias("ord", "f"))
    columns = [F.col(f"f.{field}").alias(name) for field, name in names.items()]
    return rows.filter(F.col("ord") < F.col("n")).select(*others, *columns, "ord")


def parse_concepts(documents: DataFrame, json: str = "json") -> DataFrame:
    """Concept documents (cik, concept, json) to fact rows of every unit.

    A document without units gives no rows. ``ord`` is the entry's position.
    """
    units = F.from_json(F.col(json), UNITS_JSON)["units"]
    per_unit = documents.select("cik", "concept", F.explode(units).alias("unit", "entries"))
    rows = per_unit.select("cik", "concept", "unit", F.posexplode("entries").alias("ord", "e"))
    return rows.select("cik", "concept", "unit", "e.start", "e.end", "e.val", "e.filed", "ord")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return parse_directory(whole_files(spark, path).withColumnRenamed("text", "json").drop("path"))


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Filing index files named CIK<number>.json."""
    files = whole_files(spark, path)
    cik = F.regexp_extract("path", r"CIK0*(\d+)\.json\z", 1)
    return parse_filing_index(files.select(cik.alias("cik"), F.col("text").alias("json")))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concept files laid out as <cik>/<concept>.json."""
    files = whole_files(spark, path)
    cik = F.regexp_extract("path", r"([^/]+)/[^/]+\.json\z", 1)
    concept = F.regexp_extract("path", r"([^/]+)\.json\z", 1)
    return parse_concepts(files.select(cik.alias("cik"), concept.alias("concept"), F.col("text").alias("json")))


def read_filing_html(spark: SparkSession, path: str, glob: str = "*.htm*") -> DataFrame:
    """Filing documents laid out as <cik>/<accession>/<document>."""
    files = whole_files(spark, path, glob)
    return files.select(document_keys(F.col("path")).alias("k"), F.col("text").alias("html")).select("k.*", "html")


def read_stored_html(spark: SparkSession, path: str) -> DataFrame:
    """Filing documents kept by ``sinks.write_filing_html``; a filter on the keys leaves out row groups by their bounds."""
    return spark.read.schema("cik string, accession_number string, document string, html string").parquet(path)


# --- stored tables ------------------------------------------------------------------

def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYSES).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def register_chunk_table(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """The chunk table that another session wrote in ``buckets`` below ``path``, under ``name``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({CHUNKS}) USING parquet CLUSTERED BY (accession_number) "
        f"SORTED BY (accession_number, chunk_index) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Entries of golden sets, multi-line JSON arrays in one file or in folders of them."""
    names = [part.split()[0] for part in GOLDEN.split(", ")]
    return spark.read.schema(GOLDEN).json(path, multiLine=True).select(*names)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run artifacts (multi-line JSON) to one row per record, with the run's settings.

    ``artifact`` is the file's name, or that of its folder (artifact=NAME); the newest run is the greatest one.
    """
    runs = spark.read.schema(RUN).json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"(?:artifact=([^/]+)/[^/]+|([^/]+)\.json)\z", 0)
    name = F.regexp_replace(name, r"\Aartifact=|/[^/]+\z|\.json\z", "")
    rows = runs.withColumn("artifact", name).select(
        "artifact", "run_date", "model", "fallback_model", "max_filing_chars", F.posexplode("records").alias("ord", "r")
    )
    return rows.select("*", "r.*").drop("r")


def newest_run(records: DataFrame) -> DataFrame:
    """Records of the artifact whose name sorts last."""
    return records.filter(F.col("artifact") == records.agg(F.max("artifact")).scalar())


# --- model output ------------------------------------------------------------------------

def parse_extraction(text: Column) -> Column:
    """Structured model output; null when it is not JSON with all five fields of the right type."""
    schema = f"struct<{EXTRACTION.replace(' struct', ':struct').replace(' array', ':array').replace(' string', ':string')}, _bad:string>"
    required = ["revenue", "net_income", "risk_factors", "management_guidance", "summary"]

    def checked(parsed: Column) -> Column:
        whole = parsed["_bad"].isNull() & ~F.exists(parsed["risk_factors"], lambda r: r.isNull())
        for name in required:
            whole = whole & parsed[name].isNotNull()
        return F.when(whole, parsed.dropFields("_bad"))

    return bind(F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}), checked)


def first_valid_extraction(attempts: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, malformed) filings from (accession_number, attempt, output) rows.

    The first valid output counts, among the first ``limit`` attempts if that is given.
    """
    tried = attempts if limit is None else attempts.filter(F.col("attempt") <= limit)
    parsed = tried.withColumn("analysis", parse_extraction(F.col("output")))
    valid = parsed["analysis"].isNotNull()
    best = parsed.groupBy("accession_number").agg(F.min_by("analysis", F.when(valid, F.col("attempt"))).alias("analysis"))
    good = best.filter(F.col("analysis").isNotNull())
    return good, best.filter(F.col("analysis").isNull()).select("accession_number")


def flatten_extraction(rows: DataFrame) -> DataFrame:
    """``analysis`` struct to the flat columns of a stored analysis."""
    a = F.col("analysis")
    empty = F.array().cast("array<string>")
    return rows.select(
        *[c for c in rows.columns if c != "analysis"],
        a["revenue"]["current"].alias("revenue_current"),
        a["revenue"]["yoy_change_pct"].alias("revenue_yoy_change_pct"),
        a["net_income"]["current"].alias("net_income_current"),
        a["net_income"]["yoy_change_pct"].alias("net_income_yoy_change_pct"),
        F.coalesce(a["risk_factors"], empty).alias("risk_factors"),
        a["management_guidance"].alias("management_guidance"),
        a["summary"].alias("summary"),
    )
