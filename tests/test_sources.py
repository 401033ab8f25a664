import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F
import pytest

from ledgerloom.operators import retrieval as ret
from ledgerloom.sources import keyed, readers, sinks


def test_directory_files(spark, tmp_path):
    document = {"0": {"cik_str": 320193, "ticker": "AAA", "title": "A Inc"}, "1": {"cik_str": 7, "ticker": "BB", "title": "B"}}
    (tmp_path / "d.json").write_text(json.dumps(document))
    rows = readers.read_directory(spark, str(tmp_path)).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("320193", "AAA", "A Inc", 0), ("7", "BB", "B", 1)]


def test_filing_index_pads_short_descriptions(spark, tmp_path):
    recent = {"form": ["10-K", "8-K"], "accessionNumber": ["a", "b"], "filingDate": ["2024-01-01", "2024-01-02"], "primaryDocument": ["x", "y"],
              "primaryDocDescription": ["only"]}
    (tmp_path / "CIK0000320193.json").write_text(json.dumps({"filings": {"recent": recent}}))
    rows = readers.read_filing_index(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.cik, r.form_type, r.accession_number, r.primary_doc_description) for r in rows] == [("320193", "10-K", "a", "only"), ("320193", "8-K", "b", None)]


def test_concept_files(spark, tmp_path):
    (tmp_path / "7").mkdir()
    entries = [{"start": "2020-01-01", "end": "2020-12-31", "val": 5, "filed": "2021"}, {"end": "2020-12-31", "val": 1.5}]
    (tmp_path / "7" / "Revenues.json").write_text(json.dumps({"units": {"USD": entries, "EUR": []}}))
    (tmp_path / "7" / "Empty.json").write_text("{}")
    rows = readers.read_concepts(spark, str(tmp_path / "*")).orderBy("ord").collect()
    assert [(r.cik, r.concept, r.unit, r.start, r.val, r.filed, r.ord) for r in rows] == [
        ("7", "Revenues", "USD", "2020-01-01", 5.0, "2021", 0), ("7", "Revenues", "USD", None, 1.5, None, 1)]


def test_filing_html_keys(spark, tmp_path):
    folder = tmp_path / "320193" / "0000320193-25-000057"
    folder.mkdir(parents=True)
    (folder / "q2.htm").write_text("<p>x</p>\n<p>y</p>")
    row = readers.read_filing_html(spark, str(tmp_path / "*" / "*")).first()
    assert (row.cik, row.accession_number, row.document, row.html) == ("320193", "000032019325000057", "q2.htm", "<p>x</p>\n<p>y</p>")


def test_runs_and_golden(spark, tmp_path):
    record = {"ticker": "A", "cik": "1", "accession_number": "x", "fiscal_year": 2020, "revenue_current": 1.0}
    for name in ("2024-01-01", "2024-01-01-tag"):
        run = {"run_date": "2024-01-01", "model": "m", "fallback_model": "", "max_filing_chars": 10, "records": [record, {**record, "error": "e"}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(run, indent=2))
    newest = readers.newest_run(readers.read_runs(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.artifact, r.ord, r.error) for r in newest] == [("2024-01-01-tag", 0, None), ("2024-01-01-tag", 1, "e")]
    golden = tmp_path / "g"
    golden.mkdir()
    (golden / "golden.json").write_text(json.dumps([{"ticker": "A", "cik": "1", "fiscal_year": 2020}], indent=1))
    assert readers.read_golden(spark, str(golden)).first().fiscal_year == 2020


GOOD = {"revenue": {"current": 1, "yoy_change_pct": None}, "net_income": {"current": None, "yoy_change_pct": 2.5}, "risk_factors": ["a"],
        "management_guidance": "g", "summary": "s"}


def test_extraction_validation(spark):
    outputs = [("a", 1, json.dumps(GOOD)), ("b", 1, "not json"), ("b", 2, json.dumps(GOOD)), ("c", 1, "[1]"), ("c", 2, json.dumps({**GOOD, "summary": None})),
               ("c", 3, json.dumps(GOOD)), ("d", 1, json.dumps({k: v for k, v in GOOD.items() if k != "revenue"})),
               ("e", 1, json.dumps({**GOOD, "risk_factors": "a"})), ("f", 1, json.dumps({**GOOD, "risk_factors": []})), ("g", 1, None),
               ("h", 1, json.dumps({**GOOD, "revenue": {"current": "many"}}))]
    frame = spark.createDataFrame(outputs, "accession_number string, attempt int, output string")
    good, malformed = readers.first_valid_extraction(frame, 2)
    assert sorted(r[0] for r in good.collect()) == ["a", "b", "f"]
    assert sorted(r[0] for r in malformed.collect()) == ["c", "d", "e", "g", "h"]
    flat = readers.flatten_extraction(good).filter("accession_number = 'a'").first()
    assert (flat.revenue_current, flat.net_income_yoy_change_pct, flat.risk_factors) == (1.0, 2.5, ["a"])


def test_insert_returns_the_stored_row(spark, tmp_path):
    path = str(tmp_path / "analyses")

    def batch(*rows):
        return spark.createDataFrame(list(rows), "accession_number string, summary string, position int")

    first = sinks.insert_analyses(batch(("a", "one", 0), ("a", "two", 1), ("b", "x", 2)), path, [F.col("position")])
    assert {r[0]: r.summary for r in first.collect()} == {"a": "one", "b": "x"}
    again = sinks.insert_analyses(batch(("a", "three", 0), ("c", "y", 1)), path, [F.col("position")])
    assert {r[0]: r.summary for r in again.collect()} == {"a": "one", "c": "y"}
    assert spark.read.parquet(path).count() == 3


def test_pinned_truth_moves_only_on_refresh(spark, tmp_path):
    path = str(tmp_path / "truth")

    def truth(value):
        return spark.createDataFrame([("1", 2020, value)], "cik string, fiscal_year int, revenue double")

    assert sinks.pin_truth(truth(1.0), path).first().revenue == 1.0
    assert sinks.pin_truth(truth(2.0), path).first().revenue == 1.0
    assert sinks.pin_truth(truth(3.0), path, refresh=True).first().revenue == 3.0
    assert sinks.pin_truth(truth(4.0), path).first().revenue == 3.0


def test_csv_file(spark, tmp_path):
    row = ("AAA", "Apple, Inc.", "10-Q", dt.date(2026, 5, 2), "acc", 1e9, 5.5, 2e8, None, ["One.", "Two."], 'Say "hi"', "l1\nl2", "2026-07-04T00:00:00+00:00")
    schema = ("ticker string, company_name string, form_type string, filing_date date, accession_number string, revenue_current double, "
              "revenue_yoy_change_pct double, net_income_current double, net_income_yoy_change_pct double, risk_factors array<string>, "
              "management_guidance string, summary string, created_at string")
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame([row], schema), path)
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))
    header = ",".join(sinks.CSV_COLUMNS)
    line = 'AAA,"Apple, Inc.",10-Q,2026-05-02,acc,1000000000,5.5,200000000,,One. | Two.,"Say ""hi""","l1\nl2",2026-07-04T00:00:00+00:00'
    assert data.decode() == f"{header}\r\n{line}\r\n"


def test_match_chunks_function(spark):
    chunks = spark.createDataFrame([("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", [0.0, 1.0]), ("b", 0, "z", [1.0, 0.0])],
                                   "accession_number string, chunk_index bigint, content string, embedding array<float>")
    ret.register_match_chunks(chunks)
    rows = spark.sql("SELECT * FROM match_chunks('a', array(0D, 2D), 1)").collect()
    assert [tuple(r) for r in rows] == [(1, "y", 1.0)]


@pytest.mark.parametrize("name, known", [("nothing-here", 0)])
def test_missing_table_is_empty(spark, tmp_path, name, known):
    assert keyed.read_or_empty(spark, str(tmp_path / name), "a int").count() == known


# --- keyed tables ---------------------------------------------------------------------------

def wide_batch(spark, first, last, step=1, value="x"):
    return spark.range(first, last, step).select(F.format_string("k%08d", "id").alias("accession_number"), F.lit(value).alias("summary"))


@pytest.fixture
def small_files(spark):
    """Many partitions, and the planner joins none of them."""
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "2k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_an_insert_reads_few_files(spark, tmp_path, small_files):
    path = str(tmp_path / "t")
    sinks.insert_analyses(wide_batch(spark, 0, 40000), path, returns=False)
    table = keyed.KeyedTable(spark, path, wide_batch(spark, 0, 1).schema, ["accession_number"])
    files = table.files()
    # More tasks than the old limit of 32, and a file for each.
    assert len(files) > 32
    known = wide_batch(spark, 500, 503)
    held = table.holding(known)
    assert 1 <= len(held) <= 8 < len(files)
    assert len(table.holding(wide_batch(spark, 10**6, 10**6 + 5))) <= 5
    # The stored rows of known keys, and the new ones.
    again = sinks.insert_analyses(wide_batch(spark, 39998, 40003, value="y"), path)
    assert {r[0][-5:]: r[1] for r in again.collect()} == {"39998": "x", "39999": "x", "40000": "y", "40001": "y", "40002": "y"}
    assert table.rows().count() == 40003 and table.rows().select("accession_number").distinct().count() == 40003


def test_files_without_an_entry_count(spark, tmp_path):
    """A write that was cut off between its files and their index."""
    path = str(tmp_path / "t")
    sinks.insert_analyses(wide_batch(spark, 0, 100), path, returns=False)
    wide_batch(spark, 100, 110).write.mode("append").parquet(path)
    again = sinks.insert_analyses(wide_batch(spark, 95, 115, value="y"), path)
    assert again.filter("summary = 'x'").count() == 15 and again.count() == 20
    table = keyed.KeyedTable(spark, path, wide_batch(spark, 0, 1).schema, ["accession_number"])
    lost = table.repair()
    assert lost and table.repair() == [] and table.rows().count() == 115
    assert set(lost) & set(table.holding(wide_batch(spark, 105, 106)))


def test_repeated_batches_nulls_and_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "one"), (None, "none"), ("a", "two"), ("a", "two")], "accession_number string, summary string")
    for _ in range(3):
        stored = sinks.insert_analyses(rows, path)
        assert sorted(stored.collect(), key=str) == sorted([("a", "two"), (None, "none")], key=str)
    assert spark.read.parquet(path).count() == 2
    assert sinks.insert_analyses(rows.limit(0), path).count() == 0
    other = str(tmp_path / "none")
    assert sinks.insert_analyses(rows.limit(0), other).count() == 0 and sinks.insert_analyses(rows, other).count() == 2


def test_a_filing_with_most_rows_takes_several_files(spark, tmp_path, small_files):
    path = str(tmp_path / "t")
    content = F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(12)])
    hot = spark.range(3000).select(F.lit("hot").alias("accession_number"), F.col("id").cast("int").alias("chunk_index"), content.alias("content"))
    sinks.insert_chunks(hot, path, returns=False)
    table = keyed.KeyedTable(spark, path, hot.schema, ["accession_number"])
    assert len(table.files()) > 4
    assert sinks.insert_chunks(hot.withColumn("content", F.lit("")), path).filter("content = ''").count() == 0
    assert table.rows().count() == 3000


def test_pins_of_a_company_read_its_files(spark, tmp_path, small_files):
    path = str(tmp_path / "truth")
    truth = spark.range(20000).select(F.col("id").cast("string").alias("cik"), F.lit(2020).alias("fiscal_year"), F.rand(1).alias("revenue"))
    sinks.pin_truth(truth, path)
    one = truth.filter("cik = '77'")
    assert sinks.pin_truth(one.withColumn("revenue", F.lit(5.0)), path).first().revenue != 5.0
    assert sinks.pin_truth(one.withColumn("revenue", F.lit(6.0)), path, refresh=True).first().revenue == 6.0
    found = sinks.pinned_truth(spark, path, truth, one.select("cik"))
    assert [r.revenue for r in found.collect()] == [6.0] and len(found.inputFiles()) < 10
    assert sinks.pinned_truth(spark, path, truth).count() == 20000


# --- files and tables that are written and read back -----------------------------------------

def test_filing_files_round_trip(spark, tmp_path):
    html = ["<p>x</p>\n\n<p>ü &amp; 日本</p>\r\n", "", "no end", "ends with space "]
    rows = [(str(i), f"0000320193-25-00000{i}", f"q {i}%.htm", h) for i, h in enumerate(html)] + [("9", "000032019325000009", "none.htm", None)]
    path = str(tmp_path / "html")
    sinks.write_filing_html(spark.createDataFrame(rows, "cik string, accession_number string, document string, html string"), path)
    found = {r.cik: tuple(r)[1:] for r in readers.read_stored_html(spark, path).collect()}
    assert found == {c: (a.replace("-", ""), d, h or "") for c, a, d, h in rows}
    assert readers.read_stored_html(spark, path).filter("cik = '2'").count() == 1


def test_filing_files_do_not_grow_with_their_documents(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").cast("string").alias("cik"), F.lpad(F.col("id").cast("string"), 18, "0").alias("accession_number"), F.lit("x/a b%.htm").alias("document"), F.lit("x").alias("html"))
    path = str(tmp_path / "html")
    sinks.write_filing_html(rows.coalesce(2), path)
    found = readers.read_stored_html(spark, path)
    assert found.count() == found.select("cik").distinct().count() == 300 and len(found.inputFiles()) == 2
    assert found.filter("document = 'x/a b%.htm'").count() == 300


def test_artifacts_and_golden_documents(spark, tmp_path):
    schema = ("run_date string, tag string, model string, fallback_model string, max_filing_chars int, ord int, ticker string, cik string, accession_number string, "
              "fiscal_year int, revenue_current double, revenue_yoy_change_pct double, net_income_current double, net_income_yoy_change_pct double, error string")
    rows = [(d, t, "m", "", 10, i, "A", "1", f"a{i}", 2020, 0.1 + i, None, None, None, "e" if i else None) for d, t in (("2024-01-01", ""), ("2024-01-01", "x"), ("2023-12-31", None)) for i in (1, 0)]
    path = str(tmp_path / "runs")
    sinks.write_artifacts(spark.createDataFrame(rows, schema), path)
    runs = readers.read_runs(spark, path)
    assert {r.artifact for r in runs.collect()} == {"2024-01-01", "2024-01-01-x", "2023-12-31"}
    assert [(r.ord, r.accession_number, r.revenue_current, r.error) for r in readers.newest_run(runs).orderBy("ord").collect()] == [(0, "a0", 0.1, None), (1, "a1", 1.1, "e")]
    # A run of the same name is replaced.
    sinks.write_artifacts(spark.createDataFrame(rows[:1], schema), path)
    assert readers.read_runs(spark, path).filter("artifact = '2024-01-01'").count() == 1 and readers.read_runs(spark, path).count() == 5
    golden = spark.range(2500).selectExpr("concat('T', id) AS ticker", "cast(id as string) AS cik", "'n' AS company_name", "lpad(id, 18, '0') AS accession_number",
                                          "'d' AS primary_document", "'10-K' AS form_type", "2020 AS fiscal_year", "cast(null as string) AS note")
    sinks.write_golden(golden, str(tmp_path / "golden"))
    assert readers.read_golden(spark, str(tmp_path / "golden")).exceptAll(golden).count() == 0 and readers.read_golden(spark, str(tmp_path / "golden")).count() == 2500


def test_chunks_stay_where_they_are(spark, tmp_path):
    chunks = spark.range(5000).select((F.col("id") % 90).cast("string").alias("accession_number"), F.col("id").cast("int").alias("chunk_index"),
                                      F.lit("text").alias("content"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    path = str(tmp_path / "chunks")
    sinks.write_chunk_table(chunks, path, "chunks_here", 6)
    again = readers.register_chunk_table(spark, path, "chunks_there", 6)
    questions = spark.range(90).select(F.col("id").cast("string").alias("accession_number"), F.lit("q").alias("question"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (spark.table("chunks_here"), again):
            joined = table.join(questions, "accession_number")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            # Only the questions move.
            assert plan.count("Exchange") == 1 and joined.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE chunks_here")
        spark.sql("DROP TABLE chunks_there")
