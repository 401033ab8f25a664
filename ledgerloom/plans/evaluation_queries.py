"""Evaluation of extracted figures over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.operators import evaluation as ev, facts as ops
from ledgerloom.operators.history import build_golden
from ledgerloom.operators.skew import best_row
from ledgerloom.plans import flows, vehicles as V
from ledgerloom.plans.fact_queries import TRUTH, truth_keys
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers, sinks

# (run_date, tag, model, shift): the shift decides how each figure is altered.
RUNS = [("2023-12-01", "a", "m0", 5), ("2024-01-01", "", "m1", 0), ("2024-02-01", "", "m1", 3)]
_RUNS_SQL = ", ".join("('%s', '%s', '%s', %d)" % run for run in RUNS)


def records(spark, sf) -> DataFrame:
    """Extraction records with their truth: true figures altered by a rule on the key."""
    truth, _ = ops.ground_truth(V.duration_facts(spark, sf), truth_keys(spark, sf), V.FLOWS)
    truth = ops.with_changes(truth)
    runs = F.array(*[
        F.struct(F.lit(d).alias("run_date"), F.lit(t).alias("tag"), F.lit(m).alias("model"), F.lit(s).alias("shift"))
        for d, t, m, s in RUNS
    ])
    rows = truth.select("*", F.inline(runs))
    cik, year = F.col("cik").cast("int"), F.col("fiscal_year")
    rule = (cik * 7 + year + F.col("shift")) % 9
    sign = (cik + year + F.col("shift")) % 4

    def altered(metric: str):
        value, prior = F.col(metric), F.col(f"{metric}_prior")
        return (
            F.when(rule == 1, value * 1000).when(rule == 2, -value).when(rule == 3, F.coalesce(prior, value))
            .when(rule == 4, F.lit(None)).when(rule == 5, value * 1.005).when(rule == 6, value * 1.02)
            .when(rule == 7, value / 1000000).otherwise(value)
        )

    def change(metric: str):
        value = F.col(f"{metric}_yoy_change_pct")
        return F.when(sign == 1, -value).when(sign == 2, F.lit(None)).when(sign == 3, F.lit(0.0)).otherwise(value)

    return rows.select(
        "run_date", "tag", "model", F.lit("").alias("fallback_model"), F.lit(600000).alias("max_filing_chars"),
        F.concat(F.lit("T"), "cik").alias("ticker"), "cik", "fiscal_year",
        F.lpad((cik * 10000 + year).cast("string"), 18, "0").alias("accession_number"),
        F.when(rule == 8, "overloaded: busy").alias("error"),
        altered("revenue").alias("revenue_current"), change("revenue").alias("revenue_yoy_change_pct"),
        altered("net_income").alias("net_income_current"), change("net_income").alias("net_income_yoy_change_pct"),
        year.alias("ord"),
        "revenue", "revenue_prior", "net_income", "net_income_prior", "revenue_series", "net_income_series",
    )


def _altered(metric: str) -> str:
    return f"""CASE (CAST(cik AS INTEGER) * 7 + fiscal_year + shift) % 9
      WHEN 1 THEN {metric} * 1000 WHEN 2 THEN -{metric} WHEN 3 THEN coalesce({metric}_prior, {metric})
      WHEN 4 THEN NULL WHEN 5 THEN {metric} * 1.005::DOUBLE WHEN 6 THEN {metric} * 1.02::DOUBLE
      WHEN 7 THEN {metric} / 1000000 ELSE {metric} END"""


def _change(metric: str) -> str:
    value = f"""CASE WHEN {metric}_prior <> 0 THEN ({metric} - {metric}_prior) / abs({metric}_prior) * 100 END"""
    return f"""CASE (CAST(cik AS INTEGER) + fiscal_year + shift) % 4
      WHEN 1 THEN -({value}) WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE {value} END"""


def _near(value: str, truth: str) -> str:
    return f"(CASE WHEN {truth} = 0 THEN abs({value}) <= 1 ELSE abs({value} - {truth}) / abs({truth}) <= 0.01::DOUBLE END)"


def _value_score(v: str, t: str, series: str) -> str:
    scale = " ".join(
        f"WHEN {t} <> 0 AND {_near(f'(abs({v}) / abs({t}))', f'{factor}::DOUBLE')} THEN 'wrong|scale ({label})'"
        for factor, label in [
            ("1e3", "×1e+03"), ("1e-3", "÷1e+03"), ("1e6", "×1e+06"), ("1e-6", "÷1e+06"), ("1e9", "×1e+09"), ("1e-9", "÷1e+09")
        ]
    )
    others = f"list_filter({series}, lambda p: p.val <> {t} AND {_near(v, 'p.val')})"
    return f"""CASE WHEN {t} IS NULL THEN 'no_ground_truth|' WHEN {v} IS NULL THEN 'wrong|missing'
      WHEN {_near(v, t)} THEN 'correct|'
      WHEN {t} <> 0 AND {_near(f'abs({v})', f'abs({t})')} AND ({v} < 0) <> ({t} < 0) THEN 'wrong|sign'
      {scale}
      WHEN len({others}) > 0 THEN 'wrong|period (matches FY' || {others}[1].period || ')'
      ELSE 'wrong|other' END"""


def _direction_score(pct: str, now: str, prior: str) -> str:
    return f"""CASE WHEN {now} IS NULL OR {prior} IS NULL OR {now} = {prior} THEN 'no_ground_truth|'
      WHEN {pct} IS NULL THEN 'wrong|missing' WHEN round({pct}, 1) = 0 THEN 'wrong|sign'
      WHEN ({pct} > 0) = ({now} > {prior}) THEN 'correct|' ELSE 'wrong|sign' END"""


_SCORES = [
    ("revenue", _value_score("revenue_current", "revenue", "revenue_series")),
    ("net income", _value_score("net_income_current", "net_income", "net_income_series")),
    ("revenue YoY", _direction_score("revenue_pct", "revenue", "revenue_prior")),
    ("net income YoY", _direction_score("net_income_pct", "net_income", "net_income_prior")),
]
SCORES = f"""{TRUTH},
runs(run_date, tag, model, shift) AS (VALUES {_RUNS_SQL}),
records AS (SELECT run_date, tag, model, 'T' || cik AS ticker, cik, fiscal_year, truth.* EXCLUDE (cik, fiscal_year),
    lpad(CAST(CAST(cik AS INTEGER) * 10000 + fiscal_year AS VARCHAR), 18, '0') AS accession_number,
    CASE WHEN (CAST(cik AS INTEGER) * 7 + fiscal_year + shift) % 9 = 8 THEN 'overloaded: busy' END AS error,
    {_altered('revenue')} AS revenue_current, {_altered('net_income')} AS net_income_current,
    {_change('revenue')} AS revenue_pct, {_change('net_income')} AS net_income_pct
  FROM truth, runs),
scored AS ({" UNION ALL ".join(
    f"SELECT run_date, tag, model, ticker, fiscal_year, accession_number, {i} AS position, '{field}' AS field, "
    f"CASE WHEN error IS NOT NULL THEN 'error|' || error ELSE {sql} END AS result FROM records"
    for i, (field, sql) in enumerate(_SCORES))}),
scores AS (SELECT * EXCLUDE (result), split_part(result, '|', 1) AS verdict, substr(result, instr(result, '|') + 1) AS detail
  FROM scored)"""


@query(f"""
WITH {SCORES}
SELECT run_date, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, field, verdict, detail FROM scores""")
def record_scores(spark, sf):
    scores = ev.score_records(records(spark, sf))
    return scores.select("run_date", "ticker", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "field", "verdict", "detail")


_TALLY = """count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong,
  count(*) FILTER (verdict = 'no_ground_truth') AS no_ground_truth, count(*) FILTER (verdict = 'error') AS errors,
  count(*) FILTER (verdict IN ('correct', 'wrong')) AS scored,
  count(*) FILTER (verdict = 'correct') / nullif(count(*) FILTER (verdict IN ('correct', 'wrong')), 0) AS accuracy"""


@query(f"""
WITH {SCORES}
SELECT run_date, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, field, verdict, detail FROM scores""")
def evaluated_runs(spark, sf):
    """The whole evaluation flow: records without truth are joined to resolved facts and scored."""
    rows = records(spark, sf)
    plain = rows.drop("revenue", "revenue_prior", "net_income", "net_income_prior", "revenue_series", "net_income_series")
    scores, _, _ = flows.evaluate(plain, V.duration_facts(spark, sf), V.FLOWS)
    return scores.select("run_date", "ticker", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "field", "verdict", "detail")


@query(f"WITH {SCORES} SELECT ticker, {_TALLY} FROM scores GROUP BY ticker")
def verdict_totals(spark, sf):
    return ev.verdict_totals(ev.score_records(records(spark, sf)), ["ticker"])


@query(f"""
WITH {SCORES}
SELECT run_date, tag, model, '' AS fallback_model, CAST(600000 AS BIGINT) AS max_filing_chars, {_TALLY},
       count(DISTINCT accession_number) AS filings
FROM scores GROUP BY run_date, tag, model""")
def run_history(spark, sf):
    history = ev.run_history(ev.score_records(records(spark, sf)))
    return history.withColumn("max_filing_chars", F.col("max_filing_chars").cast("bigint"))


@query(f"""
WITH {SCORES},
totals AS (SELECT run_date, ticker, {_TALLY} FROM scores GROUP BY run_date, ticker),
moved AS (SELECT n.ticker, n.accuracy, b.accuracy AS baseline_accuracy, (n.accuracy - b.accuracy) * 100 AS points
  FROM totals n LEFT JOIN totals b ON b.ticker = n.ticker AND b.run_date = '2024-01-01' WHERE n.run_date = '2024-02-01')
SELECT ticker, accuracy, baseline_accuracy, round(points, 6) AS delta_points,
  CASE WHEN points IS NULL THEN 'not comparable' WHEN abs(points) < 0.05 THEN 'no change'
       ELSE printf('%+.1f pts', points) END AS change
FROM moved""")
def delta_to_baseline(spark, sf):
    totals = ev.verdict_totals(ev.score_records(records(spark, sf)), ["run_date", "ticker"])
    now = totals.filter(F.col("run_date") == "2024-02-01")
    base = totals.filter(F.col("run_date") == "2024-01-01")
    delta = ev.delta_to_baseline(now, base, ["ticker"])
    return delta.select("ticker", "accuracy", "baseline_accuracy", F.round("delta_points", 6).alias("delta_points"), "change")


@query(f"""
WITH {SCORES},
before AS (SELECT ticker, field, arg_max(verdict, fiscal_year) AS was FROM scores WHERE run_date = '2024-01-01' GROUP BY ALL)
SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, field, detail
FROM scores JOIN before USING (ticker, field)
WHERE run_date = '2024-02-01' AND verdict = 'wrong' AND was = 'correct'""")
def regressions(spark, sf):
    scores = ev.score_records(records(spark, sf))
    found = ev.regressions(
        scores.filter(F.col("run_date") == "2024-02-01"), scores.filter(F.col("run_date") == "2024-01-01")
    )
    return found.withColumn("fiscal_year", F.col("fiscal_year").cast("bigint"))


@query(f"""
WITH {SCORES}
SELECT run_date, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year,
  coalesce('run failed: ' || max(detail) FILTER (verdict = 'error'),
    string_agg(CASE WHEN verdict = 'no_ground_truth' THEN field || ': no XBRL concept' ELSE field || ': ' || detail END, '; '
      ORDER BY position) FILTER (verdict = 'no_ground_truth' OR (verdict = 'wrong' AND detail <> '')), '') AS notes
FROM scores GROUP BY run_date, tag, ticker, fiscal_year, accession_number""")
def record_notes(spark, sf):
    notes = ev.record_notes(ev.score_records(records(spark, sf)))
    return notes.select("run_date", "ticker", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "notes")


@query(f"""
WITH {SCORES},
todo AS (SELECT DISTINCT accession_number FROM records),
kept AS (SELECT accession_number FROM records WHERE run_date = '2024-01-01' AND error IS NULL)
SELECT accession_number, accession_number IN (SELECT accession_number FROM kept) AS reused FROM todo""")
def reusable_records(spark, sf):
    path = shared_folder(spark, "runs")
    columns = ["run_date", "tag", "model", "fallback_model", "max_filing_chars", "ord", "cik", "accession_number", "error"]
    sinks.write_run(records(spark, sf).select(*columns), path)
    rows = sinks.read_runs(spark, path)
    todo = rows.select("accession_number").distinct()
    prior = rows.filter(F.col("artifact") == "2024-01-01")
    config = spark.createDataFrame([("m1", "", 600000)], "model string, fallback_model string, max_filing_chars int")
    reused, left = ev.split_reusable(todo, prior, config)
    return reused.select("accession_number", F.lit(True).alias("reused")).unionByName(
        left.select("accession_number", F.lit(False).alias("reused"))
    )


@query(f"""
WITH {V.frame_sql(V.ANNUAL, ['revenue', 'net_income'], 20, 'CAST(period AS INTEGER) AS fiscal_year')},
{V.DIRECTORY}, {V.FILINGS},
wanted AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END || '-' || p_partkey AS ticker FROM part),
known AS (SELECT w.ticker AS asked, d.ticker, d.cik, d.name FROM wanted w JOIN directory d ON upper(d.ticker) = upper(w.ticker)
  QUALIFY row_number() OVER (PARTITION BY w.ticker ORDER BY d.ord) = 1),
newest AS (SELECT * FROM filings WHERE upper(form_type) = '10-K' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ord) = 1),
entries AS (SELECT k.*, n.accession_number, n.primary_document, n.form_type,
    (SELECT max(fiscal_year) FROM frame f WHERE f.cik = k.cik AND f.fiscal_year <= CAST(substr(n.filing_date, 1, 4) AS INTEGER)) AS fiscal_year
  FROM known k JOIN newest n ON n.cik = k.cik),
flow AS (SELECT v.* FROM candidate_values v WHERE metric IN ('revenue', 'net_income')),
pref AS (SELECT e.asked, e.cik, e.fiscal_year, metric, min(pref) AS pref FROM entries e
  JOIN flow f ON f.cik = e.cik AND CAST(f.period AS INTEGER) = e.fiscal_year GROUP BY ALL),
figures AS (SELECT asked,
    max(val) FILTER (f.metric = 'revenue' AND CAST(period AS INTEGER) = fiscal_year) AS revenue,
    max(val) FILTER (f.metric = 'revenue' AND CAST(period AS INTEGER) = fiscal_year - 1) AS revenue_prior,
    max(val) FILTER (f.metric = 'net_income' AND CAST(period AS INTEGER) = fiscal_year - 1) AS net_income_prior
  FROM pref p JOIN flow f ON f.cik = p.cik AND f.metric = p.metric AND f.pref = p.pref GROUP BY asked)
SELECT ticker, cik, name AS company_name, accession_number, primary_document, form_type, CAST(fiscal_year AS BIGINT) AS fiscal_year,
  concat_ws('; ', CASE WHEN revenue IS NULL THEN 'no XBRL revenue concept covers this year' END,
    CASE WHEN revenue_prior IS NULL OR net_income_prior IS NULL THEN 'prior year missing (YoY unscoreable)' END) AS note, CAST(NULL AS VARCHAR) AS dropped
FROM entries JOIN figures USING (asked)
UNION ALL SELECT w.asked, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k.asked IS NULL THEN 'no exact ticker match' WHEN e.asked IS NULL THEN 'no filing of the form'
    ELSE 'no annual data at or before the filing' END
FROM (SELECT ticker AS asked FROM wanted) w LEFT JOIN known k USING (asked) LEFT JOIN entries e USING (asked) WHERE k.asked IS NULL OR e.asked IS NULL OR e.fiscal_year IS NULL""")
def golden_set(spark, sf):
    """Entries, and below them the tickers that give none with the reason."""
    part = V.table(spark, sf, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    wanted = part.select(F.concat(brand, F.lit("-"), F.col("p_partkey").cast("string")).alias("ticker")).distinct()
    golden, dropped = build_golden(wanted, V.directory(spark, sf), V.filings(spark, sf), V.facts(spark, sf), V.ANNUAL)
    entries = golden.withColumn("fiscal_year", F.col("fiscal_year").cast("bigint")).withColumn("dropped", F.lit(None).cast("string"))
    return entries.unionByName(dropped.select(F.col("asked").alias("ticker"), F.col("reason").alias("dropped")), allowMissingColumns=True)


@query(f"""
WITH {V.DIRECTORY}, {V.FILINGS},
golden AS (SELECT 'every filing' AS name, ticker, f.cik, d.name AS company_name, accession_number, form_type, primary_document FROM filings f JOIN directory d USING (cik)
  UNION ALL SELECT 'first of a company', 'T' || f.cik, f.cik, d.name, accession_number, form_type, primary_document FROM filings f JOIN directory d USING (cik)
    WHERE upper(form_type) IN ('10-K', '10-Q', '10-K/A', '10-Q/A') QUALIFY row_number() OVER (PARTITION BY f.cik ORDER BY f.ord) = 1),
checked AS (SELECT *, coalesce(regexp_full_match(upper(ticker), '[A-Z][A-Z0-9.\\-]{{0,9}}') AND regexp_full_match(cik, '[0-9]{{1,10}}')
    AND regexp_full_match(accession_number, '[0-9]{{10}}-?[0-9]{{2}}-?[0-9]{{6}}') AND length(company_name) BETWEEN 1 AND 200
    AND upper(form_type) IN ('10-K', '10-Q', '10-K/A', '10-Q/A')
    AND regexp_full_match(primary_document, '[A-Za-z0-9._\\-/]{{1,255}}') AND NOT contains(primary_document, '..'), false) AS ok FROM golden)
SELECT name, count(*) AS entries, count(DISTINCT ticker) AS tickers, count(*) FILTER (NOT ok) AS invalid,
  count(*) >= 10 AND count(*) = count(DISTINCT ticker) AND bool_and(ok) AS sound
FROM checked GROUP BY name""")
def golden_integrity(spark, sf):
    """Two golden sets, kept as JSON documents and read back: every filing there is, and the first good one of each company."""
    listed = V.directory(spark, sf).select("cik", "ticker", F.col("name").alias("company_name"))
    filed = V.filings(spark, sf).join(listed, "cik").withColumn("fiscal_year", F.substring("filing_date", 1, 4).cast("int")).withColumn("note", F.lit(None).cast("string"))
    allowed = filed.filter(F.upper("form_type").isin(*S.ALLOWED_FORMS)).withColumn("ticker", F.concat(F.lit("T"), "cik"))
    first = best_row(allowed, ["cik"], [-F.col("ord")])
    columns = [part.split()[0] for part in readers.GOLDEN.split(", ")]
    reports = []
    for name, entries in (("every filing", filed), ("first of a company", first)):
        path = shared_folder(spark, "golden")
        sinks.write_golden(entries.select(*columns), path)
        reports.append(ev.golden_problems(readers.read_golden(spark, path)).select(F.lit(name).alias("name"), "*"))
    return reports[0].unionByName(reports[1])


@query(f"""
WITH {TRUTH}
SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, revenue,
  CASE WHEN fiscal_year % 2 = 0 THEN net_income * 2 ELSE net_income END AS net_income,
  CAST(CASE WHEN fiscal_year % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version
FROM truth""")
def pinned_truth(spark, sf):
    """Truth is pinned, restated, offered again (ignored) and refreshed for even years."""
    path = shared_folder(spark, "truth")
    truth, _ = ops.ground_truth(V.duration_facts(spark, sf), truth_keys(spark, sf), V.FLOWS)
    truth = truth.select("cik", "fiscal_year", "revenue", "net_income")
    sinks.pin_truth(truth, path)
    restated = sinks.pinned_truth(spark, path, truth).drop("version").withColumn("net_income", F.col("net_income") * 2)
    sinks.pin_truth(restated, path)
    sinks.pin_truth(restated.filter(F.col("fiscal_year") % 2 == 0), path, refresh=True)
    return sinks.pinned_truth(spark, path, truth).select(
        "cik", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "revenue", "net_income",
        F.col("version").cast("bigint").alias("version"),
    )


@query(f"""
WITH {SCORES}
SELECT run_date || CASE WHEN tag = '' THEN '' ELSE '-' || tag END AS artifact, ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year,
  revenue_current, error
FROM records WHERE run_date = '2024-02-01'""")
def newest_run(spark, sf):
    """Runs are kept as JSON artifacts, one document each; the newest one is read back."""
    path = shared_folder(spark, "artifacts")
    sinks.write_artifacts(records(spark, sf), path)
    return readers.newest_run(readers.read_runs(spark, path)).select(
        "artifact", "ticker", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "revenue_current", "error"
    )
