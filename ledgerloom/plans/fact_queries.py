"""Fact resolution over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.strings import duration_days
from ledgerloom.operators import facts as ops
from ledgerloom.plans import vehicles as V
from ledgerloom.plans.registry import query
from ledgerloom.sources.readers import parse_concepts


def _year(period: str = "period"):
    return F.col(period).cast("bigint")


@query(f"""
WITH {V.FACTS}
SELECT date_diff('day', {V._DAY.format('"start"')}, {V._DAY.format('"end"')}) AS days, count(*) AS entries
FROM facts GROUP BY 1""")
def fact_durations(spark, sf):
    days = duration_days(F.col("start"), F.col("end")).cast("bigint")
    return V.facts(spark, sf).groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("entries"))


def _winners(kind: str, period: str, unit: str | None = "USD") -> str:
    where = f"kind = '{kind}'" + (f" AND unit = '{unit}'" if unit else "")
    return f"WITH {V.TYPED_FACTS} SELECT cik, concept, unit, {period}, val, first_seen FROM winners WHERE {where}"


@query(_winners("annual", "CAST(period AS BIGINT) AS period"))
def annual_values(spark, sf):
    return ops.annual_values(V.facts(spark, sf)).withColumn("period", _year())


@query(_winners("annual", "CAST(period AS BIGINT) AS period", "USD/shares"))
def annual_values_per_share(spark, sf):
    return ops.annual_values(V.facts(spark, sf), "USD/shares").withColumn("period", _year())


@query(_winners("instant", "CAST(period AS BIGINT) AS period"))
def instant_values(spark, sf):
    return ops.instant_values(V.facts(spark, sf)).withColumn("period", _year())


@query(_winners("quarterly", "period"))
def quarterly_values(spark, sf):
    return ops.quarterly_values(V.facts(spark, sf))


@query(f"WITH {V.selected_sql(V.ANNUAL)} SELECT cik, metric, concept, CAST(period AS BIGINT) AS period, val FROM series")
def selected_series(spark, sf):
    series = ops.resolve_series(V.facts(spark, sf), V.ANNUAL)
    return series.select("cik", "metric", "concept", _year().alias("period"), "val")


@query(f"WITH {V.selected_sql(V.QUARTERLY)} SELECT cik, metric, concept, period, val FROM series")
def selected_quarterly_series(spark, sf):
    return ops.resolve_series(V.duration_facts(spark, sf), V.QUARTERLY).select("cik", "metric", "concept", "period", "val")


_METRICS = ", ".join(S.ANNUAL_METRICS)
ANNUAL_FRAME = V.frame_sql(V.ANNUAL, S.ANNUAL_METRICS, S.MAX_YEARS, "CAST(period AS BIGINT) AS fiscal_year")
QUARTERLY_FRAME = V.frame_sql(V.QUARTERLY, S.FRAME_METRICS, S.MAX_QUARTERS, "period AS period_end")


@query(f"WITH {ANNUAL_FRAME} SELECT cik, fiscal_year, {_METRICS} FROM frame")
def annual_frame(spark, sf):
    frame = ops.annual_frame(V.facts(spark, sf), V.ANNUAL, S.MAX_YEARS)
    return frame.withColumn("fiscal_year", _year("fiscal_year"))


@query(f"WITH {QUARTERLY_FRAME} SELECT cik, period_end, revenue, net_income FROM frame")
def quarterly_frame(spark, sf):
    return ops.quarterly_frame(V.duration_facts(spark, sf), V.QUARTERLY, S.MAX_QUARTERS)


@query(f"""
WITH {ANNUAL_FRAME}, {V.FILINGS}
SELECT accession_number, CAST(max(fiscal_year) AS BIGINT) AS fiscal_year
FROM filings JOIN frame ON filings.cik = frame.cik
WHERE fiscal_year <= CAST(substr(filing_date, 1, 4) AS BIGINT)
GROUP BY accession_number, filings.ord""")
def reported_fiscal_year(spark, sf):
    frame = ops.annual_frame(V.facts(spark, sf), V.ANNUAL, S.MAX_YEARS)
    return ops.pick_fiscal_year(frame, V.filings(spark, sf)).withColumn("fiscal_year", _year("fiscal_year"))


# --- truth -------------------------------------------------------------------------------

def truth_keys(spark, sf) -> DataFrame:
    """Every company and year with an annual fact, and some years nobody reported."""
    values = ops.annual_values(V.duration_facts(spark, sf))
    year = F.col("period")
    years = F.when(F.col("cik").cast("int") % 5 == 0, F.array(year, year + 50)).otherwise(F.array(year))
    return values.select("cik", F.explode(years).alias("fiscal_year")).distinct()


TRUTH = f"""{V.TYPED_FACTS},
{V.candidates_sql('candidates', V.FLOWS)},
candidate_values AS (SELECT cik, metric, concept, pref, period, val, first_seen
  FROM winners JOIN candidates USING (concept, unit, kind)),
own_keys AS (SELECT cik, CAST(period AS INTEGER) AS fiscal_year FROM winners
             WHERE kind = 'annual' AND unit = 'USD' AND concept IN ('A', 'N', 'R')),
truth_keys AS (SELECT * FROM own_keys UNION
               SELECT cik, fiscal_year + 50 FROM own_keys WHERE CAST(cik AS INTEGER) % 5 = 0),
picked AS (SELECT k.cik, fiscal_year, metric, min(pref) AS pref FROM truth_keys k
           JOIN candidate_values v ON v.cik = k.cik AND CAST(v.period AS INTEGER) = k.fiscal_year GROUP BY ALL),
covering AS (SELECT p.*, concept, CAST(v.period AS INTEGER) AS period, val, first_seen
             FROM picked p JOIN candidate_values v USING (cik, metric, pref)),
truth AS (SELECT cik, fiscal_year,
    max(val) FILTER (metric = 'revenue' AND period = fiscal_year) AS revenue,
    max(val) FILTER (metric = 'revenue' AND period = fiscal_year - 1) AS revenue_prior,
    max(val) FILTER (metric = 'net_income' AND period = fiscal_year) AS net_income,
    max(val) FILTER (metric = 'net_income' AND period = fiscal_year - 1) AS net_income_prior,
    list({{'period': period, 'val': val}} ORDER BY first_seen) FILTER (metric = 'revenue') AS revenue_series,
    list({{'period': period, 'val': val}} ORDER BY first_seen) FILTER (metric = 'net_income') AS net_income_series
  FROM covering GROUP BY cik, fiscal_year)"""


@query(f"""
WITH {TRUTH}
SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, metric, concept, CAST(period AS BIGINT) AS period, val FROM covering""")
def covering_series(spark, sf):
    values = ops.candidate_values(V.duration_facts(spark, sf), V.FLOWS)
    rows = ops.series_covering(values, truth_keys(spark, sf))
    return rows.select("cik", _year("fiscal_year").alias("fiscal_year"), "metric", "concept", _year().alias("period"), "val")


@query(f"""
WITH {TRUTH}
SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year, revenue, revenue_prior, net_income, net_income_prior,
       CAST(len(revenue_series) AS BIGINT) AS revenue_years,
       array_to_string(list_transform(revenue_series, lambda p: p.period), ' ') AS revenue_order
FROM truth""")
def ground_truth(spark, sf):
    truth, _ = ops.ground_truth(V.duration_facts(spark, sf), truth_keys(spark, sf), V.FLOWS)
    order = F.array_join(F.transform("revenue_series", lambda p: p["period"].cast("string")), " ")
    some = F.size("revenue_series") > 0
    return truth.select(
        "cik", _year("fiscal_year").alias("fiscal_year"), "revenue", "revenue_prior", "net_income", "net_income_prior",
        F.when(some, F.size("revenue_series")).cast("bigint").alias("revenue_years"), F.when(some, order).alias("revenue_order"),
    )


@query(f"""
WITH {TRUTH}
SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year FROM truth_keys
WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.cik = truth_keys.cik AND t.fiscal_year = truth_keys.fiscal_year)""")
def uncovered_keys(spark, sf):
    _, rejects = ops.ground_truth(V.duration_facts(spark, sf), truth_keys(spark, sf), V.FLOWS)
    return rejects.select("cik", _year("fiscal_year").alias("fiscal_year"))


@query(f"""
WITH {TRUTH}
SELECT cik, CAST(fiscal_year AS BIGINT) AS fiscal_year,
  CASE WHEN revenue_prior <> 0 THEN round((revenue - revenue_prior) / abs(revenue_prior) * 100, 1) END AS revenue_yoy_change_pct,
  CASE WHEN net_income_prior <> 0 THEN round((net_income - net_income_prior) / abs(net_income_prior) * 100, 1) END
    AS net_income_yoy_change_pct
FROM truth""")
def yearly_changes(spark, sf):
    truth, _ = ops.ground_truth(V.duration_facts(spark, sf), truth_keys(spark, sf), V.FLOWS)
    return ops.with_changes(truth).select(
        "cik", _year("fiscal_year").alias("fiscal_year"), "revenue_yoy_change_pct", "net_income_yoy_change_pct"
    )


# --- points ----------------------------------------------------------------------------------

@query(f"""
WITH {ANNUAL_FRAME}
SELECT cik, 'FY' || fiscal_year AS label, CAST(fiscal_year AS VARCHAR) AS sort_key, revenue, net_income
FROM frame WHERE revenue IS NOT NULL OR net_income IS NOT NULL""")
def annual_points(spark, sf):
    return ops.annual_points(ops.annual_frame(V.facts(spark, sf), V.ANNUAL, S.MAX_YEARS))


@query(f"""
WITH {QUARTERLY_FRAME}
SELECT cik, strftime(CAST(period_end AS DATE), '%b %-d, %Y') AS label, period_end AS sort_key, revenue, net_income
FROM frame""")
def quarterly_points(spark, sf):
    return ops.quarterly_points(ops.quarterly_frame(V.duration_facts(spark, sf), V.QUARTERLY, S.MAX_QUARTERS))


@query(f"""
WITH {ANNUAL_FRAME},
{V.ANALYSES},
quarters AS (WITH {QUARTERLY_FRAME} SELECT cik FROM frame WHERE revenue IS NOT NULL OR net_income IS NOT NULL),
a AS (SELECT cik, count(*) AS annual_points FROM frame GROUP BY cik),
q AS (SELECT cik, count(*) AS quarterly_points FROM quarters GROUP BY cik),
h AS (SELECT cik, count(*) AS history_points FROM analyses
      WHERE filing_date IS NOT NULL AND revenue_current IS NOT NULL GROUP BY cik)
SELECT cik, coalesce(annual_points, 0) AS annual_points, coalesce(quarterly_points, 0) AS quarterly_points, coalesce(history_points, 0) AS history_points,
       CASE WHEN coalesce(annual_points, 0) >= 2 OR coalesce(quarterly_points, 0) >= 2 THEN 'facts'
            WHEN coalesce(history_points, 0) >= 2 THEN 'history' ELSE 'none' END AS source
FROM a FULL OUTER JOIN q USING (cik) FULL OUTER JOIN h USING (cik)""")
def trend_sources(spark, sf):
    annual = ops.annual_points(ops.annual_frame(V.facts(spark, sf), V.ANNUAL, S.MAX_YEARS))
    history = ops.history_points(V.analyses(spark, sf))
    quarterly = ops.quarterly_points(ops.quarterly_frame(V.duration_facts(spark, sf), V.QUARTERLY, S.MAX_QUARTERS))
    return ops.trend_source(annual, quarterly, history)


@query(f"""
WITH {ANNUAL_FRAME}
SELECT cik, bool_or(coalesce(eps_diluted, operating_cash_flow, cash, total_assets, stockholders_equity) IS NOT NULL)
  AS has_extra_metrics
FROM frame GROUP BY cik""")
def extra_metrics(spark, sf):
    return ops.has_extra_metrics(ops.annual_frame(V.facts(spark, sf), V.ANNUAL, S.MAX_YEARS))


# --- documents -----------------------------------------------------------------------------------

@query(f"""
WITH {V.DURATION_FACTS}
SELECT cik, concept, unit, "end", count(*) AS entries, round(sum(val), 2) AS total, max(filed) AS last_filed
FROM duration_facts GROUP BY ALL""")
def concept_documents(spark, sf):
    """Facts packed into JSON documents of a company, concept and a thousand orders, and read back."""
    facts = V.duration_facts(spark, sf).withColumn("shard", F.floor(F.col("ord") / 8000))
    per_unit = facts.groupBy("cik", "concept", "shard", "unit").agg(
        F.sort_array(F.collect_list(F.struct("ord", "start", "end", "val", "filed"))).alias("entries")
    )
    entries = F.transform("entries", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"),
                                                        e["val"].alias("val"), e["filed"].alias("filed")))
    documents = per_unit.select(
        "cik", "concept", F.to_json(F.struct(F.create_map(F.col("unit"), entries).alias("units"))).alias("json")
    )
    read = parse_concepts(documents)
    return read.groupBy("cik", "concept", "unit", "end").agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.sum("val"), 2).alias("total"), F.max("filed").alias("last_filed")
    )
