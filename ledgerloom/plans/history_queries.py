"""Retrieval, filing history, directory and raw documents over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import settings as S
from ledgerloom.functions import formatting as fmt, similarity as sim, strings as st
from ledgerloom.functions.documents import excerpt, valid_question
from ledgerloom.operators import documents as docs, facts as ops, history as hist, retrieval as ret
from ledgerloom.plans import flows, vehicles as V
from ledgerloom.plans.fact_queries import ANNUAL_FRAME
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers, sinks


# --- retrieval --------------------------------------------------------------------------

_ROUND = "round(similarity, 6) AS similarity"


@query(f"WITH {V.VECTORS} SELECT question_id, accession_number, chunk_index, content, rank, {_ROUND} FROM matches")
def match_chunks(spark, sf):
    found = ret.match_chunks(V.questions(spark, sf), V.vectors(spark, sf))
    return found.select(
        "question_id", "accession_number", "chunk_index", "content", F.col("rank").cast("bigint").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@query(f"WITH {V.VECTORS} SELECT question_id, chunk_index, content, {_ROUND} FROM matches WHERE rank <= 4")
def match_chunks_function(spark, sf):
    """The SQL table function, called laterally for every question."""
    ret.register_match_chunks(V.vectors(spark, sf))
    asked = V.questions(spark, sf).select("question_id", "accession_number", F.col("vector").cast("array<double>").alias("vector"))
    asked.createOrReplaceTempView("asked_filings")
    return spark.sql("""
        SELECT q.question_id, m.chunk_index, m.content, round(m.similarity, 6) AS similarity
        FROM asked_filings q, LATERAL match_chunks(q.accession_number, q.vector, 4) m""")


@query(f"WITH {V.VECTORS} SELECT question_id, accession_number, chunk_index, content, rank, {_ROUND} FROM matches")
def match_stored_vectors(spark, sf):
    """Vectors stored with their norms and angles to a few pivots; searches leave out what the bounds rule out."""
    chunks = V.vectors(spark, sf)
    vectors, pivots, blocks = (shared_folder(spark, name) for name in ("vectors", "pivots", "blocks"))
    ret.vector_pivots(chunks).write.parquet(pivots)
    ret.with_angles(chunks, spark.read.parquet(pivots)).write.partitionBy("block").parquet(vectors)
    stored = spark.read.parquet(vectors)
    ret.vector_blocks(stored).write.parquet(blocks)
    found = ret.match_in_blocks(V.questions(spark, sf), stored, spark.read.parquet(pivots), spark.read.parquet(blocks))
    return found.select(
        "question_id", "accession_number", "chunk_index", "content", F.col("rank").cast("bigint").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@query(f"""
WITH {V.VECTORS},
scales AS (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN 'Amounts in millions.' END AS unit_scale FROM questions)
SELECT question_id, 'Question: ' || question || chr(10) || chr(10) || coalesce('Unit scale: ' || unit_scale || chr(10) || chr(10), '')
    || 'Excerpts from the filing:' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(chunk_index || '=' || left(content, 300), '|' ORDER BY rank) AS sources, unit_scale
FROM questions JOIN matches USING (question_id) JOIN scales USING (question_id) GROUP BY question_id, question, unit_scale""")
def question_context(spark, sf):
    asked = V.questions(spark, sf)
    scales = asked.select("question_id", F.when(F.col("question_id") % 2 == 0, "Amounts in millions.").alias("unit_scale"))
    found = ret.match_chunks(asked, V.vectors(spark, sf))
    context = ret.question_context(asked.select("question_id", "question"), found, scales)
    sources = F.transform("sources", lambda s: F.concat(s["chunk_index"].cast("string"), F.lit("="), s["excerpt"]))
    return context.select("question_id", "context", F.array_join(sources, "|").alias("sources"), "unit_scale")


@query(f"""
WITH {V.VECTORS},
noted AS (SELECT accession_number, chunk_index, content || CASE WHEN chunk_index % 3 = 0 THEN ' (in thousands, item ' || chunk_index || ')'
    WHEN chunk_index % 3 = 1 THEN ' one in millions of' ELSE '' END AS content,
    CASE WHEN chunk_index % 3 = 0 THEN 'In thousands, item ' || chunk_index || '.' END AS scale FROM vectors),
anchors AS (SELECT question_id, accession_number, chunk_index AS anchor FROM matches WHERE rank = 1),
ranked AS (SELECT question_id, scale, m.chunk_index <= anchor AS above,
    bool_or(m.chunk_index <= anchor) OVER (PARTITION BY question_id) AS any_above,
    row_number() OVER (PARTITION BY question_id, m.chunk_index <= anchor ORDER BY CASE WHEN m.chunk_index <= anchor THEN -m.chunk_index ELSE m.chunk_index END) AS place
  FROM anchors a JOIN noted m USING (accession_number) WHERE m.chunk_index % 3 < 2),
scales AS (SELECT question_id, arg_min(scale, place) FILTER (scale IS NOT NULL) AS unit_scale FROM ranked WHERE above = any_above AND place <= 3 GROUP BY question_id)
SELECT question_id, 'Question: ' || question || chr(10) || chr(10) || coalesce('Unit scale: ' || unit_scale || chr(10) || chr(10), '')
    || 'Excerpts from the filing:' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || n.content, chr(10) || chr(10) ORDER BY rank) AS context, unit_scale
FROM questions JOIN matches m USING (question_id) JOIN noted n ON n.accession_number = m.accession_number AND n.chunk_index = m.chunk_index
LEFT JOIN scales USING (question_id) GROUP BY question_id, question, unit_scale""")
def asked_questions(spark, sf):
    """The whole question flow: validation, nearest chunks, unit declaration, prompt text."""
    index = F.col("chunk_index")
    note = (
        F.when(index % 3 == 0, F.concat(F.lit(" (in thousands, item "), index.cast("string"), F.lit(")")))
        .when(index % 3 == 1, " one in millions of").otherwise("")
    )
    chunks = V.vectors(spark, sf).withColumn("content", F.concat("content", note))
    return flows.ask(V.questions(spark, sf), chunks).select("question_id", "context", "unit_scale")


@query("""
SELECT conv_id, turn, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 3 AND 300 AS valid, left(text, 300) AS excerpt
FROM conversations""")
def question_checks(spark, sf):
    turns = V.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", valid_question(F.col("text")).alias("valid"), excerpt(F.col("text")).alias("excerpt"))


# --- prior filing, staleness, comparison ---------------------------------------------------

@query(f"""
WITH {V.ANALYSES}
SELECT a.id, (SELECT b.id FROM analyses b WHERE b.ticker = a.ticker AND b.filing_date < a.filing_date
              ORDER BY b.filing_date DESC, b.created_at DESC, b.id DESC LIMIT 1) AS prior_id
FROM analyses a""")
def prior_analysis(spark, sf):
    return hist.prior_analysis(V.analyses(spark, sf)).select("id", "prior_id")


@query(f"""
WITH {V.ANALYSES},
recent AS (SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id DESC) <= 12)
SELECT a.id, (SELECT b.id FROM recent b WHERE b.ticker = a.ticker AND b.filing_date < a.filing_date
              ORDER BY b.filing_date DESC, b.created_at DESC, b.id DESC LIMIT 1) AS prior_id
FROM analyses a""")
def prior_analysis_in_history(spark, sf):
    """As the dashboard does it: only the 12 newest analyses are searched."""
    return hist.prior_analysis(V.analyses(spark, sf), limit=S.HISTORY_ROWS).select("id", "prior_id")


_STALE = """
watched AS (SELECT CAST(c_custkey AS VARCHAR) AS cik, 'T' || c_custkey AS ticker FROM customer),
newest_filing AS (SELECT cik, filing_date FROM filings WHERE upper(form_type) IN ('10-K', '10-Q')
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ord) = 1),
newest AS (SELECT ticker, filing_date FROM analyses QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {order}) = 1)
SELECT w.ticker, f.filing_date AS latest_filing, CAST(n.filing_date AS VARCHAR) AS analyzed_filing,
  f.filing_date IS NOT NULL AND (n.filing_date IS NULL OR f.filing_date > CAST(n.filing_date AS VARCHAR)) AS has_new_filing
FROM watched w LEFT JOIN newest_filing f USING (cik) LEFT JOIN newest n USING (ticker)"""


def _stale(spark, sf, by_filing_date):
    watched = V.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("cik"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker")
    )
    analyses = V.analyses(spark, sf).withColumn("filing_date", F.col("filing_date").cast("string"))
    stale = hist.stale_companies(watched, V.filings(spark, sf), analyses, by_filing_date)
    return stale.select("ticker", "latest_filing", "analyzed_filing", "has_new_filing")


@query(f"WITH {V.ANALYSES}, {V.FILINGS}, {_STALE.format(order='created_at DESC, id DESC')}")
def stale_companies(spark, sf):
    return _stale(spark, sf, False)


@query(f"WITH {V.ANALYSES}, {V.FILINGS}, {_STALE.format(order='filing_date DESC NULLS LAST, created_at DESC, id DESC')}")
def stale_companies_by_filing_date(spark, sf):
    return _stale(spark, sf, True)


_LATEST = "latest AS (SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id DESC) = 1)"


@query(f"WITH {V.ANALYSES}, {_LATEST} SELECT ticker, id, CAST(filing_date AS VARCHAR) AS filing_date, revenue_current FROM latest")
def latest_analyses(spark, sf):
    latest = hist.latest_analysis(V.analyses(spark, sf))
    return latest.select("ticker", "id", F.col("filing_date").cast("string").alias("filing_date"), "revenue_current")


@query(f"""
WITH {V.ANALYSES}, {_LATEST},
pairs AS (SELECT 'T' || c_custkey AS left_ticker, 'T' || (c_custkey + 3) AS right_ticker FROM customer)
SELECT left_ticker, right_ticker, a.id AS left_id, a.revenue_current AS left_revenue_current, b.id AS right_id, b.revenue_current AS right_revenue_current
FROM pairs LEFT JOIN latest a ON a.ticker = left_ticker LEFT JOIN latest b ON b.ticker = right_ticker""")
def compare_companies(spark, sf):
    key = F.col("c_custkey")
    pairs = V.table(spark, sf, "customer").select(
        F.concat(F.lit("T"), key.cast("string")).alias("left_ticker"), F.concat(F.lit("T"), (key + 3).cast("string")).alias("right_ticker")
    )
    return hist.compare_companies(pairs, V.analyses(spark, sf), ["id", "revenue_current"])


# --- risk drift -------------------------------------------------------------------------------

_WORDS = (
    "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "], w)))"
)
_TURNS = """
turns AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda s: trim(s)), lambda s: s <> '') AS risks
  FROM conversations),
pairs AS (SELECT conv_id, turn, risks, lag(risks) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM turns)"""


def _risk_turns(spark, sf):
    """User turns as analyses of their conversation, one sentence per risk."""
    turns = V.table(spark, sf, "conversations")
    risks = F.filter(F.transform(F.split("text", r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("turn").cast("int"))
    return turns.select(
        F.col("conv_id").cast("string").alias("ticker"), "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        day.alias("filing_date"), day.cast("timestamp").alias("created_at"), risks.alias("risk_factors"),
    )


@query(f"""
WITH {_TURNS},
now AS (SELECT conv_id, turn, i, risks[i] AS risk, {_WORDS.format('risks[i]')} AS words FROM (SELECT *, unnest(range(1, len(risks) + 1)) AS i FROM pairs WHERE len(prior) > 0)),
before AS (SELECT conv_id, turn, i, prior[i] AS risk, {_WORDS.format('prior[i]')} AS words FROM (SELECT *, unnest(range(1, len(prior) + 1)) AS i FROM pairs WHERE len(risks) > 0)),
alike AS (SELECT n.conv_id, n.turn, n.i AS i, b.i AS j FROM now n JOIN before b ON b.conv_id = n.conv_id AND b.turn = n.turn
  WHERE len(n.words) > 0 AND len(b.words) > 0
    AND len(list_intersect(n.words, b.words)) / (len(n.words) + len(b.words) - len(list_intersect(n.words, b.words))) >= 0.25::DOUBLE),
fresh AS (SELECT conv_id, turn, string_agg(CASE WHEN (conv_id, turn, i) IN (SELECT conv_id, turn, i FROM alike) THEN '0' ELSE '1' END, '' ORDER BY i) AS is_new FROM now GROUP BY ALL),
gone AS (SELECT conv_id, turn, string_agg(risk, '|' ORDER BY i) AS dropped FROM before
  WHERE (conv_id, turn, i) NOT IN (SELECT conv_id, turn, j FROM alike) GROUP BY ALL)
SELECT conv_id, turn, is_new, CASE WHEN is_new IS NOT NULL THEN coalesce(dropped, '') END AS dropped
FROM pairs LEFT JOIN fresh USING (conv_id, turn) LEFT JOIN gone USING (conv_id, turn)""")
def risk_drift(spark, sf):
    pairs = hist.prior_analysis(_risk_turns(spark, sf), columns=["risk_factors"])
    drift = hist.risk_drift(pairs)
    marks = F.array_join(F.transform("is_new", lambda new: F.when(new, "1").otherwise("0")), "")
    return drift.select("conv_id", "turn", marks.alias("is_new"), F.array_join("dropped", "|").alias("dropped"))


@query(f"""
WITH {_TURNS},
risks AS (SELECT conv_id * 1000 + turn AS id, turn AS day, i, risks[i] AS risk, list_sort({_WORDS.format('risks[i]')}) AS words
  FROM (SELECT *, unnest(range(1, len(risks) + 1)) AS i FROM turns)),
sets AS (SELECT words, len(words) AS n, min((day, id)) AS first FROM risks WHERE len(words) > 0 GROUP BY words),
postings AS (SELECT words, n, first, unnest(words) AS word FROM sets),
similar_sets AS (SELECT a.words, b.first FROM postings a JOIN postings b ON a.word = b.word AND b.first <= a.first
  GROUP BY a.words, b.words, b.first, a.n, b.n HAVING 4 * count(*) >= a.n + b.n - count(*)),
alike AS (SELECT words, min(first) AS earliest FROM similar_sets GROUP BY words)
SELECT id, CAST(i - 1 AS BIGINT) AS position, risk, coalesce(earliest[2], id) AS first_id, coalesce(earliest[2], id) = id AS is_new
FROM risks LEFT JOIN alike USING (words)""")
def corpus_risk_drift(spark, sf):
    """Every sentence of every conversation against those of all earlier ones, whoever's they are."""
    drift = hist.corpus_risk_drift(_risk_turns(spark, sf))
    return drift.select("id", F.col("position").cast("bigint").alias("position"), "risk", "first_id", "is_new")


@query(f"""
SELECT doc_id, CAST(len(words) AS BIGINT) AS words, array_to_string(list_sort(words), ' ') AS sorted_words
FROM (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents)""")
def content_words(spark, sf):
    words = sim.content_words(F.col("text"))
    rows = V.documents(spark, sf).select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("words"), F.array_join(F.array_sort("w"), " ").alias("sorted_words"))


@query(f"""
WITH words AS (SELECT d.doc_id, {_WORDS.format('d.text')} AS a, {_WORDS.format('e.text')} AS b
  FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1)
SELECT doc_id, len(list_intersect(a, b)) AS shared,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS similarity
FROM words""")
def text_similarity(spark, sf):
    """Every document against the one after it; the words of each are taken once and serve both pairs."""
    words = V.documents(spark, sf).select("doc_id", sim.content_words(F.col("text")).alias("w"))
    sides = F.explode(F.array(
        F.struct(F.col("doc_id").alias("pair"), F.col("w").alias("a"), F.lit(None).cast("array<string>").alias("b")),
        F.struct((F.col("doc_id") - 1).alias("pair"), F.lit(None).cast("array<string>").alias("a"), F.col("w").alias("b")),
    )).alias("s")
    pairs = words.select(sides).groupBy(F.col("s.pair").alias("doc_id")).agg(F.max("s.a").alias("a"), F.max("s.b").alias("b"))
    return pairs.dropna().select(
        "doc_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"), sim.jaccard(F.col("a"), F.col("b")).alias("similarity")
    )


@query("""
WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN ['We report NO material Changes here: ' || text] WHEN conv_id % 3 = 1 THEN CAST([] AS VARCHAR[])
  ELSE [text, 'no material changes'] END AS risks FROM conversations)
SELECT conv_id, turn, len(risks) > 0 AND NOT (len(risks) = 1 AND contains(lower(risks[1]), 'no material changes')) AS substantive FROM r""")
def substantive_risks(spark, sf):
    turns = V.table(spark, sf, "conversations")
    risks = (
        F.when(F.col("conv_id") % 3 == 0, F.array(F.concat(F.lit("We report NO material Changes here: "), "text")))
        .when(F.col("conv_id") % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array("text", F.lit("no material changes")))
    )
    return turns.select("conv_id", "turn", sim.substantive_risks(risks).alias("substantive"))


# --- directory, pages, filters ---------------------------------------------------------------------

_QUERIES = """
queries AS (SELECT DISTINCT lower(p_brand) AS query FROM part UNION SELECT DISTINCT ' ' || split_part(p_name, ' ', 2) || ' ' FROM part
  UNION SELECT DISTINCT left(split_part(p_name, ' ', 1), 2) FROM part UNION SELECT DISTINCT '-' || p_size FROM part UNION SELECT '  ')"""


@query(f"""
WITH {V.DIRECTORY}, {_QUERIES},
found AS (SELECT query, cik, ticker, name, ord,
    CASE WHEN upper(ticker) = q THEN 0 WHEN starts_with(upper(ticker), q) THEN 1 ELSE 2 END AS tier
  FROM (SELECT query, trim(upper(query)) AS q FROM queries WHERE trim(query) <> '') JOIN directory ON contains(upper(ticker), q) OR contains(upper(name), q))
SELECT query, cik, ticker, name, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY query ORDER BY tier, ord) AS rank
FROM found QUALIFY rank <= 10""")
def search_directory(spark, sf):
    part = V.table(spark, sf, "part")
    words = F.split("p_name", " ")
    asked = [
        F.lower("p_brand"), F.concat(F.lit(" "), words[1], F.lit(" ")), F.substring(words[0], 1, 2),
        F.concat(F.lit("-"), F.col("p_size").cast("string")), F.lit("  "),
    ]
    queries = part.select(F.explode(F.array(*asked)).alias("query")).distinct()
    found = hist.search_directory(queries, V.directory(spark, sf))
    return found.select("query", "cik", "ticker", "name", F.col("tier").cast("bigint").alias("tier"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""
WITH {V.ANALYSES}
SELECT id, ticker, (SELECT count(*) FROM analyses) AS total FROM analyses ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""")
def analyses_page(spark, sf):
    return hist.page(V.analyses(spark, sf), limit=20, offset=40).select("id", "ticker", "total")


@query(f"""
WITH {V.ANALYSES}
SELECT id, ticker, (SELECT count(*) FROM analyses) AS total FROM analyses ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 1000""")
def deep_page(spark, sf):
    """A page a thousand analyses down, by an index that is kept."""
    rows, path = V.analyses(spark, sf), shared_folder(spark, "page-index")
    hist.page_index(rows).write.parquet(path)
    return hist.page(rows, limit=20, offset=1000, index=spark.read.parquet(path)).select("id", "ticker", "total")


@query(f"""
WITH {V.ANALYSES}
SELECT id, ticker, (SELECT count(*) FROM analyses WHERE ticker = 'T7') AS total FROM analyses WHERE ticker = 'T7' ORDER BY created_at DESC, id DESC LIMIT 5""")
def ticker_page(spark, sf):
    return hist.page(V.analyses(spark, sf), limit=5, ticker="t7").select("id", "ticker", "total")


@query(f"WITH {V.ANALYSES} SELECT ticker, count(*) AS total FROM analyses GROUP BY ticker")
def ticker_totals(spark, sf):
    return V.analyses(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("total"))


@query(f"""
WITH {V.ANALYSES}
SELECT id, accession_number, ticker FROM analyses WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def analyses_lookup(spark, sf):
    lines = V.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 49)
    wanted = lines.select(F.lpad(F.col("l_orderkey").cast("string"), 18, "0").alias("accession_number"))
    return hist.lookup(V.analyses(spark, sf), wanted).select("id", "accession_number", "ticker")


@query(f"WITH {V.FILINGS} SELECT cik, accession_number, form_type FROM filings WHERE upper(form_type) IN ('10-K/A', '10-Q')")
def form_filter(spark, sf):
    return hist.by_forms(V.filings(spark, sf), " 10-k/a, 10-Q").select("cik", "accession_number", "form_type")


@query(f"""
WITH {V.FILINGS}
SELECT cik, accession_number, ord FROM filings WHERE upper(form_type) IN ('10-K', '10-Q')
QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ord) <= 3""")
def first_filings(spark, sf):
    return hist.first_filings(V.filings(spark, sf), 3).select("cik", "accession_number", "ord")


_PROFILE_COUNTS = """CAST(len(filings) AS BIGINT) AS filings, CAST(len(years) AS BIGINT) AS years"""


@query(f"""
WITH {ANNUAL_FRAME}, {V.FILINGS}, {V.DIRECTORY}, {V.ANALYSES},
firsts AS (SELECT cik, string_agg(accession_number, ' ' ORDER BY ord) AS filings FROM (SELECT * FROM filings WHERE upper(form_type) IN ('10-K', '10-Q')
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ord) <= 10) GROUP BY cik),
years AS (SELECT cik, string_agg(fiscal_year, ' ' ORDER BY fiscal_year) AS years FROM frame GROUP BY cik),
news AS (SELECT ticker, string_agg(id, ' ' ORDER BY created_at DESC, id DESC) AS history FROM (SELECT *, FROM (SELECT replace(ticker, 'T', 'LISTED-') AS ticker, id, created_at FROM analyses)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id DESC) <= 12) GROUP BY ticker),
listed AS (SELECT cik, 'LISTED-' || cik AS ticker, name FROM directory)
SELECT ticker, cik, name, filings, years, history
FROM listed LEFT JOIN firsts USING (cik) LEFT JOIN years USING (cik) LEFT JOIN news USING (ticker)""")
def company_profile(spark, sf):
    listed = V.directory(spark, sf).withColumn("ticker", F.concat(F.lit("LISTED-"), "cik"))
    wanted = listed.select(F.lower("ticker").alias("ticker"))
    analyses = V.analyses(spark, sf).withColumn("ticker", F.replace("ticker", F.lit("T"), F.lit("LISTED-")))
    facts = V.facts(spark, sf)
    profile = hist.company_profile(
        wanted, listed, V.filings(spark, sf), ops.annual_frame(facts, V.ANNUAL, S.MAX_YEARS), ops.quarterly_frame(facts, V.QUARTERLY, S.MAX_QUARTERS), analyses,
        S.FILINGS_PER_COMPANY, S.HISTORY_ROWS
    )

    def joined(name, field):
        return F.array_join(F.transform(name, lambda x: x[field].cast("string")), " ").alias(name)

    return profile.select(
        "ticker", "cik", "name", joined("filings", "accession_number"), joined("years", "fiscal_year"), joined("history", "id")
    )


# --- identifiers -----------------------------------------------------------------------------------

@query("""
WITH r AS (SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN ' ab-' || o_custkey || ' ' WHEN o_orderkey % 4 = 1 THEN o_custkey || 'X' ELSE 'T' || o_orderkey * 99999999 END AS ticker,
    CASE WHEN o_orderkey % 5 = 0 THEN ' ' || o_custkey || ' ' WHEN o_orderkey % 5 = 1 THEN '12345678901' ELSE 'c' || o_custkey END AS cik,
    CASE WHEN o_orderkey % 3 = 0 THEN '0000000001-22-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') WHEN o_orderkey % 3 = 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 18, '0') ELSE 'x' || o_orderkey END AS acc,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS company,
    CASE WHEN o_orderkey % 7 < 3 THEN ' 10-k/a ' ELSE '8-K' END AS form,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a/../b.htm' ELSE 'd' || o_orderkey || '.htm' END AS document FROM orders)
SELECT o_orderkey AS id, concat_ws(',',
  CASE WHEN NOT regexp_full_match(upper(trim(ticker)), '[A-Z][A-Z0-9.\\-]{0,9}') THEN 'ticker' END,
  CASE WHEN NOT regexp_full_match(trim(cik), '[0-9]{1,10}') THEN 'cik' END,
  CASE WHEN NOT regexp_full_match(acc, '[0-9]{10}-?[0-9]{2}-?[0-9]{6}') THEN 'accession_number' END,
  CASE WHEN length(company) NOT BETWEEN 1 AND 200 THEN 'company_name' END,
  CASE WHEN upper(trim(form)) NOT IN ('10-K', '10-Q', '10-K/A', '10-Q/A') THEN 'form_type' END,
  CASE WHEN contains(document, '..') OR NOT regexp_full_match(document, '[A-Za-z0-9._\\-/]{1,255}') THEN 'primary_document' END) AS errors,
  upper(trim(ticker)) AS ticker, replace(acc, '-', '') AS accession_number
FROM r""")
def request_validation(spark, sf):
    orders = V.table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = key.cast("string")
    ticker = (
        F.when(key % 4 == 0, F.concat(F.lit(" ab-"), cust, F.lit(" "))).when(key % 4 == 1, F.concat(cust, F.lit("X")))
        .otherwise(F.concat(F.lit("T"), (key * 99999999).cast("string")))
    )
    cik = F.when(key % 5 == 0, F.concat(F.lit(" "), cust, F.lit(" "))).when(key % 5 == 1, "12345678901").otherwise(F.concat(F.lit("c"), cust))
    accession = (
        F.when(key % 3 == 0, F.concat(F.lit("0000000001-22-"), F.lpad((key % 1000000).cast("string"), 6, "0")))
        .when(key % 3 == 1, F.lpad(text, 18, "0")).otherwise(F.concat(F.lit("x"), text))
    )
    company = F.when(key % 6 == 0, "").otherwise(F.col("o_orderpriority"))
    form = F.when(key % 7 < 3, " 10-k/a ").otherwise("8-K")
    document = F.when(key % 2 == 0, "a/../b.htm").otherwise(F.concat(F.lit("d"), text, F.lit(".htm")))
    errors = st.request_errors(ticker, cik, accession, company, form, document)
    return orders.select(
        key.alias("id"), F.array_join(errors, ",").alias("errors"), st.normal_ticker(ticker).alias("ticker"),
        st.dashless(accession).alias("accession_number"),
    )


@query(f"""
WITH {V.FILINGS}
SELECT accession_number, CASE WHEN length(cik) < 10 THEN lpad(cik, 10, '0') ELSE cik END AS padded,
  'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession_number, '-', '') || '/' AS url,
  upper(form_type) LIKE '10-K%' AS annual_form
FROM filings""")
def identifier_formats(spark, sf):
    padded = st.pad_cik(F.col("cik"))
    return V.filings(spark, sf).select(
        "accession_number", padded.alias("padded"), st.index_url(padded, F.col("accession_number")).alias("url"),
        st.is_annual_form(F.upper("form_type")).alias("annual_form"),
    )


# --- raw documents ---------------------------------------------------------------------------------

@query(f"WITH {V.DIRECTORY} SELECT CAST(ord AS BIGINT) // 100 AS shard, cik, ticker, name, CAST(ord % 100 AS BIGINT) AS ord FROM directory")
def directory_documents(spark, sf):
    """Directory documents of a hundred companies each, packed as JSON and read back in order."""
    companies = V.directory(spark, sf)
    entry = F.struct(F.col("cik").cast("bigint").alias("cik_str"), "ticker", F.col("name").alias("title"))
    shard = companies.groupBy((F.col("ord") / 100).cast("bigint").alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("rows")
    )
    document = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["ord"].cast("string").alias("key"), r["entry"].alias("value"))))
    read = readers.parse_directory(shard.select("shard", F.to_json(document).alias("json")))
    return read.withColumn("ord", F.col("ord").cast("bigint"))


@query(f"""
WITH {V.FILINGS}
SELECT cik, ord // 1000 AS shard, accession_number, form_type, filing_date, primary_document,
  CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY cik, ord // 1000) - 1 THEN primary_doc_description END AS primary_doc_description,
  row_number() OVER w - 1 AS ord
FROM filings WINDOW w AS (PARTITION BY cik, ord // 1000 ORDER BY ord)""")
def filing_index_documents(spark, sf):
    """Index documents of at most a thousand filings as parallel arrays, the descriptions one short."""
    rows = V.filings(spark, sf).withColumn("shard", F.floor(F.col("ord") / 1000))
    packed = rows.groupBy("cik", "shard").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "form_type", "accession_number", "filing_date", "primary_document", "primary_doc_description"
    ))).alias("r"))
    short = F.slice(F.col("r"), F.lit(1), F.size("r") - 1)
    recent = F.struct(
        F.col("r.form_type").alias("form"), F.col("r.accession_number").alias("accessionNumber"), F.col("r.filing_date").alias("filingDate"),
        F.col("r.primary_document").alias("primaryDocument"),
        F.transform(short, lambda x: x["primary_doc_description"]).alias("primaryDocDescription"),
    )
    document = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    read = readers.parse_filing_index(packed.select("cik", "shard", document.alias("json")))
    return read.withColumn("ord", F.col("ord").cast("bigint"))


# --- model output and stored analyses ----------------------------------------------------------------

_ATTEMPTS = """
attempts AS (SELECT o_orderkey, attempt, o_totalprice, CASE WHEN (o_orderkey + attempt) % 3 = 0 THEN 'broken' WHEN (o_orderkey + attempt) % 3 = 1 THEN 'missing' ELSE 'good' END AS kind
  FROM orders, (VALUES (1), (2), (3)) t(attempt))"""


@query(f"""
WITH {_ATTEMPTS},
valid AS (SELECT o_orderkey, min(attempt) AS attempt FROM attempts WHERE kind = 'good' AND attempt <= 2 GROUP BY ALL)
SELECT lpad(CAST(o.o_orderkey AS VARCHAR), 18, '0') AS accession_number, v.o_orderkey IS NOT NULL AS valid,
  CASE WHEN v.o_orderkey IS NOT NULL THEN o_totalprice * attempt END AS revenue_current,
  CASE WHEN v.o_orderkey IS NOT NULL THEN 'a|b' || attempt END AS risks
FROM orders o LEFT JOIN valid v USING (o_orderkey)""")
def extraction_attempts(spark, sf):
    """Model outputs, some truncated or without a field; the first valid one of two attempts counts."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    tries = orders.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    rule = (F.col("o_orderkey") + F.col("attempt")) % 3
    metric = F.struct((F.col("o_totalprice") * F.col("attempt")).alias("current"), F.lit(None).cast("double").alias("yoy_change_pct"))
    full = F.struct(
        metric.alias("revenue"), metric.alias("net_income"),
        F.array(F.lit("a"), F.concat(F.lit("b"), F.col("attempt").cast("string"))).alias("risk_factors"),
        F.lit("none").alias("management_guidance"), F.when(rule != 1, "fine").alias("summary"),
    )
    output = F.when(rule == 0, F.lit('{"revenue": {"current": 1')).otherwise(F.to_json(full))
    attempts = tries.select(F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("accession_number"), "attempt", output.alias("output"))
    good, malformed = readers.first_valid_extraction(attempts, 2)
    flat = readers.flatten_extraction(good).select(
        "accession_number", F.lit(True).alias("valid"), "revenue_current", F.array_join("risk_factors", "|").alias("risks")
    )
    rejected = malformed.select(
        "accession_number", F.lit(False).alias("valid"), F.lit(None).cast("double").alias("revenue_current"), F.lit(None).cast("string").alias("risks")
    )
    return flat.unionByName(rejected)


@query(f"""
WITH {V.ANALYSES}
SELECT accession_number, ticker, CASE WHEN id % 3 = 0 THEN 'first' ELSE 'second' END AS summary, CAST(filing_date AS VARCHAR) AS filing_date
FROM analyses""")
def stored_analyses(spark, sf):
    """Analyses written in two overlapping batches; the first write of a filing stays."""
    path = shared_folder(spark, "analyses")
    rows = V.analyses(spark, sf)
    early = rows.filter(F.col("id") % 3 == 0).withColumn("summary", F.lit("first"))
    # The same filing twice in one batch is stored once.
    sinks.insert_analyses(early.unionByName(early), path, [F.col("id")])
    sinks.insert_analyses(rows.withColumn("summary", F.lit("second")), path, [F.col("id")])
    return readers.read_analyses(spark, path).select(
        "accession_number", "ticker", "summary", F.col("filing_date").cast("string").alias("filing_date")
    )


@query(f"""
WITH {V.FILINGS}, {V.ANALYSES},
stored AS (SELECT cik, CASE WHEN id % 5 = 0 THEN 'missing' || id ELSE replace(f.accession_number, '-', '') END AS accession_number
  FROM analyses a JOIN (SELECT ord, accession_number FROM filings) f ON f.ord = a.id)
SELECT s.accession_number, f.primary_document FROM stored s
LEFT JOIN filings f ON f.cik = s.cik AND replace(f.accession_number, '-', '') = s.accession_number""")
def resolved_documents(spark, sf):
    filings = V.filings(spark, sf)
    dashless = st.dashless(F.col("accession_number"))
    stored = filings.select(
        "cik", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("missing"), F.col("ord").cast("string"))).otherwise(dashless).alias("accession_number")
    )
    return docs.resolve_documents(stored, filings).select("accession_number", "primary_document")


_ESC = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"
_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS DECIMAL(38, 0)) AS VARCHAR) ELSE rtrim(CAST(CAST({0} AS DECIMAL(38, 9)) AS VARCHAR), '0') END"
_CSV = " || ',' || ".join([
    _ESC.format("ticker"), _ESC.format("company_name"), _ESC.format("form_type"), "coalesce(CAST(filing_date AS VARCHAR), '')",
    "accession_number", *[f"coalesce({_NUM.format(c)}, '')" for c in
    ("revenue_current", "revenue_yoy_change_pct", "net_income_current", "net_income_yoy_change_pct")],
    _ESC.format("array_to_string(risk_factors, ' | ')"), _ESC.format("management_guidance"), _ESC.format("summary"), "strftime(created_at, '%Y-%m-%d %H:%M:%S')",
])


_CSV_LINES = f"""{V.ANALYSES.replace('o_totalprice * 1000', 'round(o_totalprice * 1000, 3)').replace('o_totalprice - 200000', 'round(o_totalprice - 200000, 2)')},
csv_lines AS (SELECT {_CSV} AS line FROM analyses)"""


def _rounded_analyses(spark, sf):
    rows = V.analyses(spark, sf).withColumn("revenue_current", F.round("revenue_current", 3))
    return rows.withColumn("net_income_current", F.round("net_income_current", 2))


@query(f"WITH {_CSV_LINES} SELECT line FROM csv_lines")
def csv_lines(spark, sf):
    return sinks.csv_rows(_rounded_analyses(spark, sf))


@query(f"""
WITH {_CSV_LINES}
SELECT line, 'row' AS place, CAST(octet_length(encode(line)) + 2 AS BIGINT) AS bytes FROM csv_lines
UNION ALL SELECT '{",".join(sinks.CSV_COLUMNS)}', 'header', {len(",".join(sinks.CSV_COLUMNS)) + 2}""")
def csv_file(spark, sf):
    """The CSV file written and read back: its parts in order begin with the header, and every line ends with CRLF."""
    path = shared_folder(spark, "csv")
    sinks.write_csv(_rounded_analyses(spark, sf), path)
    lines = spark.read.text(path, lineSep="\r\n").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("part"))
    first = lines.agg(F.min("part")).scalar()
    header = (F.col("line") == ",".join(sinks.CSV_COLUMNS)) & (F.col("part") == first)
    return lines.select("line", F.when(header, "header").otherwise("row").alias("place"), (F.octet_length("line") + 2).cast("bigint").alias("bytes"))


# --- display text -----------------------------------------------------------------------------------

def _fixed(x: str, digits: int) -> str:
    """printf with exact halves rounded up instead of to even."""
    nudge = {0: (2, "0.1"), 1: (4, "0.01"), 2: (8, "0.001")}[digits]
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN (abs({x}) * {nudge[0]}) % 2 = 1 "
            f"THEN printf('%.{digits}f', abs({x}) + {nudge[1]}) ELSE printf('%.{digits}f', abs({x})) END)")


def _money(x: str, t: int, b: int, m: int) -> str:
    return f"""CASE WHEN abs({x}) >= 1e12 THEN '$' || {_fixed(f'({x} / 1e12::DOUBLE)', t)} || 'T' WHEN abs({x}) >= 1e9 THEN '$' || {_fixed(f'({x} / 1e9::DOUBLE)', b)} || 'B'
      WHEN abs({x}) >= 1e6 THEN '$' || {_fixed(f'({x} / 1e6::DOUBLE)', m)} || 'M'
      ELSE '$' || CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('{{:,}}', CAST(floor(round(abs({x}), 2)) AS BIGINT))
        || rtrim(rtrim(substr(printf('%.2f', round(abs({x}), 2) - floor(round(abs({x}), 2))), 2), '0'), '.') END"""


_FIGURES = """figures AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN
  CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * -100 WHEN 2 THEN o_totalprice * 10000 WHEN 3 THEN o_totalprice * 100000000 ELSE o_totalprice * 1000 END END AS v,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_totalprice - 200000) / 4000 END AS small FROM orders)"""


def _figures(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rule = key % 5
    value = (
        F.when(rule == 0, price).when(rule == 1, price * -100).when(rule == 2, price * 10000).when(rule == 3, price * 100000000)
        .otherwise(price * 1000)
    )
    return V.table(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 11 != 0, value).alias("v"), F.when(key % 13 != 0, (price - 200000) / 4000).alias("small")
    )


@query(f"""
WITH {_FIGURES}
SELECT id, CASE WHEN v IS NULL THEN 'N/A' ELSE {_money('v', 2, 2, 1)} END AS currency, CASE WHEN v IS NOT NULL THEN {_money('v', 1, 1, 0)} END AS compact,
  CASE WHEN v IS NULL THEN '—' ELSE {_money('v', 2, 2, 1)} END AS cell FROM figures""")
def currency_text(spark, sf):
    v = F.col("v")
    return _figures(spark, sf).select(
        "id", fmt.currency(v).alias("currency"), fmt.currency_compact(v).alias("compact"), fmt.money_cell(v).alias("cell")
    )


@query(f"""
WITH {_FIGURES}
SELECT id, CASE WHEN small IS NULL THEN '—' ELSE CASE WHEN small < 0 THEN '-$' ELSE '$' END || {_fixed('abs(small)', 2)} END AS per_share,
  CASE WHEN small IS NULL THEN 'N/A' ELSE {_fixed('small', 1)} || '%' END AS percent,
  CASE WHEN small >= 0 THEN '▲ ' || {_fixed('abs(small)', 1)} || '%' WHEN small < 0 THEN '▼ ' || {_fixed('abs(small)', 1)} || '%' END AS badge
FROM figures""")
def small_figure_text(spark, sf):
    v = F.col("small")
    return _figures(spark, sf).select(
        "id", fmt.per_share(v).alias("per_share"), fmt.percent(v).alias("percent"), fmt.change_badge(v).alias("badge")
    )


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '—' WHEN o_orderkey % 5 = 1 THEN o_orderpriority
  ELSE strftime(o_orderdate, '%b %-d, %Y') END AS date FROM orders""")
def date_text(spark, sf):
    key = F.col("o_orderkey")
    value = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, F.col("o_orderpriority")).otherwise(V.day_text("o_orderdate"))
    return V.table(spark, sf, "orders").select(key.alias("id"), fmt.date_text(value).alias("date"))
