"""Document preparation over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import settings as S
from ledgerloom.functions import documents as fn
from ledgerloom.operators import documents as ops
from ledgerloom.operators.retrieval import nearest_scale as scale_lookup
from ledgerloom.plans import vehicles as V
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers, sinks


# --- HTML ------------------------------------------------------------------------------

@query(r"""
WITH bare AS (
  SELECT page_id, regexp_replace(html,
    '<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<![^>]*>|</?[a-z]([^''">]|"[^"]*"|''[^'']*'')*>',
    chr(10), 'gis') AS t FROM pages),
plain AS (
  SELECT page_id, replace(replace(replace(replace(regexp_replace(t, '&amp(;|\b)', '&amp;', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM bare)
SELECT page_id, array_to_string(list_filter(
  list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS text
FROM plain""")
def page_text(spark, sf):
    pages = V.table(spark, sf, "pages")
    return ops.page_text(pages.select("page_id", "html")).select("page_id", "text")


@query("""
SELECT page_id, CAST(page_id AS VARCHAR) AS cik, lpad(CAST(page_id AS VARCHAR), 18, '0') AS accession_number,
       'doc' || page_id || '.htm' AS document, length(html) AS chars
FROM pages""")
def document_keys(spark, sf):
    """Pages kept as filing documents and read back with their keys."""
    pages = V.table(spark, sf, "pages")
    padded = F.lpad(F.col("page_id").cast("string"), 18, "0")
    name = F.concat(F.lit("doc"), F.col("page_id").cast("string"), F.lit(".htm"))
    path = shared_folder(spark, "filing-html")
    sinks.write_filing_html(pages.select(F.col("page_id").cast("string").alias("cik"), padded.alias("accession_number"), name.alias("document"), "html"), path)
    read = readers.read_stored_html(spark, path)
    return read.select(F.col("cik").cast("bigint").alias("page_id"), "cik", "accession_number", "document", F.length("html").cast("bigint").alias("chars"))


# --- sections --------------------------------------------------------------------------------

# Stand-ins for section headings in invented prose: (start, end).
MARKS = ((r"the\s+of", r"with\s"), (r"and\s+the", r"that\s"))
CAP, HEAD = 1500, 300


def _section(name: str, start: str, end: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id, b - length(hit) AS s, b + coalesce(nullif(stop, 0), length(tail) + 1) - 1 AS e FROM (
    SELECT *, length(text) - length(tail) AS b,
           CASE WHEN regexp_matches(tail, '(?i){end}') THEN length(regexp_extract(tail, '(?is)^(.*?){end}', 1)) + 1 ELSE 0 END AS stop
    FROM (SELECT doc_id, text, hits[-1] AS hit, regexp_split_to_array(text, '(?i){start}')[-1] AS tail
          FROM (SELECT doc_id, text, regexp_extract_all(text, '(?i){start}') AS hits FROM documents) WHERE len(hits) > 0)))"""


SECTIONS = f"{_section('first_section', *MARKS[0])},{_section('second_section', *MARKS[1])}"
PRIORITIZED = f"""{SECTIONS},
long_documents AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > {CAP}),
wanted AS (SELECT doc_id, 0 AS s, {HEAD} AS e FROM long_documents
  UNION ALL SELECT * FROM first_section SEMI JOIN long_documents USING (doc_id)
  UNION ALL SELECT * FROM second_section SEMI JOIN long_documents USING (doc_id)),
marked AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM first_section UNION ALL SELECT doc_id FROM second_section)),
islands AS (SELECT *, count(*) FILTER (s > coalesce(reach, -1)) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wanted)),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island),
charged AS (SELECT *, {CAP} - coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM merged),
kept AS (SELECT doc_id, s, CAST(least(e, s + budget) AS BIGINT) AS e FROM charged WHERE budget > 0),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM kept
  UNION ALL SELECT doc_id, max(kept.e), max(n) FROM kept JOIN long_documents USING (doc_id) GROUP BY doc_id),
leftover AS (SELECT doc_id, {CAP} - sum(e - s) AS budget FROM kept GROUP BY doc_id),
gap_charged AS (SELECT gaps.*, budget - coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget
  FROM gaps JOIN leftover USING (doc_id) WHERE e > s),
spans AS (SELECT doc_id, s, e FROM kept UNION ALL
  SELECT doc_id, s, CAST(least(e, s + budget) AS BIGINT) FROM gap_charged WHERE budget > 0)"""


@query(f"""
WITH {SECTIONS}
SELECT doc_id, f.s AS first_start, f.e AS first_end, g.s AS second_start, g.e AS second_end
FROM documents LEFT JOIN first_section f USING (doc_id) LEFT JOIN second_section g USING (doc_id)""")
def section_spans(spark, sf):
    documents = V.documents(spark, sf)
    spans = documents.select(
        "doc_id", fn.section_span(F.col("text"), *MARKS[0]).alias("f"), fn.section_span(F.col("text"), *MARKS[1]).alias("g")
    )
    return spans.select("doc_id", *[
        F.col(path).cast("bigint").alias(name)
        for path, name in [("f.s", "first_start"), ("f.e", "first_end"), ("g.s", "second_start"), ("g.e", "second_end")]
    ])


@query(f"""
WITH {PRIORITIZED}
SELECT doc_id, coalesce(shown, '') AS spans FROM documents LEFT JOIN
  (SELECT doc_id, string_agg(s || '-' || e, ' ' ORDER BY s, e) AS shown FROM spans SEMI JOIN marked USING (doc_id) GROUP BY doc_id) USING (doc_id)""")
def kept_spans(spark, sf):
    """Merged sections and the gaps that fill the rest of the budget; none for a text that is short or has no section."""
    spans = fn.kept_spans(F.col("text"), CAP, HEAD, MARKS)
    shown = F.transform(spans, lambda p: F.concat_ws("-", p["s"].cast("string"), p["e"].cast("string")))
    return V.documents(spark, sf).select("doc_id", F.array_join(shown, " ").alias("spans"))


@query(f"""
WITH {PRIORITIZED},
joined AS (SELECT doc_id, string_agg(substr(text, s + 1, e - s), chr(10) || chr(10) ORDER BY s, e) AS t
  FROM spans SEMI JOIN marked USING (doc_id) JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, left(coalesce(t, text), {CAP}) AS text FROM documents LEFT JOIN joined USING (doc_id)""")
def prioritized_text(spark, sf):
    documents = V.documents(spark, sf)
    return documents.select("doc_id", fn.prioritize_sections(F.col("text"), CAP, HEAD, MARKS).alias("text"))


@query(f"SELECT doc_id, left(text, {CAP}) AS text, substr(text, {CAP + 1}) AS rest FROM documents")
def truncated_text(spark, sf):
    """The plain cut of texts without sections, and what it took away."""
    documents = V.documents(spark, sf)
    text = fn.prioritize_sections(F.col("text"), CAP, HEAD, sections=())
    rest = F.col("text").substr(F.length(text) + 1, F.length("text"))
    return documents.select("doc_id", text.alias("text"), rest.alias("rest"))


# --- chunks ------------------------------------------------------------------------------------

BUDGET = 5000


def _chunks(spark, sf):
    documents = V.documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("accession_number"), "text")
    return ops.chunks(documents, budget=BUDGET)


@query(f"WITH {V.CHUNKS} SELECT doc_id, chunk_index, content FROM plain_chunks")
def document_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content")


@query(f"""
WITH {V.chunks_sql("(SELECT doc_id, CASE WHEN length(text) >= 20000 THEN repeat(text, 30) ELSE text END AS text FROM documents)")}
SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, arg_max(content, chunk_index) AS last
FROM plain_chunks GROUP BY doc_id""")
def long_document_chunks(spark, sf):
    """Every chunk of all texts, the long ones repeated until they pass the truncation's 600,000 characters."""
    long = F.when(F.length("text") >= 20_000, 30).otherwise(1)
    documents = V.documents(spark, sf).withColumn("text", F.repeat("text", long))
    rows = ops.chunks(documents, budget=BUDGET)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).cast("bigint").alias("chars"), F.max_by("content", "chunk_index").alias("last")
    )


@query(f"""
WITH {V.CHUNKS}
SELECT doc_id, chunk_index, CAST(greatest(1, ceil(length(content) / 1.8::DOUBLE)) AS BIGINT) AS tokens FROM plain_chunks""")
def token_estimates(spark, sf):
    return _chunks(spark, sf).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("tokens").cast("bigint").alias("tokens")
    )


# Greedy packing, one chunk per step.
PACKED = f"""
sized AS (SELECT doc_id, accession_number, chunk_index,
                 CAST(greatest(1, ceil(length(content) / 1.8::DOUBLE)) AS BIGINT) AS tokens FROM plain_chunks),
packed AS (
  SELECT doc_id, accession_number, chunk_index, tokens, tokens AS used, 0 AS batch FROM sized WHERE chunk_index = 0
  UNION ALL
  SELECT s.doc_id, s.accession_number, s.chunk_index, s.tokens,
         CASE WHEN p.used + s.tokens > {BUDGET} THEN s.tokens ELSE p.used + s.tokens END,
         CASE WHEN p.used + s.tokens > {BUDGET} THEN p.batch + 1 ELSE p.batch END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.chunk_index = p.chunk_index + 1
)"""


@query(f"WITH RECURSIVE {V.CHUNKS}, {PACKED} SELECT doc_id, chunk_index, CAST(batch AS BIGINT) AS batch FROM packed")
def request_batches(spark, sf):
    return _chunks(spark, sf).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("batch").cast("bigint").alias("batch")
    )


# --- unit declarations -----------------------------------------------------------------------------

_MENTION = "(lower(content) LIKE '%in millions%' OR lower(content) LIKE '%in thousands%' OR lower(content) LIKE '%in billions%')"
PARSED = f"""{V.CHUNK_ROWS},
parsed AS (
  SELECT accession_number, chunk_index,
         rtrim(trim(regexp_replace(phrase, '\\s+', ' ', 'g')), ' .,;:') AS phrase
  FROM (SELECT *, coalesce(
          nullif(regexp_extract(content, '(?i)\\(\\s*([^()\\n]{{0,200}}?\\bin (?:thousands|millions|billions)\\b[^()\\n]{{0,200}}?)\\s*\\)', 1), ''),
          nullif(regexp_extract(content, '(?i)\\b((?:amounts|dollars|figures|numbers)\\s+(?:are\\s+)?(?:expressed\\s+|stated\\s+|presented\\s+)?in\\s+(?:thousands|millions|billions))\\b', 1), '')) AS phrase
        FROM chunk_rows)),
scales AS (SELECT accession_number, chunk_index, upper(left(phrase, 1)) || substr(phrase, 2) || '.' AS scale FROM parsed),
mentions AS (SELECT accession_number, chunk_index, scale FROM chunk_rows JOIN scales USING (accession_number, chunk_index) WHERE {_MENTION})"""


@query(f"WITH {V.CHUNK_ROWS} SELECT accession_number, chunk_index FROM chunk_rows WHERE {_MENTION}")
def scale_mentions(spark, sf):
    rows = V.chunk_rows(spark, sf).filter(fn.mentions_scale(F.col("content")))
    return rows.select("accession_number", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@query(f"WITH {PARSED} SELECT accession_number, chunk_index, scale AS unit_scale FROM scales WHERE scale IS NOT NULL")
def unit_declarations(spark, sf):
    rows = V.chunk_rows(spark, sf).select(
        "accession_number", F.col("chunk_index").cast("bigint").alias("chunk_index"), fn.unit_scale(F.col("content")).alias("unit_scale")
    )
    return rows.filter(F.col("unit_scale").isNotNull())


@query(f"""
WITH {PARSED},
anchors AS (SELECT accession_number, chunk_index AS anchor FROM plain_chunks),
ranked AS (SELECT a.accession_number, anchor, scale, m.chunk_index <= anchor AS above,
    bool_or(m.chunk_index <= anchor) OVER (PARTITION BY a.accession_number, anchor) AS any_above,
    row_number() OVER (PARTITION BY a.accession_number, anchor, m.chunk_index <= anchor
      ORDER BY CASE WHEN m.chunk_index <= anchor THEN -m.chunk_index ELSE m.chunk_index END) AS place
  FROM anchors a JOIN mentions m USING (accession_number)),
found AS (SELECT accession_number, anchor, arg_min(scale, place) FILTER (scale IS NOT NULL) AS unit_scale
  FROM ranked WHERE above = any_above AND place <= 3 GROUP BY ALL)
SELECT accession_number, anchor, unit_scale FROM anchors LEFT JOIN found USING (accession_number, anchor)""")
def nearest_scale(spark, sf):
    rows = V.chunk_rows(spark, sf)
    anchors = rows.select("accession_number", F.col("chunk_index").cast("bigint").alias("anchor"))
    return scale_lookup(anchors, rows)


@query(f"""
WITH {PARSED}
SELECT accession_number, chunk_index, chunk_index * 1.5::DOUBLE * CASE WHEN lower(scale) LIKE '%in thousands%' THEN 1e3
  WHEN lower(scale) LIKE '%in millions%' THEN 1e6 WHEN lower(scale) LIKE '%in billions%' THEN 1e9 ELSE 1 END AS figure
FROM scales""")
def scaled_figures(spark, sf):
    index = F.col("chunk_index").cast("bigint")
    figure = fn.apply_scale(index * F.lit(1.5), fn.unit_scale(F.col("content")))
    return V.chunk_rows(spark, sf).select("accession_number", index.alias("chunk_index"), figure.alias("figure"))


# --- index state -----------------------------------------------------------------------------------

# Stored so far: a few leading chunks of most filings, all of some, none of others.
_STORED = "chunk_index < doc_id % 4"


def stored_chunks(spark, sf):
    rows = _chunks(spark, sf).filter(F.col("chunk_index") < F.col("doc_id") % 4)
    return rows.select("accession_number", "chunk_index")


def _texts(spark, sf):
    return V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("accession_number"), "text")


@query(f"""
WITH RECURSIVE {V.CHUNKS},
todo AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pos,
           CAST(greatest(1, ceil(length(content) / 1.8::DOUBLE)) AS BIGINT) AS tokens
         FROM plain_chunks WHERE NOT ({_STORED})),
packed AS (
  SELECT doc_id, chunk_index, pos, tokens AS used, 0 AS batch FROM todo WHERE pos = 1
  UNION ALL
  SELECT t.doc_id, t.chunk_index, t.pos, CASE WHEN p.used + t.tokens > {BUDGET} THEN t.tokens ELSE p.used + t.tokens END,
         CASE WHEN p.used + t.tokens > {BUDGET} THEN p.batch + 1 ELSE p.batch END
  FROM packed p JOIN todo t ON t.doc_id = p.doc_id AND t.pos = p.pos + 1)
SELECT CAST(doc_id AS VARCHAR) AS accession_number, chunk_index, CAST(batch AS BIGINT) AS batch FROM packed""")
def remaining_chunks(spark, sf):
    left = ops.remaining_chunks(_texts(spark, sf), stored_chunks(spark, sf), budget=BUDGET)
    return left.select(
        "accession_number", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("batch").cast("bigint").alias("batch")
    )


@query(f"""
WITH {V.CHUNKS},
stored AS (SELECT accession_number, count(*) AS n FROM plain_chunks WHERE {_STORED} GROUP BY ALL),
schedule AS (SELECT accession_number, count(*) AS total, doc_id % 6 = 1 AS running FROM plain_chunks WHERE doc_id % 3 <> 0 GROUP BY accession_number, doc_id)
SELECT accession_number, CASE WHEN running THEN 'indexing' WHEN n > 0 THEN 'complete' ELSE 'unavailable' END AS state,
       coalesce(n, 0) AS chunks_indexed, coalesce(total, n, 0) AS chunks_total
FROM stored FULL OUTER JOIN schedule USING (accession_number)""")
def index_coverage(spark, sf):
    documents = V.documents(spark, sf).filter(F.col("doc_id") % 3 != 0)
    schedule = documents.select(
        F.col("doc_id").cast("string").alias("accession_number"),
        F.size(fn.chunk_text(F.col("text"))).alias("chunks_total"), (F.col("doc_id") % 6 == 1).alias("running"),
    ).filter(F.col("chunks_total") > 0)
    coverage = ops.index_coverage(stored_chunks(spark, sf), schedule)
    return coverage.withColumn("chunks_indexed", F.col("chunks_indexed").cast("bigint")).withColumn(
        "chunks_total", F.col("chunks_total").cast("bigint")
    )


def _status(spark, sf):
    """A repair run over all documents; some are not listed, some stay partial."""
    doc = F.col("doc_id")
    documents = V.documents(spark, sf)
    accession = doc.cast("string").alias("accession_number")
    analyses = documents.select(accession, F.lit("1").alias("cik"))
    listed = documents.filter(doc % 11 != 0).select(
        F.lit("1").alias("cik"), accession, F.lit("doc.htm").alias("primary_document"), doc.alias("ord")
    )
    # The texts are chunked once; what is stored so far are the first chunks of each.
    sizes = documents.select(accession, doc.alias("doc"), F.size(fn.chunk_text(F.col("text"))).alias("expected"))
    counts = sizes.withColumn("stored", F.least(F.col("expected"), (F.col("doc") % 4).cast("int")))
    added = documents.select(accession, (doc % 7).cast("int").alias("added"))
    return ops.backfill_status(ops.resolve_documents(analyses, listed), counts, None, added)


_STATUS = f"""{V.CHUNKS},
sizes AS (SELECT doc_id, count(*) AS expected, count(*) FILTER ({_STORED}) AS stored FROM plain_chunks GROUP BY doc_id),
status AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 OR expected IS NULL THEN 'failed' WHEN stored >= expected THEN 'complete'
    WHEN stored + d.doc_id % 7 >= expected THEN 'indexed' ELSE 'failed' END AS status
  FROM documents d LEFT JOIN sizes USING (doc_id))"""


@query(f"WITH {_STATUS} SELECT CAST(doc_id AS VARCHAR) AS accession_number, status FROM status")
def backfill_status(spark, sf):
    return _status(spark, sf).select("accession_number", "status")


@query(f"""
WITH {_STATUS}
SELECT CASE WHEN doc_id >= (SELECT min(doc_id) FROM documents WHERE n_chars > 15000) THEN 'not attempted' ELSE status END AS status,
       count(*) AS filings
FROM status GROUP BY 1""")
def backfill_report(spark, sf):
    hits = V.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("accession_number"), F.col("doc_id").alias("position"),
        (F.col("n_chars") > 15000).alias("quota_hit"),
    )
    return ops.backfill_report(_status(spark, sf).join(hits, "accession_number"), hits)


@query("""
SELECT CAST(label AS VARCHAR) AS accession_number, vec_id % 7 AS batch, count(*) AS texts,
       count(*) FILTER (vec_id % 13 <> 0) AS vectors, count(*) = count(*) FILTER (vec_id % 13 <> 0) AS whole
FROM embeddings GROUP BY ALL""")
def embedding_gaps(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("accession_number"), (F.col("vec_id") % 7).alias("batch"),
        F.when(F.col("vec_id") % 26 == 0, F.lit(None)).when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 10))
        .otherwise(F.col("embedding")).alias("embedding"),
    )
    return ops.embedding_gaps(rows, dim=64)


@query(f"""
WITH {V.CHUNKS}
SELECT accession_number, chunk_index, CASE WHEN {_STORED} THEN 'first' ELSE 'second' END AS origin, content FROM plain_chunks""")
def inserted_chunks(spark, sf):
    """Chunks written twice: the second write adds only what the first left out."""
    path = shared_folder(spark, "chunks")
    rows = _chunks(spark, sf).withColumn("chunk_index", F.col("chunk_index").cast("int"))
    columns = ["accession_number", "chunk_index", "content"]
    sinks.insert_chunks(
        rows.filter(F.col("chunk_index") < F.col("doc_id") % 4).select(*columns, F.lit("first").alias("origin")), path
    )
    stored = sinks.insert_chunks(rows.select(*columns, F.lit("second").alias("origin")), path)
    return stored.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query(f"""
WITH {V.CHUNKS}
SELECT accession_number, chunk_index, length(content) AS chars, lang, source FROM plain_chunks JOIN documents USING (doc_id)""")
def chunk_table(spark, sf):
    """The chunk table in buckets by filing, joined to the filings without moving a chunk."""
    path, name = shared_folder(spark, "chunk-table"), f"chunks_{uuid.uuid4().hex[:12]}"
    columns = ["accession_number", "chunk_index", "content", "embedding"]
    rows = _chunks(spark, sf).withColumn("chunk_index", F.col("chunk_index").cast("int")).withColumn("embedding", F.lit(None).cast("array<float>"))
    sinks.write_chunk_table(rows.select(*columns), path, name)
    filings = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession_number"), "lang", "source")
    joined = spark.table(name).join(filings, "accession_number")
    return joined.select("accession_number", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("content").cast("bigint").alias("chars"), "lang", "source")
