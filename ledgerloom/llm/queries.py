"""One query for each operator, over whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bpe, collocations, decision_list, dialogue, entropy_mix, line_dedup, ngram_join, packing, secrets, suffix_index, warc, winnowing, wrapper
from ledgerloom.llm.common import table, word_count


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary that the query encodes with; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(warc.archive(table(spark, sf_dir, "pages")))


def op3_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "rule")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.SURE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n(kind) for kind in secrets.SURE], F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = entropy_mix.mix(docs, F.col("words"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_captures": op2_warc_captures,
    "op3_wrapper_text": op3_wrapper_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_secret_scan": op7_secret_scan,
    "op8_winnowing": op8_winnowing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}
#: Queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_warc_captures": """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (SELECT page_id, n, h, i, translate(lpad(to_base(CAST('0x' || substr(h, CAST(1 + 10 * i AS BIGINT), 10) AS BIGINT), 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS part FROM hashed, range(4) AS r(i)),
coded AS (SELECT page_id, n, h, string_agg(part, '' ORDER BY i) AS d FROM digits GROUP BY page_id, n, h),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM coded)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, CASE WHEN page_id = top THEN true END AS digest_ok FROM newest""",
    "op6_ngram_jaccard": """
WITH RECURSIVE worded AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
listed AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM listed),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM listed JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)""",
    "op9_suffix_dedup": """
WITH coded AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS w FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS i FROM coded WHERE octet_length(b) >= 50)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS opens FROM windows JOIN firsts USING (w) WHERE first < doc_id),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM runs
  UNION ALL SELECT doc_id, coalesce(max(e), 0), any_value(octet_length(b)) FROM coded LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN e > s THEN hex(array_slice(b, s + 1, e)) ELSE '' END, '' ORDER BY s, e) AS k FROM gaps JOIN coded USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM coded LEFT JOIN sums USING (doc_id) JOIN kept USING (doc_id)""",
    "op12_conversation_repair": """
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM conversations),
coded AS (SELECT *, xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, (c % 2) * 3988292384) END), 4294967295) % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM coded, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM damaged),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
ways AS (SELECT * FROM (VALUES (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS w(s, t, wanted)),
moves AS (
  SELECT conv_id, i, w.s, w.s AS t, 4 AS cost, 'D' AS edit, '' AS lines FROM judged, ways w
  UNION ALL SELECT conv_id, i, s, CASE WHEN initial = 's' THEN 1 ELSE t END, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
    FROM judged, ways WHERE fault IN ('', 'truncated') AND (initial = wanted OR initial = 's' AND s = 0)
  UNION ALL SELECT conv_id, i, s, t, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || CASE wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
    FROM judged, ways WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, a.s, b.t, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'IK', chr(10) || CASE a.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) || role || ':' || text
    FROM judged, ways a JOIN ways b ON b.s = a.t WHERE fault IN ('', 'truncated') AND initial = b.wanted
  UNION ALL SELECT conv_id, i, a.s, b.t, CASE fault WHEN 'truncated' THEN 9 ELSE 6 END, 'IR',
      chr(10) || CASE a.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) || CASE b.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
    FROM judged, ways a JOIN ways b ON b.s = a.t WHERE fault IN ('', 'truncated')),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS way FROM judged
  UNION ALL
  SELECT b.conv_id, m.i, m.t, min({'cost': way.cost + m.cost, 'audit': way.audit || m.edit, 'lines': way.lines || m.lines})
  FROM best b JOIN moves m ON m.conv_id = b.conv_id AND m.i = b.i + 1 AND m.s = b.state GROUP BY b.conv_id, m.i, m.t),
ended AS (SELECT b.conv_id, min({'cost': way.cost + tail.cost, 'audit': way.audit || tail.audit, 'lines': way.lines || tail.lines}) AS way
  FROM best b JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id) l ON l.conv_id = b.conv_id AND l.n = b.i
  JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) AS tail(s, cost, audit, lines)
    ON tail.s = b.state GROUP BY b.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(way.cost, 0) AS BIGINT) AS cost, coalesce(way.audit, '') AS audit, sha256(substr(coalesce(way.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)""",
    "op13_collocations": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM worded, range(1, 6) AS r(k) WHERE len(w) >= k),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
parts AS (SELECT lang, phrase, f, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
hidden AS (SELECT DISTINCT s.lang, s.phrase FROM parts s JOIN parts t ON s.lang = t.lang AND t.k > s.k AND 100 * t.f >= 100 * s.f
    WHERE contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
cuts AS (SELECT p.lang, p.phrase, p.f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y
    FROM parts p, range(1, 5) AS q(c) WHERE c < p.k),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN totals t ON t.lang = cuts.lang
    ANTI JOIN hidden h ON h.lang = cuts.lang AND h.phrase = cuts.phrase),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM least QUALIFY rank <= 2000""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
