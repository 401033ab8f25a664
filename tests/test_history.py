import datetime as dt
import random

from pyspark.sql import functions as F
import pytest

from ledgerloom.functions import similarity as sim, strings as st
from ledgerloom.operators import history as hist, skew

ANALYSIS = "id int, ticker string, filing_date string, created_at timestamp, risk_factors array<string>"


def analyses(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, t, day, start + dt.timedelta(days=created), risks) for i, t, day, created, risks in rows], ANALYSIS
    ).withColumn("filing_date", F.col("filing_date").cast("date"))


def test_prior_is_strictly_earlier(spark):
    frame = analyses(spark, [(1, "A", "2025-11-01", 1, []), (2, "A", "2026-02-01", 2, []), (3, "A", "2026-05-02", 3, []), (4, "A", "2026-05-02", 4, []),
                             (5, "A", None, 5, []), (6, "B", "2026-06-01", 6, []), (7, "A", "2026-02-01", 0, [])])
    prior = {r.id: r.prior_id for r in hist.prior_analysis(frame).collect()}
    assert prior == {1: None, 2: 1, 3: 2, 4: 2, 5: None, 6: None, 7: 1}


def test_prior_is_searched_in_the_newest_created_only(spark):
    frame = analyses(spark, [(i, "A", f"2025-01-{i:02d}", i if i != 3 else 0, []) for i in range(1, 8)])
    prior = {r.id: r.prior_id for r in hist.prior_analysis(frame, limit=5).collect()}
    # 3 was created first and 1 next: both are outside the five newest.
    assert prior == {1: None, 2: None, 3: 2, 4: 2, 5: 4, 6: 5, 7: 6}


def test_staleness(spark):
    watched = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), ("5", "E")], "cik string, ticker string")
    filings = spark.createDataFrame([("1", "10-K", "2024-05-01", 0), ("1", "10-K", "2030-01-01", 1), ("2", "10-q", "2024-05-01", 0), ("3", "8-K", "2024-05-01", 0),
                                     ("4", "10-Q", "2024-05-01", 0)], "cik string, form_type string, filing_date string, ord int")
    stored = analyses(spark, [(1, "A", "2024-05-01", 1, []), (2, "B", "2024-06-01", 1, []), (3, "B", "2024-01-01", 2, []), (4, "D", None, 1, [])])
    stored = stored.withColumn("filing_date", F.col("filing_date").cast("string"))
    flags = {r.ticker: r.has_new_filing for r in hist.stale_companies(watched, filings, stored).collect()}
    assert flags == {"A": False, "B": True, "C": False, "D": True, "E": False}
    by_date = {r.ticker: r.has_new_filing for r in hist.stale_companies(watched, filings, stored, by_filing_date=True).collect()}
    assert by_date["B"] is False


def test_drift(spark):
    prior = ["Reliance on a handful of chip foundries overseas.", "Fierce rivalry may squeeze pricing."]
    now = ["Heavy reliance on overseas chip foundries.", "Proposed tariffs might raise component bills."]
    rows = [(1, now, prior), (2, [], prior), (3, ["No Material Changes were reported."], prior), (4, now, None)]
    frame = spark.createDataFrame(rows, "id int, risk_factors array<string>, prior_risk_factors array<string>")
    found = {r.id: (r.is_new, r.dropped) for r in hist.risk_drift(frame).collect()}
    assert found == {1: ([False, True], ["Fierce rivalry may squeeze pricing."]), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_words_and_similarity(one):
    assert one(sim.content_words(F.lit("The Company's don't-stop, e-mail e-mail 10,000 ÉTÉ xy")), x=1) == ["dontstop", "email", "10000"]
    words = [F.array(*[F.lit(w) for w in text.split()]) for text in ("a b c", "b c d")]
    assert one(sim.jaccard(*words), x=1) == 0.5
    assert one(sim.jaccard(words[0], F.array().cast("array<string>")), x=1) == 0.0


@pytest.mark.parametrize("risks, real", [([], False), (["x No MATERIAL changes y"], False), (["no material changes", "b"], True), (["a"], True)])
def test_substantive(one, risks, real):
    column = F.array(*[F.lit(r) for r in risks]).cast("array<string>")
    assert one(sim.substantive_risks(column), x=1) is real


def test_search_tiers_and_literal_matching(spark):
    names = [("AB", "x"), ("CAB", "y"), ("ABC", "z"), ("ZZ", "grab bag"), ("A%", "100% juice"), ("Q", "q"), ("AB", "second")]
    directory = spark.createDataFrame([(str(i), t, n, i) for i, (t, n) in enumerate(names)], "cik string, ticker string, name string, ord int")
    queries = spark.createDataFrame([(q,) for q in [" ab ", "%", "grab b", "q", "  ", "nothing", "b"]], "query string")
    rows = hist.search_directory(queries, directory, limit=4).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["query"], []).append(r.ord)
    assert found == {" ab ": [0, 6, 2, 1], "%": [4], "grab b": [3], "q": [5], "b": [0, 1, 2, 3]}


def search_of_all(spark, few):
    directory = spark.range(400).select(F.col("id").cast("string").alias("cik"), F.concat(F.lit("AB-"), F.col("id").cast("string")).alias("ticker"), F.lit("name").alias("name"), F.col("id").alias("ord"))
    queries = spark.createDataFrame([(q,) for q in ["ab-1", "am", "b-39", "-7"]], "query string")
    return hist.search_directory(queries, directory, limit=5, few=few)


def test_search_with_few_and_with_many_pieces(spark):
    """The pieces of the directory are on the streamed side of every broadcast, however small the directory looks."""
    rows = lambda found: sorted((r["query"], r["rank"], r.ord, r.tier) for r in found.collect())
    few, many = search_of_all(spark, 1000), search_of_all(spark, 0)
    assert rows(few) == rows(many) and len(rows(few)) == 20
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in line and "__salt" in line for line in plan.splitlines())


def test_page_and_total(spark):
    frame = analyses(spark, [(i, "A" if i % 2 else "B", None, i // 2, []) for i in range(10)])
    rows = hist.page(frame, limit=3, offset=2).collect()
    assert [(r.id, r.total) for r in rows] == [(7, 10), (6, 10), (5, 10)]
    assert [(r.id, r.total) for r in hist.page(frame, limit=2, ticker="a").collect()] == [(9, 5), (7, 5)]


def test_first_filings_follow_the_index(spark):
    rows = [("1", "8-K", "2024-01-01", 0), ("1", "10-k", "2020-01-01", 1), ("1", "10-Q", "2024-01-01", 2), ("1", "10-K/A", "2024", 3)]
    filings = spark.createDataFrame(rows, "cik string, form_type string, filing_date string, ord int")
    assert sorted(r.ord for r in hist.first_filings(filings, 10).collect()) == [1, 2]
    assert [r.ord for r in hist.first_filings(filings, 1).collect()] == [1]
    assert [r.ord for r in hist.first_filings(filings, 5, "8-k, 10-K/a").collect()] == [0, 3]


def test_top_k_with_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), "id")
    top = skew.top_k(rows, ["key"], [F.desc("id")], 4, spread=["id"])
    hot = [(r["rank"], r.id) for r in top.filter("key = 'hot'").orderBy("rank").collect()]
    assert hot == [(1, 2997), (2, 2994), (3, 2991), (4, 2988)]
    assert top.groupBy("key").count().agg(F.max("count")).first()[0] == 4


@pytest.mark.parametrize("ticker, cik, accession, company, form, document, errors", [
    (" brk.b ", "320193", "0000320193-25-000057", "x", "10-k", "a/b.htm", []),
    ("1A", "12345678901", "000032019325000057x", "", "8-K", "a/../b", ["ticker", "cik", "accession_number", "company_name", "form_type", "primary_document"]),
    ("ABCDEFGHIJK", "１２", "0000320193-25000057", "y" * 201, "10-Q/A", "a b", ["ticker", "cik", "company_name", "primary_document"]),
    (None, "1", "000032019325000057", "x", "10-Q", "d.htm", ["ticker"]),
])
def test_request_errors(one, ticker, cik, accession, company, form, document, errors):
    columns = [F.lit(v).cast("string") for v in (ticker, cik, accession, company, form, document)]
    assert one(st.request_errors(*columns), x=1) == errors


def test_identifier_formats(one):
    assert one(st.pad_cik(F.lit("320193")), x=1) == "0000320193"
    assert one(st.pad_cik(F.lit("12345678901")), x=1) == "12345678901"
    assert one(st.index_url(F.lit("0000320193"), F.lit("0000320193-25-000057")), x=1).endswith("/320193/000032019325000057/")


def test_pages_of_any_depth(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    # Many in one hour, ties, and some without a time.
    times = [start + dt.timedelta(seconds=rng.choice([rng.randrange(10**6), rng.randrange(60), 7])) for _ in range(300)] + [None] * 5
    rows = [(i, f"T{i % 3}", t) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "id bigint, ticker string, created_at timestamp")
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or start, r[0]), reverse=True)
    index = hist.page_index(frame)
    for offset in (0, 3, 95, 150, 290, 303, 305, 1000):
        found = [(r.id, r.total) for r in hist.page(frame, limit=9, offset=offset, index=index).collect()]
        assert found == [(r[0], 305) for r in order[offset : offset + 9]]
    own = [r for r in order if r[1] == "T1"]
    assert [r.id for r in hist.page(frame, limit=4, offset=50, ticker="t1").collect()] == [r[0] for r in own[50:54]]


def test_words_of_rare_letters_and_any_space(spark):
    """A sentence is cut alike whether or not all that it drops is dropped by lookup."""
    bom, han, wide, line, thin = (chr(c) for c in (0xFEFF, 0x4E2D, 0x3000, 0x2028, 0x200B))
    texts = [
        f"abc{chr(0xA0)}def\x0bghi{bom}jkl", f"abc{han}def{wide}ghi{line}jkl", f"\x85abc\x00def{thin}x  ghi\t", f"{chr(0x130)}stanbul {chr(0xFB01)}rst", "", " ", None,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = {r.id: r.words for r in frame.select("id", sim.content_words(F.col("text")).alias("words")).collect()}
    assert found == {0: ["abc", "def", "ghi", "jkl"], 1: ["abcdef", "ghi", "jkl"], 2: ["abcdefx", "ghi"], 3: ["istanbul", "rst"], 4: [], 5: [], 6: None}
