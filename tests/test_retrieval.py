"""Searches with bounds, lateral calls of the table function, and declarations carried over stretches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as ret

CHUNKS = "accession_number string, chunk_index bigint, content string, embedding array<float>"
QUESTIONS = "question_id bigint, accession_number string, vector array<float>"


def clustered(rng, filings=3, centres=6, each=60, dim=12):
    rows = []
    for f in range(filings):
        middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
        rows += [(f"f{f}", i, f"c{i}", [x + rng.gauss(0, 0.05) for x in middles[i % centres]]) for i in range(centres * each)]
    return rows


def same(left, right):
    order = lambda rows: sorted((r.question_id, r.rank, r.chunk_index, r.content, None if r.similarity is None else round(r.similarity, 9)) for r in rows)
    return order(left.collect()) == order(right.collect())


@pytest.fixture(scope="module")
def stored(spark):
    rows = clustered(random.Random(3))
    # Vectors without direction or length, equal ones, and a filing of its own with few.
    rows += [("f0", 900, "zero", [0.0] * 12), ("f0", 901, "null", None), ("f0", 902, "short", [1.0, 2.0]), ("f0", 903, "twin", rows[0][3])]
    rows += [("g", i, f"g{i}", [float(i == j) for j in range(12)]) for i in range(3)] + [("z", 0, "only zero", [0.0] * 12)]
    chunks = spark.createDataFrame(rows, CHUNKS).cache()
    pivots = ret.vector_pivots(chunks)
    vectors = ret.with_angles(chunks, pivots)
    return chunks, pivots, vectors, ret.vector_blocks(vectors)


def questions(spark, chunks):
    asked = [(r.chunk_index * 10 + ord(r.accession_number[-1]), r.accession_number, r.embedding) for r in chunks.filter("chunk_index % 37 = 0").collect()]
    asked += [(10**6, "f1", [0.0] * 12), (10**6 + 1, "f1", None), (10**6 + 2, "f1", [1.0]), (10**6 + 3, "nowhere", [1.0] * 12)]
    return spark.createDataFrame(asked, QUESTIONS)


@pytest.mark.parametrize("k", [1, 6, 200, 1000])
def test_bounds_lose_nothing(spark, stored, k):
    chunks, pivots, vectors, blocks = stored
    asked = questions(spark, chunks)
    assert same(ret.match_in_blocks(asked, vectors, pivots, blocks, k), ret.match_chunks(asked, chunks, k))


def test_most_blocks_are_left_out(spark, stored):
    chunks, pivots, vectors, blocks = stored
    asked = questions(spark, chunks).filter("question_id < 1000000 and accession_number like 'f%'")
    plan = ret.asked_blocks(asked, pivots, blocks, 6)
    total, first = plan.count(), plan.filter("first").count()
    best = ret.match_chunks(asked, chunks, 6).groupBy("question_id").agg(F.min("similarity").alias("least"))
    read = plan.join(best, "question_id").filter("first or bound >= least - 1e-6").count()
    assert first <= read < total / 2
    # The order of the blocks, and each bound, hold for every vector in them.
    met = plan.join(vectors.withColumnRenamed("block", "b"), "accession_number").filter("block = b")
    worst = met.select((ret.cosine(F.col("vector"), F.col("embedding")) - F.col("bound")).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-6


def test_lateral_calls_are_equi_joins(spark, stored):
    chunks = stored[0]
    ret.register_match_chunks(chunks)
    asked = questions(spark, chunks)
    asked.withColumn("vector", F.col("vector").cast("array<double>")).createOrReplaceTempView("asked_laterally")
    found = spark.sql("""
        SELECT q.question_id, m.*, row_number() OVER (PARTITION BY q.question_id ORDER BY m.similarity DESC NULLS LAST, m.chunk_index) AS rank
        FROM asked_laterally q, LATERAL match_chunks(q.accession_number, q.vector, 4) m""")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert same(found, ret.match_chunks(asked, chunks, 4))


NOTES = {"m": "(in millions)", "t": "(in thousands, except shares)", "x": "one in millions of", "": "nothing"}


def brute_scale(mentions, anchor, candidates=3):
    above = [m for m in mentions if m[0] <= anchor]
    tried = above[::-1][:candidates] if above else mentions[:candidates]
    return next((scale for _, scale in tried if scale), None)


@pytest.mark.parametrize("stretch", [1, 3, 7, 4096])
def test_declarations_carried_over_stretches(spark, stretch):
    rng = random.Random(stretch)
    chunks, anchors, expected = [], [], {}
    for filing in range(12):
        notes = [(i, rng.choice(["m", "t", "x", "", "", "", ""] if filing % 3 else ["x", "", ""])) for i in range(rng.randrange(0, 40)) if rng.random() < 0.8]
        chunks += [(f"f{filing}", i, NOTES[n]) for i, n in notes]
        scale = {"m": "in millions", "t": "in thousands, except shares"}
        mentions = [(i, scale.get(n)) for i, n in notes if n]
        for anchor in [*range(-1, 42, 5), rng.randrange(40)]:
            anchors.append((len(anchors), f"f{filing}", anchor))
            expected[len(anchors) - 1] = brute_scale(mentions, anchor)
    frame = spark.createDataFrame(chunks, "accession_number string, chunk_index int, content string")
    found = ret.nearest_scale(spark.createDataFrame(anchors, "question_id int, accession_number string, anchor int"), frame, stretch=stretch)
    assert found.columns == ["question_id", "accession_number", "anchor", "unit_scale"]
    got = {r.question_id: r.unit_scale for r in found.collect()}
    assert got.keys() == expected.keys()
    same_scale = lambda a, b: (a is None) == (b is None) and (a is None or b.split(",")[0].split()[-1] in a.lower())
    assert all(same_scale(got[i], expected[i]) for i in expected)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def brute_matches(chunks, asked, k):
    """By plain Python, in the order that the operators add up in."""
    def similarity(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot, x, y = 0.0, 0.0, 0.0
        for p, q in zip(a, b):
            dot, x, y = dot + p * q, x + p * p, y + q * q
        by = math.sqrt(x) * math.sqrt(y)
        return None if by == 0 else dot / by

    found = []
    for question, filing, vector in asked:
        scored = [(similarity(vector, e), i, c) for f, i, c, e in chunks if f == filing]
        scored.sort(key=lambda s: (s[0] is None, -(s[0] or 0.0), s[1]))
        found += [(question, rank, i, c, None if s is None else round(s, 9)) for rank, (s, i, c) in enumerate(scored[:k], 1)]
    return sorted(found, key=str)


def test_shards_give_their_nearest_only(spark, monkeypatch):
    """Neither form makes a row of every pair, and many shards, ties, nulls and other lengths change no result."""
    rng = random.Random(9)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    chunks = [(f, i, f"{f}{i}", vector()) for f, n in (("a", 90), ("b", 7)) for i in range(n)]
    chunks += [("a", 100 + i, "same", [1.0, 2.0, 0.0, 1.0]) for i in range(30)] + [("a", 200, "none", None), ("a", 201, "gap", [1.0, None, 0.0, 1.0]), ("a", 202, "", [])]
    asked = [(i, "ab"[i % 3 == 0], vector()) for i in range(25)] + [(50, "a", [1.0, 2.0, 0.0, 1.0]), (51, "a", None), (52, "b", [1.0]), (53, "a", []), (54, "a", [0.0, None, 1.0, 1.0])]
    stored, questions = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(asked, QUESTIONS)
    monkeypatch.setattr(ret, "SHARD", 16)
    monkeypatch.setattr(ret, "ASKED", 4)
    monkeypatch.setattr(ret, "HELD", 64)
    key = lambda rows: sorted(((r.question_id, r.rank, r.chunk_index, r.content, None if r.similarity is None else round(r.similarity, 9)) for r in rows), key=str)
    found = ret.match_chunks(questions, stored, 5)
    assert key(found.collect()) == brute_matches(chunks, asked, 5)
    assert "Join Inner, (accession_number" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    ret.register_match_chunks(stored, 16)
    questions.withColumn("vector", F.col("vector").cast("array<double>")).createOrReplaceTempView("asked_of_shards")
    called = spark.sql("""
        SELECT q.question_id, m.*, row_number() OVER (PARTITION BY q.question_id ORDER BY m.similarity DESC NULLS LAST, m.chunk_index) AS rank
        FROM asked_of_shards q, LATERAL match_chunks(q.accession_number, q.vector, 5) m""")
    assert key(called.collect()) == brute_matches(chunks, asked, 5)
    # What is ordered comes out of shards, not out of a join with single chunks.
    assert "Generate explode(best" in called._jdf.queryExecution().optimizedPlan().toString()
