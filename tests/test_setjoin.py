import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import history, setjoin
from ledgerloom.session import kept


def brute(sets, num, den):
    found = {}
    for key, words, first in sets:
        alike = [f for _, other, f in sets if set(words) & set(other) and den * len(set(words) & set(other)) >= num * len(set(words) | set(other))]
        found[key] = min([first, *alike])
    return found


def corpus(seed, n=250):
    """Sets of all sizes over a skewed vocabulary, with near copies; one word stands in most of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    sets = {}
    while len(sets) < n:
        words = set(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=rng.choice([0, 1, 2, 3, 4, 5, 8, 15, 40]))) | ({"the"} if rng.random() < 0.6 else set())
        if sets and rng.random() < 0.3:
            words = set(rng.choice(list(sets)))
            words = {w for w in words if rng.random() < 0.8} | set(rng.sample(vocabulary, rng.randrange(3)))
        sets[tuple(sorted(words))] = None
    order = rng.sample(range(10 * n), n)
    return [(i, list(words), order[i]) for i, words in enumerate(sets)]


@pytest.mark.parametrize("num, den", [(1, 4), (1, 2), (4, 5), (1, 1), (3, 10)])
def test_earliest_similar_equals_all_pairs(spark, num, den):
    sets = corpus(num * 10 + den)
    frame = spark.createDataFrame(sets, "key int, words array<string>, first int")
    found = setjoin.earliest_similar(frame, num, den)
    assert {r.key: r.earliest for r in found.collect()} == brute(sets, num, den)


def test_pairs_meet_on_rare_words_only(spark):
    """A word of every set joins none of them, and no plan compares all pairs."""
    rng = random.Random(1)
    sets = [(i, sorted({"the", "and", *(f"x{rng.randrange(10**6)}" for _ in range(10))}), i) for i in range(400)]
    ordered = setjoin.by_rarity(spark.createDataFrame(sets, "key int, words array<string>, first int"))
    assert setjoin.prefixes(ordered, 1, 4).filter("word in ('the', 'and')").count() == 0
    plan = setjoin.earlier_pairs(ordered, 1, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_risks_of_a_corpus(spark):
    rows = [
        (1, "2020-01-01", ["Supply chain disruption in Asia", "Foreign exchange losses", "a of"]), (2, "2020-01-01", ["Disruption of the supply chain across Asia"]),
        (3, None, ["Exchange losses, foreign!"]), (4, "2019-05-05", ["Quantum computers break our encryption", "Quantum computers may break encryption"]),
        (5, "2021-01-01", None), (6, "2021-01-01", []), (7, "2022-01-01", [None, "Encryption broken by quantum computers"]),
    ]
    frame = spark.createDataFrame(rows, "id bigint, filing_date string, risk_factors array<string>").withColumn("filing_date", F.col("filing_date").cast("date"))
    found = {(r.id, r.position): (r.first_id, r.is_new) for r in history.corpus_risk_drift(frame).collect()}
    assert found == {(1, 0): (1, True), (1, 1): (1, True), (1, 2): (1, True), (2, 0): (1, False), (3, 0): (1, False), (4, 0): (4, True), (4, 1): (4, True),
                     (7, 0): (7, True), (7, 1): (4, False)}
    assert history.corpus_risk_drift(frame.limit(0)).count() == 0


@pytest.mark.parametrize("num, den", [(1, 4), (1, 2), (4, 5)])
def test_common_words_join_by_two(spark, num, den):
    """Sets that share only common words are found as well, and pairs are compared where they meet."""
    sets = corpus(5 + den)
    frame = spark.createDataFrame(sets, "key int, words array<string>, first int")
    found = setjoin.earliest_similar(frame, num, den, rare=3)
    assert {r.key: r.earliest for r in found.collect()} == brute(sets, num, den)
    ordered = kept(setjoin.by_rarity(frame, 3), "ordered")
    assert setjoin.common_pairs(ordered, num, den).count() > 0
    # Pairs are compared in the join that they meet in, not written and joined with their words again.
    plan = setjoin.earlier_pairs(ordered, num, den)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("crowd", [6, 15])
def test_long_lists_meet_in_shards(spark, crowd):
    sets = corpus(crowd)
    frame = spark.createDataFrame(sets, "key int, words array<string>, first int")
    found = setjoin.earliest_similar(frame, 1, 4, rare=3, crowd=crowd)
    assert {r.key: r.earliest for r in found.collect()} == brute(sets, 1, 4)
    pairs = setjoin.common_pairs(kept(setjoin.by_rarity(frame, 3, crowd), "ordered"), 1, 4)
    longest = [df.groupBy(*on).count().agg(F.max("count")).first()[0] for df, on in (
        (pairs, ["one", "two"]), (setjoin.sharded(pairs, crowd), ["one", "two", "block"]))]
    assert longest[1] < longest[0] > crowd


@pytest.mark.parametrize("short, ahead, held", [(48, 8, 1 << 17), (4, 2, 64), (0, 0, 1)])
def test_lists_are_compared_in_blocks(monkeypatch, short, ahead, held):
    """Every set of a list finds its earliest similar one, however long the list, and wherever batches end."""
    for name, value in {"SHORT": short, "AHEAD": ahead, "HELD": held, "GATHERED": 30}.items():
        monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(held)
    rows, expected = [], set()
    for word, size in enumerate([1, 200, 3, 70, 0, 25, 60]):
        # Copies of a few sets with some words changed, some of nothing but the word they meet on.
        sides = [-1] * size if word % 2 else [rng.randrange(2) for _ in range(size)]
        known = [set(rng.sample(range(400), rng.choice([0, 2, 6, 12, 60]))) for _ in range(9)]
        members = [{w if rng.random() < 0.7 else rng.randrange(400) for w in rng.choice(known)} for _ in range(size)]
        for i, rest in enumerate(members):
            key, n = 1000 * word + i, len(rest) + 1 + rng.randrange(3)
            rows.append((word, key, key, n, [w << 31 for w in rest], sides[i]))
            for j in range(i):
                other = rows[len(rows) - 1 - i + j]
                shared = 1 + len(rest & members[j])
                if (sides[i] == -1 or sides[i] != sides[j]) and 4 * shared >= n + other[3] - shared:
                    expected.add((key, other[1]))
                    break
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["word", "key", "first", "n", "rest", "side"])
    run = setjoin._earliest_in(1, 1, 1, 4)
    found = [r for batch in run(iter(table.to_batches(max_chunksize=7))) for r in batch.to_pylist()]
    assert {(r["key"], r["earliest"]) for r in found} == expected and len(found) == len(expected) > 100


def test_many_copies_are_answered_once(spark):
    """Of near copies each asks a list for its earliest only; pairs would grow with the square of their number."""
    common = [f"c{i}" for i in range(8)]
    answers = {}
    for n in (100, 400):
        sets = [(i, [*common[:i % 3], *common[3:], f"own{i}"], i) for i in range(n)]
        frame = spark.createDataFrame(sets, "key int, words array<string>, first int")
        for rare in (3, 1000):
            ordered = kept(setjoin.by_rarity(frame, rare), "ordered")
            answers[n, rare] = setjoin.earlier_pairs(ordered, 1, 4).count()
            found = setjoin.earliest_similar(frame, 1, 4, rare=rare)
            assert {r.key: r.earliest for r in found.collect()} == dict.fromkeys(range(n), 0)
    assert all(0 < answers[400, rare] < 5 * answers[100, rare] for rare in (3, 1000))
