"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations as c

LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def grams(rows, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    return counts, totals


def brute(rows, least, top, longest=5, hides=100):
    counts, totals = grams(rows, longest)
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        if any(l2 == lang and len(w2) > len(words) and inside(words, w2) and 100 * f >= hides * a for (l2, w2), f in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    found = set()
    for lang, rows in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "\x01", "naïve"]
    passages = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(3)]
    found = []
    for i in range(400):
        words = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(64)], k=rng.randrange(0, 60))
        text = "".join(w.upper() * (rng.random() < 0.1) or w for w in [w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for w in words])
        found.append((rng.choice(["en", "de", "und", None]), text + rng.choice(["", *passages])))
    return found + [("en", None), (None, ""), ("en", "same " * 3000), ("xx", "?!")] + [("fr", "bon jour le monde")] * 50


@pytest.mark.parametrize("hides", [100, 60])
def test_equal_plain_counting(spark, rows, hides):
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "lang string, text string, n int, f int, phrase string, own int").repartition(5)
    out = c.collocations(frame, least=12, top=40, hides=hides)
    assert {tuple(r) for r in out.collect()} == brute(rows, 12, 40, hides=hides)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("own, trigger", [(64, 16), (3, 1000), (2, 1), (1, 2)])
def test_chunks_own_every_place_once(rows, monkeypatch, own, trigger):
    """Whatever the triggers, each n-gram belongs to one chunk."""
    monkeypatch.setattr(c, "OWN", own)
    monkeypatch.setattr(c, "TRIGGER", trigger)
    counts = Counter()
    at, chunks, owned = c.parse(pa.array([t for _, t in rows], pa.string()), 5, c.Hashes())
    for row, chunk, own in zip(at.tolist(), chunks.to_pylist(), owned.tolist()):
        words, seen = chunk.split(" "), 0
        for i, word in enumerate(words):
            if word == "\n":
                continue
            seen += 1
            if seen > own:
                break
            for n in range(1, 6):
                if i + n <= len(words) and "\n" not in words[i : i + n]:
                    counts["und" if rows[row][0] is None else rows[row][0], tuple(words[i : i + n])] += 1
    longer = lambda found: {k: n for k, n in found.items() if len(k[1]) > 1}
    assert longer(counts) == longer(grams(rows)[0])


def test_equal_passages_share_chunks():
    long = "some words that many texts share and that go on for a good while until they end " * 4
    _, chunks, _ = c.parse(pa.array([f"one {long}", f"another one {long}"]), 5, c.Hashes())
    both = Counter(chunks.to_pylist())
    assert sum(n > 1 for n in both.values()) >= len(both) - 4


def test_a_full_bitmap_denies_nothing():
    import numpy as np

    marks = c.Marks.__new__(c.Marks)
    marks.words = np.full(c.BITS // 64, -1, np.int64).view(np.uint64)
    assert marks.has(np.arange(1000, dtype=np.uint64)).all()
    marks.words = np.zeros(c.BITS // 64, np.uint64)
    assert not marks.has(np.arange(1000, dtype=np.uint64)).any()


def test_packed_hashes():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 4000):
        short, counts = c._added(rng.integers(0, 1 << 40, n, dtype=np.uint64), rng.integers(1, 2**40, n))
        back = c._unpack(c._pack(short, counts))
        assert (back[0] == short).all() and (back[1] == counts).all() and (np.diff(short.astype(np.int64)) > 0).all()


def test_many_parts_that_are_added_up_often_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "PART", 64)
    monkeypatch.setattr(c, "GATHERED", 50)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert {tuple(r) for r in c.collocations(frame, least=12, top=40).collect()} == brute(rows, 12, 40)


def test_counts_beyond_64_bits(spark):
    counts = spark.createDataFrame([(9 * 10**14, 9 * 10**17, 10**15, 9 * 10**14)], "a bigint, n bigint, l bigint, r bigint")
    wide = lambda x: F.col(x).cast("decimal(19, 0)")
    top = F.lit(1000).cast("decimal(4, 0)") * F.col("a").cast("decimal(15, 0)") * wide("n")
    row = counts.withColumn("top", top).withColumn("bottom", wide("l") * wide("r")).selectExpr("top div bottom as s").first()
    assert row.s == 1000 * 9 * 10**14 * 9 * 10**17 // (10**15 * 9 * 10**14)


def test_empty(empty):
    assert c.collocations(empty).count() == 0
