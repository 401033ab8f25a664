"""Packing against the library's own ids, on awkward rows and on words of all kinds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_have_the_ids_of_their_text(library):
    rng = random.Random(4)
    alphabet = list("abzABZ019 \n\t.,;:!?'\"&%$<|>-_/\\") + ["é", "É", "ß", "Σ", "σ", "ς", "İ", "日", "本", "😀", "́", " ", " ", "\x1c", "\x85", "'s", "'LL", "<|endoftext|>", "ﬁ", "½", "ſ", "Ⱥ", "ǅ", "ŉ", "×", "'", "’", "Ω", "Å", "e\u0301", "¡", "\x7f", "\x01", "­"]
    ids = packing.Ids(VOCABULARY)
    for n in range(6000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 24)))
        assert np.frombuffer(ids.of_text(text), "<u4").tolist() == library(text), repr(text)


def test_long_texts_in_blocks(library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    monkeypatch.setattr(packing, "KNOWN", 20)
    text = "Some words, and others; no two blocks end alike. " * 40 + "x" * 300
    assert np.frombuffer(packing.Ids(VOCABULARY).of_text(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 8191, 10**6 + 1])
def test_lengths(n):
    found = packing.lengths(n)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 2048 for x in found)
    small = [x for x in found if x < 2048]
    assert len(set(small)) == len(small)


def test_every_id_lies_in_one_piece(spark, documents, library):
    rows = documents.select("doc_id", "text").collect()
    out = packing.pack(documents.withColumn("offset", F.lit(7)).withColumn("start", F.lit(1)).repartition(3), VOCABULARY, most=64)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    found = out.withColumn("crc", F.crc32("ids")).collect()
    expected = []
    for row in rows:
        ids, start = library(row.text) + [1], 0
        for n in packing.lengths(len(ids), 64):
            expected.append((row.doc_id, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
            start += n
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.start, r.length, r.crc, r.doc_tokens) for r in found) == order(expected)
    # Every sequence is one piece, and numbers go through the buckets from the longest on.
    assert len({r.sequence_id for r in found}) == len(found) and min(r.sequence_id for r in found) >= 0
    by_number = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True) and {r.offset for r in found} == {0}


def test_empty_table_and_wrong_length(empty):
    assert packing.pack(empty, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, VOCABULARY, most=100)


def test_plain_words_need_no_cut(monkeypatch):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    words = ["Tion", "tion", "Ünd", "don't", "THE", "a1", "x"]
    expected = [packing.Ids(vocabulary).of_words([word]) for word in words]
    cut = []
    monkeypatch.setattr(packing, "_cut", lambda word, whole=packing._cut: cut.append(word) or whole(word))
    assert [packing.Ids(vocabulary).of_words([word]) for word in words] == expected
    assert sorted(cut) == sorted(["ünd", "don't", "a1"])
