"""The pipeline's stages one after the other, and all registered queries on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm import queries
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
with_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


@with_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    problem, rows = compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None and rows > 0


def tables(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, tmp_path, documents):
    sf_dir = tables(spark, tmp_path, documents)
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        if name != "bpe":
            assert out.columns == documents.columns
            assert {(r.size, r.key, r.kept) for r in out.select("size", "key", "kept").collect()} == {(1, "z", True)}
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
    # Long enough texts without repeats pass the rules.
    assert {r.doc_id for r in kept["quality_rules"]} >= {0, 1, 2, 6, 7, None} and all(r.text for r in kept["quality_rules"])
    lines = kept["line_dedup"]
    # Copies of whole texts and all of a text's lines but its own one are gone.
    assert 1 not in {r.doc_id for r in lines} and [r.text for r in lines if r.doc_id == 7] == ["and one more line that is its own"]
    assert all(r.n_chars == len(r.text) for r in lines)
    groups = kept["ngram_jaccard"]
    assert len({r.doc_id for r in groups}) == len(groups)
    words = Counter()
    for r in groups:
        words[r.source] += len(r.text.split())
    taken = Counter()
    for r in kept["source_mix"]:
        taken[r.source] += len(r.text.split())
    assert all(t <= 2 * words[s] for s, t in taken.items())
    assert len(kept["bpe"]) == len(kept["source_mix"]) and all(r.decodes and len(r.ids) == r.n_tokens for r in kept["bpe"])


def test_near_copies_between_the_thresholds(spark, documents):
    """35 words after 200: 0.848 of the runs of five words, 0.850 of those of three; 60 words leave 0.77."""
    words = [f"w{i}" for i in range(260)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words[:235])), (3, " ".join(words[:200] + [f"v{i}" for i in range(60)]))]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [1, 3]


def test_empty_tables(spark, tmp_path, empty):
    sf_dir = tables(spark, tmp_path, empty)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
