"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Quality rules drop documents, line dedup takes repeated lines out of the texts, the
n-gram join leaves one document of each group, the mix repeats or drops documents
so that sources meet their weights, and the last stage encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm import bpe, decision_list, entropy_mix, line_dedup, ngram_join
from ledgerloom.llm.common import table, word_count, written
from ledgerloom.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns out of the way of what an operator adds."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("__")).alias("__others"))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__others")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    judged = decision_list.judge(_aside(docs), table(spark, sf_dir, "labels"))
    return _restored(judged.filter("kept"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; a document of which nothing is left goes."""
    left = line_dedup.dedup(_aside(docs)).filter("n_lines = 0 or n_removed < n_lines")
    kept = _restored(left, docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies (five words, 0.8); of rows with one id, one."""
    found = ngram_join.jaccard_components(docs, n=5, similarity=(80, 100))
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[c for c in docs.columns if c != "doc_id"])
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows = docs.withColumn("__row", F.xxhash64(*docs.columns))
    mixed = entropy_mix.mix(rows.select("__row", "source", word_count(F.col("text")).alias("words")), F.col("words"), key="__row")
    copies = mixed.groupBy("__row").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n"))
    joined = rows.join(copies, "__row").withColumn("__i", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(1))))
    own = F.expr("__copies div __n + if(__i <= __copies % __n, 1, 0)").cast("int")
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), own)).alias("__copy")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decodes): ids of every text, and whether they decode to it."""
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", one_of_each),
    ("source_mix", mix_sources),
    ("bpe", tokens),
]

#: Learned rules, union-find and the tokenizer are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
