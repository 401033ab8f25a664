"""The four end-to-end flows, each over all companies, filings or questions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.documents import valid_question
from ledgerloom.operators import documents, evaluation, facts as fact_ops, retrieval


def financials(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annual, quarterly) financials of every company."""
    return fact_ops.annual_frame(facts), fact_ops.quarterly_frame(facts)


def chunks_to_index(pages: DataFrame, stored: DataFrame, cap: int | None = None) -> DataFrame:
    """Chunks that still have to be embedded, from (accession_number, html) and the stored chunks.

    HTML to text, chunking and batching; what is stored already is skipped. A
    ``cap`` truncates the texts, keeping the sections that matter.
    """
    texts = documents.filing_text(pages.select("accession_number", "html"), cap)
    return documents.remaining_chunks(texts, stored)


def ask(questions: DataFrame, chunks: DataFrame, k: int = S.RETRIEVED_CHUNKS) -> DataFrame:
    """Prompt context, sources and unit scale of every valid question that finds something.

    ``questions``: (question_id, accession_number, question, vector). The unit
    declaration is looked up from the nearest chunk.
    """
    valid = questions.filter(valid_question(F.col("question")))
    found = retrieval.match_chunks(valid, chunks, k)
    anchors = found.filter(F.col("rank") == 1).select("question_id", "accession_number", F.col("chunk_index").alias("anchor"))
    scales = retrieval.nearest_scale(anchors, chunks).select("question_id", "unit_scale")
    return retrieval.question_context(valid.select("question_id", "question"), found, scales)


def evaluate(
    records: DataFrame, facts: DataFrame, candidates: Sequence[fact_ops.Candidate] = tuple(
        c for c in S.ANNUAL_CANDIDATES if c[0] in S.FRAME_METRICS
    )
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, history, rejects) of extraction records of any number of runs.

    Every run is scored under the current rules. ``rejects`` are keys that no
    fact covers.
    """
    keys = records.filter(~evaluation.has_error()).select("cik", "fiscal_year")
    truth, rejects = fact_ops.ground_truth(facts, keys, candidates)
    scores = evaluation.score_records(evaluation.attach_truth(records, truth))
    return scores, evaluation.run_history(scores), rejects
