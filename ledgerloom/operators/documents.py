"""Filing documents to stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.documents import chunk_text, estimate_tokens, plan_batches, prioritize_sections
from ledgerloom.functions.html import visible_text
from ledgerloom.functions.strings import dashless


def page_text(documents: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Documents with the visible text of their HTML, well formed or not, by column expressions alone."""
    return documents.withColumn(text, visible_text(F.col(html)))


def filing_text(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """HTML documents with their plain text, whole unless ``cap`` is given; documents without text are dropped."""
    text = page_text(documents).drop("html")
    if cap is not None:
        text = text.withColumn("text", prioritize_sections(F.col("text"), cap))
    return text.filter(F.col("text") != "")


def chunks(
    filings: DataFrame,
    text: str = "text",
    size: int = S.CHUNK_CHARS,
    overlap: int = S.CHUNK_OVERLAP,
    limit: int | None = None,
    budget: int = S.TOKEN_BUDGET,
) -> DataFrame:
    """One row per chunk: index, content, token estimate and request batch.

    A map-only step: windows, numbering and packing happen inside the row of
    the filing, before it is spread into chunks. With a ``limit`` only that many
    chunks of a filing are kept, and ``cut`` tells whether there were more.
    """
    others = [c for c in filings.columns if c != text]
    pieces = filings.select(*others, chunk_text(F.col(text), size, overlap).alias("__chunks"))
    if limit is not None:
        pieces = pieces.withColumn("cut", F.size("__chunks") > limit).withColumn("__chunks", F.slice("__chunks", 1, limit))
        others = [*others, "cut"]
    return spread_chunks(pieces, others, budget)


def spread_chunks(pieces: DataFrame, others: list[str], budget: int, first: Column | None = None) -> DataFrame:
    """Rows of a ``__chunks`` array from index ``first`` on, packed into batches."""
    first = F.lit(0) if first is None else first
    todo = pieces.withColumn("__first", first.cast("int")).withColumn(
        "__todo", F.slice("__chunks", F.col("__first") + 1, F.size("__chunks"))
    )
    todo = todo.withColumn("__tokens", F.transform("__todo", lambda chunk: estimate_tokens(chunk)))
    zipped = F.arrays_zip(
        F.col("__todo").alias("content"), F.col("__tokens").alias("tokens"), plan_batches(F.col("__tokens"), budget).alias("batch")
    )
    rows = todo.select(*others, "__first", F.posexplode(zipped).alias("pos", "item"))
    return rows.select(
        *others,
        (F.col("__first") + F.col("pos")).alias("chunk_index"),
        F.col("item.content"),
        F.col("item.tokens"),
        F.col("item.batch"),
    )


def stored_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("accession_number").agg(F.count(F.lit(1)).cast("int").alias("stored"))


def remaining_chunks(
    filings: DataFrame,
    stored: DataFrame,
    size: int = S.CHUNK_CHARS,
    overlap: int = S.CHUNK_OVERLAP,
    budget: int = S.TOKEN_BUDGET,
) -> DataFrame:
    """Chunks still to index: numbering continues at the stored count.

    ``filings`` holds (accession_number, text). The texts are chunked after the
    join, so only one copy of a text crosses the network.
    """
    joined = filings.join(stored_counts(stored), "accession_number", "left").fillna({"stored": 0})
    pieces = joined.withColumn("__chunks", chunk_text(F.col("text"), size, overlap)).drop("text")
    first = F.least(F.col("stored"), F.size("__chunks"))
    return spread_chunks(pieces, ["accession_number"], budget, first)


def index_coverage(stored: DataFrame, schedule: DataFrame) -> DataFrame:
    """State of every filing from stored chunks and (accession_number, chunks_total, running).

    A filing is complete once any chunk is stored and no run is going on; without
    a schedule the stored count is the total.
    """
    joined = stored_counts(stored).join(schedule, "accession_number", "full_outer")
    indexed = F.coalesce(F.col("stored"), F.lit(0))
    state = (
        F.when(F.coalesce(F.col("running"), F.lit(False)), "indexing")
        .when(indexed > 0, "complete")
        .otherwise("unavailable")
    )
    return joined.select(
        "accession_number",
        state.alias("state"),
        indexed.alias("chunks_indexed"),
        F.coalesce(F.col("chunks_total"), indexed).cast("int").alias("chunks_total"),
    )


def resolve_documents(analyses: DataFrame, filings: DataFrame) -> DataFrame:
    """Primary document of stored filings; null where the index does not list it."""
    listed = filings.select(
        "cik", dashless(F.col("accession_number")).alias("accession_number"), "ord", "primary_document"
    )
    first = listed.groupBy("cik", "accession_number").agg(F.min_by("primary_document", "ord").alias("primary_document"))
    return analyses.join(first, ["cik", "accession_number"], "left")


def backfill_status(resolved: DataFrame, texts: DataFrame, stored: DataFrame | None, added: DataFrame) -> DataFrame:
    """What a repair run did per filing: indexed, complete or failed.

    ``resolved`` from ``resolve_documents``; ``texts`` holds (accession_number,
    expected) chunk counts of the filings with text; ``stored`` the counts before the
    run (None: ``texts`` has them in a column of that name) and ``added`` the chunks it stored.
    """
    known = texts.select("accession_number", "expected", *(["stored"] if stored is None else []))
    joined = resolved.select("accession_number", "primary_document").join(known, "accession_number", "left")
    if stored is not None:
        joined = joined.join(stored.select("accession_number", "stored"), "accession_number", "left")
    joined = (
        joined
        .join(added.select("accession_number", "added"), "accession_number", "left")
        .fillna({"stored": 0, "added": 0})
    )
    status = (
        F.when(F.col("primary_document").isNull() | F.col("expected").isNull() | (F.col("expected") == 0), "failed")
        .when(F.col("stored") >= F.col("expected"), "complete")
        .when(F.col("stored") + F.col("added") >= F.col("expected"), "indexed")
        .otherwise("failed")
    )
    return joined.withColumn("status", status)


def backfill_report(status: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Filings per status. ``status`` holds (position, status, quota_hit).

    The run stops at the first filing that met the daily request quota; that
    one and everything after it were not attempted. ``hits`` has (position, quota_hit)
    alone, where that can be read without working out the status.
    """
    stop = (status if hits is None else hits).agg(F.min(F.when(F.col("quota_hit"), F.col("position"))).alias("at")).scalar()
    late = F.coalesce(F.col("position") >= stop, F.lit(False))
    final = F.when(late, "not attempted").otherwise(F.col("status"))
    return status.groupBy(final.alias("status")).agg(F.count(F.lit(1)).alias("filings"))


def embedding_gaps(batches: DataFrame, dim: int = S.EMBEDDING_DIM) -> DataFrame:
    """Per (accession_number, batch): texts, usable vectors and whether the batch stands."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == dim)
    counted = batches.groupBy("accession_number", "batch").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(usable).alias("vectors")
    )
    return counted.withColumn("whole", F.col("texts") == F.col("vectors"))
