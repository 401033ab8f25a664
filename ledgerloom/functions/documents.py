"""Sections, truncation, chunks, token estimates and request batches.

All of it is per row: no operator here moves data between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ledgerloom import settings as S
from ledgerloom.functions.strings import bind, one_line, strip

_SPANS = "array<struct<s:int,e:int>>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def section_span(text: Column, start: str, end: str) -> Column:
    """[s, e) of the last heading matching ``start`` up to the first ``end`` after it.

    Null without a heading; without an end the section runs to the end of the
    text. Splitting at the pattern gives offsets in characters and scans once.
    """
    heading = f"(?iU){start}"
    cuts = F.struct(
        F.try_element_at(F.regexp_extract_all(text, F.lit(heading), F.lit(0)), F.lit(-1)).alias("title"),
        F.try_element_at(F.split(text, heading, -1), F.lit(-1)).alias("tail"),
    )

    def span(cut: Column) -> Column:
        body = F.length(text) - F.length(cut["tail"])
        content = F.try_element_at(F.split(cut["tail"], f"(?iU){end}", 2), F.lit(1))
        located = _span(body - F.length(cut["title"]), body + F.length(content))
        return F.when(cut["title"].isNotNull(), located)

    return bind(cuts, span)


def merge_spans(spans: Column) -> Column:
    """Sorted spans with touching or overlapping ones joined."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.array(_span(last["s"], F.greatest(last["e"], span["e"])))
        return F.when(
            (F.size(done) > 0) & (span["s"] <= last["e"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), joined),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def fill_spans(spans: Column, budget: Column) -> Column:
    """struct(left, taken): spans in order, each cut to what is left of the budget."""

    def take(state: Column, span: Column) -> Column:
        end = F.least(span["e"], span["s"] + state["left"])
        taken = F.struct(
            (state["left"] - (end - span["s"])).cast("int").alias("left"),
            F.concat(state["taken"], F.array(_span(span["s"], end))).alias("taken"),
        )
        return F.when(state["left"] > 0, taken).otherwise(state)

    start = F.struct(budget.cast("int").alias("left"), F.array().cast(_SPANS).alias("taken"))
    return F.aggregate(spans, start, take)


def gaps_between(spans: Column, length: Column) -> Column:
    """The parts of [0, length) outside sorted, disjoint spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda span: span["e"]))
    starts = F.concat(F.transform(spans, lambda span: span["s"]), F.array(length.cast("int")))
    gaps = F.zip_with(ends, starts, lambda end, start: _span(end, start))
    return F.filter(gaps, lambda gap: gap["e"] > gap["s"])


def prioritized_spans(
    text: Column,
    cap: int = S.MAX_FILING_CHARS,
    head: int = S.HEAD_CHARS,
    sections: Sequence[tuple[str, str]] = S.SECTIONS,
) -> Column:
    """Spans kept of a text over ``cap``: the head and the sections first, then the gaps.

    Null when the text has none of the sections.
    """
    found = F.array_compact(F.array(*[section_span(text, start, end) for start, end in sections]))

    def fill(wanted: Column) -> Column:
        return bind(fill_spans(merge_spans(wanted), F.lit(cap)), top_up)

    def top_up(first: Column) -> Column:
        rest = fill_spans(gaps_between(first["taken"], F.length(text)), first["left"])
        return F.array_sort(F.concat(first["taken"], rest["taken"]))

    head_span = F.array(_span(F.lit(0), F.lit(head)))
    return bind(found, lambda spans: F.when(F.size(spans) > 0, fill(F.concat(head_span, spans))))


def kept_spans(
    text: Column,
    cap: int = S.MAX_FILING_CHARS,
    head: int = S.HEAD_CHARS,
    sections: Sequence[tuple[str, str]] = S.SECTIONS,
) -> Column:
    """``prioritized_spans`` of a text over ``cap``; none for any other text."""
    spans = prioritized_spans(text, cap, head, sections)
    return F.when(F.length(text) > cap, F.coalesce(spans, F.array().cast(_SPANS))).otherwise(F.array().cast(_SPANS))


def prioritize_sections(
    text: Column,
    cap: int = S.MAX_FILING_CHARS,
    head: int = S.HEAD_CHARS,
    sections: Sequence[tuple[str, str]] = S.SECTIONS,
) -> Column:
    """Text cut to ``cap`` characters, keeping the head and the named sections.

    Pieces are joined by a blank line that is not charged to the budget, so
    the final cut may drop the last characters.
    """
    if not sections:
        return F.substring(text, 1, cap)
    spans = prioritized_spans(text, cap, head, sections)
    pieces = F.transform(spans, lambda span: F.substring(text, span["s"] + 1, span["e"] - span["s"]))
    joined = F.substring(F.array_join(pieces, "\n\n"), 1, cap)
    plain = F.substring(text, 1, cap)
    return F.when(F.length(text) <= cap, text).otherwise(F.coalesce(joined, plain))


def chunk_text(
    text: Column,
    size: int = S.CHUNK_CHARS,
    overlap: int = S.CHUNK_OVERLAP,
    limit: int | None = None,
) -> Column:
    """Overlapping windows of a text, stripped, blanks dropped, as an array; ``limit`` keeps the first ones.

    The text is cut once into blocks of one stride; a window is a block and as
    much of the following ones as it needs, so the cost is linear in the text.
    """
    stride = max(size - overlap, 1)
    span = -(-size // stride)

    def windows(body: Column, blocks: Column) -> Column:
        cut = F.transform(
            blocks,
            lambda block, i: strip(F.substring(F.array_join(F.slice(blocks, i + 1, F.lit(span)), ""), 1, size)),
        )
        kept = F.filter(cut, lambda window: window != "")
        kept = kept if limit is None else F.slice(kept, 1, limit)
        empty = F.array().cast("array<string>")
        return F.when(body == "", empty).when(F.length(body) <= size, F.array(body)).otherwise(kept)

    def cut_blocks(body: Column) -> Column:
        blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
        return bind(blocks, lambda found: windows(body, found))

    return bind(strip(text), cut_blocks)


def estimate_tokens(text: Column, chars_per_token: float = S.CHARS_PER_TOKEN) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(chars_per_token))).cast("int")


def plan_batches(tokens: Column, budget: int = S.TOKEN_BUDGET) -> Column:
    """Batch number of every item of a token array, packed greedily in order.

    An item over the budget sits alone.
    """

    def place(state: Column, item: Column) -> Column:
        new = (state["used"] > 0) & (state["used"] + item > budget)
        batch = state["batch"] + F.when(new, 1).otherwise(0)
        used = F.when(new, item).otherwise(state["used"] + item)
        return F.struct(
            used.cast("long").alias("used"),
            batch.cast("int").alias("batch"),
            F.concat(state["batches"], F.array(batch.cast("int"))).alias("batches"),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.lit(0).alias("batch"),
        F.array().cast("array<int>").alias("batches"),
    )
    return F.aggregate(tokens, start, place, lambda state: state["batches"])


# --- unit declarations -----------------------------------------------------------

def mentions_scale(text: Column) -> Column:
    """Cheap test that a declaration may be present; parsing decides."""
    lowered = F.lower(text)
    test = F.lit(False)
    for word in S.SCALE_WORDS:
        test = test | F.contains(lowered, F.lit(f"in {word}"))
    return test


def unit_scale(text: Column) -> Column:
    """The unit declaration of a text as one display-ready sentence, else null."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", 1), F.lit(""))

    phrase = F.rtrim(one_line(F.coalesce(found(S.SCALE_PARENTHETICAL), found(S.SCALE_SENTENCE))), F.lit(" .,;:"))
    # The patterns can only match where a scale word is, and that test is cheap.
    mentioned = F.lower(text).rlike("|".join(S.SCALE_WORDS))
    return F.when(mentioned, bind(phrase, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)), F.lit("."))))


def scale_factor(scale: Column) -> Column:
    """Multiplier a unit declaration stands for; 1 without a declaration."""
    lowered = F.lower(scale)
    return (
        F.when(F.contains(lowered, F.lit("in thousands")), F.lit(1e3))
        .when(F.contains(lowered, F.lit("in millions")), F.lit(1e6))
        .when(F.contains(lowered, F.lit("in billions")), F.lit(1e9))
        .otherwise(F.lit(1.0))
    )


def apply_scale(value: Column, scale: Column, excluded: Column | None = None) -> Column:
    """A printed figure in absolute terms; excluded figures stay as printed."""
    scaled = value * scale_factor(scale)
    return scaled if excluded is None else F.when(excluded, value).otherwise(scaled)


# --- questions ---------------------------------------------------------------------

def valid_question(question: Column, bounds: tuple[int, int] = S.QUESTION_CHARS) -> Column:
    return F.length(strip(question)).between(*bounds)


def excerpt(text: Column, chars: int = S.EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)
