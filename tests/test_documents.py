import random

from pyspark.sql import functions as F
import pytest

from ledgerloom import settings as S
from ledgerloom.functions import documents as fn
from ledgerloom.operators import documents as docs, retrieval as ret


def text_column():
    return F.col("text")


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><script>x<p>y</p></script><style>p{}</style><b> c </b>", "a\nc"),
    ("one<!-- <p>hidden</p> -->two", "one\ntwo"),
    ("<td title='a>b'>x &amp; y</td>", "x & y"),
    ("&#8217;&#x2019;&#146;&nbsp;", "’’’"),
    ("&lt;b&gt; &copy 2020 &bogus; &#99999999;", "<b> © 2020 &bogus �"),
    ("a<br>b\r\n\r\n  c", "a\nb\nc"),
    ("<!DOCTYPE html><title>T</title>5 < 6", "T\n5 < 6"),
    ("broken <a href='x y>tail", "broken <a href='x y>tail"),
    ("a<script>b<p>c", "a"), ("a<!-- b <p>c", "a"), ("a<style>p{}", "a"), ("<a href=it's>x</a>", "x"), ("a</3>b</>c", "a\nb\nc"),
    ("A &foo; B &notit; C", "A &foo B &notit C"), ("A &foo; B &notit; C <a href='x", "A &foo B &notit C <a href='x"),
    ("", ""),
])
def test_html(spark, html, text):
    pages = spark.createDataFrame([(html,)], "html string")
    assert docs.page_text(pages).first().text == text


def test_html_stays_in_the_jvm(spark):
    pages = spark.range(1).select(F.concat(F.lit("<p>"), "id").alias("html"))
    plan = docs.page_text(pages)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan


HEADINGS = [
    "Item 7. Management's Discussion", "Item 7. Management’s Discussion", "Item 2—Management’s Discussion",
    "Item 2-Management's Discussion", "Item 2,\nManagement's Discussion", "ITEM 2. MANAGEMENT’S DISCUSSION", "Item 2.  Managements Discussion",
]


@pytest.mark.parametrize("heading", HEADINGS)
def test_heading_spellings(one, heading):
    text = f"front {heading}\nbody item 8 rest"
    span = one(fn.section_span(text_column(), S.MDA_START, S.MDA_END), text=text)
    assert text[span.s:span.e] == f"{heading}\nbody "


def test_last_heading_wins_and_a_quoted_reference_does_not_count(one):
    text = "Item 7. Management's Discussion .. 12\nItem 7. Management's Discussion REAL Item 8. See Item 7, “Management’s Discussion”"
    span = one(fn.section_span(text_column(), S.MDA_START, S.MDA_END), text=text)
    assert text[span.s:span.e] == "Item 7. Management's Discussion REAL "
    assert one(fn.section_span(text_column(), S.RISK_START, S.RISK_END), text=text) is None


def test_section_offsets_count_characters(one):
    text = "😀😀 item 1a risk factors 😀 body"
    span = one(fn.section_span(text_column(), S.RISK_START, S.RISK_END), text=text)
    assert (span.s, span.e) == (3, len(text))


def filing():
    contents = "CONTENTS\nItem 1A. Risk Factors 3\nItem 7. Management's Discussion 9\n"
    risk, mda = "Item 1A. Risk Factors\nRISKBODY\n", "Item 7. Management's Discussion\nMDABODY and more words here\n"
    return contents + "x" * 3000 + risk + "y" * 500 + "Item 1B. none\n" + mda + "Item 8. tables\n" + "z" * 3000


def test_truncation_keeps_head_and_sections(one):
    text = filing()
    out = one(fn.prioritize_sections(text_column(), 2000, 400), text=text)
    assert len(out) <= 2000 and "CONTENTS" in out and "RISKBODY" in out and "MDABODY" in out
    assert one(fn.prioritize_sections(text_column(), 9000, 400), text=text) == text
    assert one(fn.prioritize_sections(text_column(), 100), text="q" * 500) == "q" * 100


def test_separators_push_out_the_last_characters(one):
    text = filing()
    spans = one(fn.prioritized_spans(text_column(), 2000, 400), text=text)
    kept = [(p.s, p.e) for p in spans]
    assert kept == sorted(kept) and sum(e - s for s, e in kept) == 2000
    joined = "\n\n".join(text[s:e] for s, e in kept)
    assert one(fn.prioritize_sections(text_column(), 2000, 400), text=text) == joined[:2000]


def test_merge_and_gaps(one):
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in [(5, 9), (0, 3), (3, 4), (8, 12)]])
    assert [(p.s, p.e) for p in one(fn.merge_spans(spans), x=1)] == [(0, 4), (5, 12)]
    gaps = fn.gaps_between(fn.merge_spans(spans), F.lit(15))
    assert [(p.s, p.e) for p in one(gaps, x=1)] == [(4, 5), (12, 15)]


def windows(text, size, overlap, limit):
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    step = size - overlap
    pieces = [text[i:i + size].strip() for i in range(0, len(text), step)]
    return [p for p in pieces if p][:limit]


@pytest.mark.parametrize("length", [0, 1, 1999, 2000, 2001, 3700, 5000, 20000])
def test_chunks(one, length):
    text = "".join(random.Random(length).choice("ab \n é😀") for _ in range(length))
    assert one(fn.chunk_text(text_column()), text=text) == windows(text, 2000, 200, 334)


def test_chunks_skip_blank_windows_and_stop_at_the_limit(one):
    text = "a" * 50 + " " * 100 + "b" * 200
    assert one(fn.chunk_text(text_column(), 40, 10), text=text) == windows(text, 40, 10, 10**9)
    assert one(fn.chunk_text(text_column(), 40, 10, 3), text=text) == windows(text, 40, 10, 3)
    assert one(fn.chunk_text(text_column(), 10, 25), text=text) == [c for c in (text[i:i + 10].strip() for i in range(350)) if c][:600000]
    assert S.max_chunks() == 334
    assert len(one(fn.chunk_text(text_column()), text="x" * 800000)) == 445


def test_tokens_and_batches(one):
    assert one(fn.estimate_tokens(F.lit("")), x=1) == 1
    assert one(fn.estimate_tokens(F.lit("x" * 18)), x=1) == 10
    assert one(fn.plan_batches(F.col("t"), 10), t=[4, 6, 1, 30, 2, 8, 1]) == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("text, scale", [
    ("INCOME\n(amounts in millions, except per share data) (unaudited)", "Amounts in millions, except per share data."),
    ("SHEET\n(dollars\nin   thousands)\n", "Dollars in thousands."),
    ("Amounts are expressed in billions", "Amounts are expressed in billions."),
    ("figures presented in millions.", "Figures presented in millions."),
    ("One in millions of shoppers", None), ("(unaudited)", None),
    ("(see Note 4\n" + "filler " * 100 + "\n(numbers in millions ;.)", "Numbers in millions."),
    ("(in Thousands)", "In Thousands."), ("", None),
])
def test_unit_declarations(one, text, scale):
    assert one(fn.unit_scale(text_column()), text=text) == scale


def test_scale_factor(one):
    assert one(fn.apply_scale(F.lit(2.5), F.lit("Amounts in millions.")), x=1) == 2.5e6
    assert one(fn.apply_scale(F.lit(2.5), F.lit("Amounts in millions."), F.lit(True)), x=1) == 2.5
    assert one(fn.apply_scale(F.lit(2.5), F.lit(None).cast("string")), x=1) == 2.5


def test_nearest_declaration(spark):
    rows = [("a", 1, "(in millions)"), ("a", 4, "one in millions of"), ("a", 9, "(in thousands)"),
            ("b", 3, "one in millions"), ("b", 8, "(in billions)"), ("c", 0, "nothing")]
    chunks = spark.createDataFrame(rows, "accession_number string, chunk_index int, content string")
    anchors = spark.createDataFrame([("a", 0), ("a", 1), ("a", 5), ("a", 9), ("b", 0), ("b", 4), ("c", 0)], "accession_number string, anchor int")
    found = {(r[0], r[1]): r.unit_scale for r in ret.nearest_scale(anchors, chunks).collect()}
    assert found == {
        ("a", 0): "In millions.", ("a", 1): "In millions.", ("a", 5): "In millions.", ("a", 9): "In thousands.",
        # Mentions above that declare nothing do not trigger the fallback.
        ("b", 0): "In billions.", ("b", 4): None, ("c", 0): None,
    }


def test_resume_continues_at_the_stored_count(spark):
    texts = spark.createDataFrame([("a", "x" * 5000), ("b", "y" * 10), ("c", " ")], "accession_number string, text string")
    stored = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "accession_number string, chunk_index int")
    rows = docs.remaining_chunks(texts, stored).collect()
    assert sorted((r.accession_number, r.chunk_index, len(r.content), r.batch) for r in rows) == [("a", 1, 2000, 0), ("a", 2, 1400, 0)]


def test_coverage_states(spark):
    stored = spark.createDataFrame([("a", 0), ("b", 0), ("d", 0)], "accession_number string, chunk_index int")
    schedule = spark.createDataFrame([("a", 3, True), ("b", 4, False), ("c", 5, False)], "accession_number string, chunks_total int, running boolean")
    rows = {r[0]: tuple(r)[1:] for r in docs.index_coverage(stored, schedule).collect()}
    assert rows == {"a": ("indexing", 1, 3), "b": ("complete", 1, 4), "c": ("unavailable", 0, 5), "d": ("complete", 1, 1)}


def test_null_and_zero_vectors_come_last(spark):
    chunks = spark.createDataFrame(
        [("a", i, f"c{i}", v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], None, [1.0, 1.0], [-1.0, 0.0], [2.0, 0.0]])],
        "accession_number string, chunk_index int, content string, embedding array<float>")
    asked = spark.createDataFrame([(7, "a", [1.0, 0.0]), (8, "b", [1.0, 0.0])], "question_id int, accession_number string, vector array<float>")
    rows = sorted(ret.match_chunks(asked, chunks, 6).collect(), key=lambda r: r.rank)
    assert [r.chunk_index for r in rows] == [0, 5, 3, 4, 1, 2]
    assert {r.question_id for r in rows} == {7}


def test_filing_text_drops_empty_documents(spark):
    pages = spark.createDataFrame([("a", "<p>hello</p>"), ("b", "<p> </p>")], "accession_number string, html string")
    assert [tuple(r) for r in docs.filing_text(pages).collect()] == [("a", "hello")]
