import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns whose names clash with results."""
    prose = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
    lines = "\n".join(f"line {i} tells about number {i * 7} of the series in some detail" for i in range(30))
    rows = [
        (0, prose, "en", "a"), (1, prose, "en", "a"), (2, prose.replace("word5x5", "other"), "en", "b"), (2, "short text", "en", "b"),
        (3, None, "en", None), (4, "", None, "a"), (5, " \n\t ", "de", "a"), (6, lines, "de", "b"),
        (7, lines + "\nand one more line that is its own", "de", "c"), (8, "日本語のテキスト" * 40, "ja", None), (9, "x" * 5000, "xx", "c"),
        (10, "password = abcdefghijkl1 and token: short", "en", "a"), (11, "Case CASE case\r\n\x0bend", "en", "a"),
        (None, prose, "en", "a"), (None, None, None, None), (12, lines.upper(), "en", "b"), (13, "😀 é " * 50, "fr", "c"),
        (0, prose, "en", "a"),
    ]
    wide = [(*r, len(r[1] or ""), 1, "z", [1], True) for r in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key string, ids array<int>, kept boolean"
    )
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
