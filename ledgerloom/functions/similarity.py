"""Word sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import settings as S

# Whitespace as a browser's regular expressions see it.
_SPACES = " \t\n\x0b\f\r" + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"

# Punctuation and letters beyond a-z that are common enough to be removed by
# lookup; what is rarer is left to a pattern, which only sees sentences that have such.
_COMMON = "".join(
    chr(c)
    for c in (*range(0x21, 0x250), *range(0x2010, 0x2028))
    if not chr(c).isspace() and chr(c) not in _LETTERS
)


def content_words(sentence: Column, stop_words=tuple(S.STOP_WORDS), shortest: int = 3) -> Column:
    """Distinct lower-case words of ``shortest`` letters or more, stop words removed."""
    common = F.translate(F.lower(sentence), _SPACES + _COMMON, " " * len(_SPACES))
    plain = F.translate(common, _LETTERS + " ", "") == ""
    kept = F.when(plain, common).otherwise(F.regexp_replace(common, "[^a-z0-9 ]+", ""))
    # A blank alone is no pattern to compile for every row; what is empty between two is too short.
    words = F.filter(F.split(kept, " "), lambda word: F.length(word) >= shortest)
    return F.array_except(words, F.array(*[F.lit(word) for word in stop_words]))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two word sets, 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.try_divide(shared.cast("double"), union)
    )


def substantive_risks(risks: Column) -> Column:
    """False for no risks and for a single 'no material changes' entry."""
    only = F.coalesce(F.contains(F.lower(F.get(risks, F.lit(0))), F.lit(S.NO_CHANGES)), F.lit(False))
    return (F.size(risks) > 0) & ~((F.size(risks) == 1) & only)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """1 - cosine distance; null for a null or zero vector."""
    left_norm = norm(left) if left_norm is None else left_norm
    right_norm = norm(right) if right_norm is None else right_norm
    return F.try_divide(dot(left, right), left_norm * right_norm)
