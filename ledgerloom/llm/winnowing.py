"""Document fingerprints by winnowing.

Hashes of ``K`` words in a row are taken at every place; of every ``W`` neighbouring
hashes the least one is chosen, the rightmost of equal ones, and kept with its place.
Two texts with ``K + W - 1`` equal words in a row always share a fingerprint, and a
shared one proves ``K`` equal words (up to the hash).

Words end at ASCII white space; characters of scripts that are written without
spaces are words of their own, and longer runs are cut every ``RUN`` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import evaluated

K, W, RUN = 5, 4, 16
UNSPACED = r"฀-໿က-႟ក-៿⺀-鿿ꥠ-꥿가-힯豈-﫿"
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,{RUN}}}"


def _kept_places(grams: Column, w: int) -> Column:
    """Places whose hash is the least of some window of ``w``, the rightmost of equal ones.

    A place is chosen when larger-or-equal neighbours before it and larger ones after
    it fill a window; fewer than ``w`` hashes are one window.
    """
    def chosen(place: Column) -> Column:
        own = F.get(grams, place)

        def run(step: int, depth: int) -> Column:
            """How many neighbours in a row, up to w - 1, do not beat the place."""
            if depth == w:
                return F.lit(0)
            there = F.get(grams, place + step * depth)
            holds = there >= own if step < 0 else there > own
            return F.when(holds, 1 + run(step, depth + 1)).otherwise(0)

        return run(-1, 1) + run(1, 1) + 1 >= F.least(F.lit(w), F.size(grams))

    places = F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, chosen)


def with_fingerprint(rows: DataFrame, text: str, prefix: str = "", k: int = K, w: int = W) -> DataFrame:
    """Add ``hashes`` and ``places`` (in words): the fingerprint of every whole text; a null text has none.

    A text of fewer than ``k`` words is one hash of all of them.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = evaluated(rows, __words=F.transform(tokens, lambda token: F.xxhash64(token)))
    n = F.size("__words")
    every = F.transform("__words", lambda word, i: F.xxhash64(word, *[F.get(F.col("__words"), i + j) for j in range(1, k)]))
    grams = F.when(n >= k, F.slice(every, 1, F.greatest(n - k + 1, F.lit(1)))).when(n > 0, F.slice(every, 1, 1)).otherwise(F.array().cast("array<bigint>"))
    rows = evaluated(rows, __grams=grams)
    rows = evaluated(rows, **{f"{prefix}places": _kept_places(F.col("__grams"), w)})
    hashes = F.transform(F.col(f"{prefix}places"), lambda place: F.get(F.col("__grams"), place))
    return evaluated(rows, **{f"{prefix}hashes": hashes}).drop("__words", "__grams")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of hashes; 1 if both are empty, 0 for a null."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when(a.isNull() | b.isNull(), 0.0).when(either == 0, 1.0).otherwise(shared / either)


def digest(hashes: Column, places: Column) -> Column:
    """SHA-256 of all hashes with their places."""
    pairs = F.zip_with(hashes, places, lambda h, p: F.concat_ws("@", F.hex(h), p))
    return F.sha2(F.array_join(pairs, ","), 256)


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, order, bucket, copy, next, rank): every text with that of the next key, the last one's being the first.

    Rows are dealt into ranges of keys; a range also gets the first row of the range
    after it, so no task sees all rows. Null keys come last, rows of one key in order
    of their text. The copies of first rows have ``copy`` set.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce(key, F.lit(2**63 - 1)))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One bound per shuffle partition.
    bounds = rows.agg(F.percentile_approx("order", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    cuts = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(cuts, _below(F.col("order")))))
    firsts = rows.groupBy("bucket").agg(F.min("order").alias("first"))
    before = F.lag("bucket").over(Window.orderBy("bucket"))
    last = F.max("bucket").over(Window.partitionBy())
    firsts = firsts.select(F.col("bucket").alias("home"), "first", F.coalesce(before, last).alias("target"))
    # As many rows as ranges.
    copies = rows.join(F.broadcast(firsts), (F.col("bucket") == F.col("home")) & (F.col("order") == F.col("first")))
    copies = copies.groupBy("target").agg(F.min(F.struct("order", "text", key)).alias("c"))
    copies = copies.select(f"c.{key}", "c.text", "c.order", F.col("target").alias("bucket"), F.lit(True).alias("copy"))
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies)
    return every.withColumn("next", F.lead("text").over(_in_order())).withColumn("rank", F.row_number().over(_in_order()))


def _below(order: Column):
    return lambda bound: bound < order


def _in_order(*more: str):
    return Window.partitionBy("bucket").orderBy("copy", "order", *(more or ["text"]))


def edited(text: Column, following: Column) -> Column:
    """The last quarter replaced by as much of the beginning of the other text (or all of it)."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_fingerprints).

    Every text is compared with its edited form and with the next text. Null counts
    as the empty text, whose fingerprint is that of an empty list. Rows that share a
    key follow each other in order of their text. A single row is its own next one;
    an empty table gives an empty result; other columns are left out.
    """
    rows = with_next_text(docs, key, text)
    rows = evaluated(rows, edited=F.when(~F.col("copy"), edited(F.col("text"), F.col("next"))))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(with_fingerprint(rows, "text"), "edited", "edited_")
    rows = rows.drop("text", "edited", "next")
    rows = rows.withColumn("next_hashes", F.lead("hashes").over(_in_order("rank"))).filter(~F.col("copy"))
    return rows.select(
        key, "n_chars", "edited_sha256", digest(F.col("hashes"), F.col("places")).alias("fingerprint"),
        digest(F.col("edited_hashes"), F.col("edited_places")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("hashes").cast("bigint").alias("n_fingerprints"),
    )
