"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact check, union-find.

Signature. Shingles of ``SHINGLE`` characters that begin with a word are hashed, of words
one space apart; a short line, or one with few spaces, takes the shingles from every
character. Lines between the limits file under both. What tells the kinds apart, the
length and the share of spaces, changes little between similar lines, and the limits lie
further apart than that. The hash range is cut into ``BINS`` bins; a bin's value is the
least hash in it or, if it is empty, in the bins after it (one permutation, densified by
rotation). The least hashes are added up by line, so that copies have one signature.
Every band takes three bins.

Candidates. Any two lines of one band. First the lines of a band form a star around one
of them, so a bucket of m lines gives m - 1 pairs; stars around other lines follow while
they join much of what is left. Then all pairs of a band whose lines are in different
components are taken, large bands in shards. From the second star on bitmaps of the
shingles, made for the lines still open, leave out pairs that differ in too many bits to
be similar, and no others.

Check. The two lines of a pair are compared on the sets of all their shingles; pairs of
``SIMILARITY`` or more are links, and distributed union-find keeps the first line of
every component. Equal lines are one line from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import discard, evaluated, written
from ledgerloom.llm.components import components

SHINGLE, SIMILARITY = 8, 0.8
# Bins by the three highest bits of a hash, and the bins of each band: seven triples of
# which any two share one bin, so that five equal values always make a whole band.
BINS, HIGH = 8, 61
BANDS = ((0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5))
# Lines up to SHORT characters, or with at most one word in SPARSE characters, as in scripts without spaces, file under
# all shingles; lines from LONG characters on with a word in DENSE characters under those that begin with a word.
SHORT, SPARSE, LONG, DENSE = 160, 10, 100, 40
# Longs of a line's bitmap; lines of a band in a shard; pairs for each line of a band that need no further star;
# one of so many pairs is taken before the rest.
WORDS, SHARD, EACH, THIN = 32, 1024, 16, 16


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, place, line): all lines with a word; ``row`` tells rows apart that share a key, but for equal ones."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, whole).alias("row"), F.posexplode(F.split(whole, "\n", -1)).alias("place", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def _shingles(line: Column) -> Column:
    """All runs of SHINGLE characters; a shorter line is one shingle."""
    found = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(found)


def _bin(value: Column) -> Column:
    """0 to BINS - 1 in the order of signed hashes."""
    return F.shiftright(value, HIGH) + BINS // 2


def with_bands(rows: DataFrame) -> DataFrame:
    """(id, kind, bands): the keys under which every line is filed, in a row for each kind of shingles that it has."""
    rows = evaluated(rows, __words=F.array_remove(F.split("line", " ", -1), ""))
    n, length = F.size("__words"), F.length("line")
    every = (length <= SHORT) | (n * SPARSE <= length)
    spaced = (length >= LONG) & (n * DENSE >= length)
    kinds = F.array(F.struct(F.lit(1).alias("kind"), F.when(spaced, F.col("__words")).alias("__s")), F.struct(F.lit(2).alias("kind"), F.when(every, _shingles(F.col("line"))).alias("__s")))
    parts = rows.select("id", F.inline(kinds)).select("id", "kind", "__s", F.posexplode("__s").alias("__i", "__part"))
    # So many words fill a shingle, whatever their length; spaces follow the last one.
    after = [F.get("__s", F.col("__i") + k) for k in range(1, SHINGLE // 2)]
    begun = F.rpad(F.concat_ws(" ", "__part", *after), SHINGLE, " ")
    hashes = parts.select("id", "kind", F.xxhash64(F.when(F.col("kind") == 1, begun).otherwise(F.col("__part"))).alias("__h"))
    least = [F.min(F.when(_bin(F.col("__h")) == n, F.col("__h"))).alias(f"__{n}") for n in range(BINS)]
    found = hashes.groupBy("id", "kind").agg(*least)
    values = [F.coalesce(*[F.col(f"__{(n + k) % BINS}") for k in range(BINS)]) for n in range(BINS)]
    bands = [F.xxhash64(F.lit(n), "kind", *[values[b] for b in bins]) for n, bins in enumerate(BANDS)]
    return found.select("id", "kind", F.array(*bands).alias("bands"))


def buckets(all_lines: DataFrame) -> DataFrame:
    """(band, id, low): the distinct lines of every band that has two of them, and the least of these."""
    filed = with_bands(all_lines.select(F.xxhash64("line").alias("id"), "line"))
    keyed = filed.select(F.explode("bands").alias("band"), "id")
    around = Window.partitionBy("band")
    return keyed.select("band", "id", F.min("id").over(around).alias("low"), F.max("id").over(around).alias("high")).filter("low <> high").select("band", "id", "low")


def sketches(texts: DataFrame) -> DataFrame:
    """(id, size, bits): the number of a line's shingles, and a bitmap of them in WORDS longs."""
    rows = evaluated(texts, x=F.array_distinct(_hashes(_shingles(F.col("line")))))
    rows = rows.select("id", F.explode("x").alias("h"))
    place = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))")
    # One long of a line at a time, then the longs side by side.
    longs = rows.groupBy("id", place.alias("place")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
    bits = [F.coalesce(F.max(F.when(F.col("place") == n, F.col("bits"))), F.lit(0).cast("bigint")).alias(f"b{n}") for n in range(WORDS)]
    return longs.groupBy("id").agg(F.sum("n").alias("size"), *bits)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, id, root) and other columns of bands whose lines are not all of one component."""
    rows = members.drop("root")
    rows = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    around = Window.partitionBy("band")
    rows = rows.withColumn("low", F.min("root").over(around)).withColumn("high", F.max("root").over(around))
    return rows.filter("low <> high").drop("low", "high")


def _may_reach(similarity: float) -> Column:
    """Whether lines l and r can be similar: every bit that only one bitmap has is a shingle that only one line has."""
    sizes = F.least("l.size", "r.size") >= similarity * F.greatest("l.size", "r.size")
    differ = sum((F.bit_count(F.col(f"l.b{n}").bitwiseXOR(F.col(f"r.b{n}"))) for n in range(WORDS)), F.lit(0))
    return sizes & (differ <= (1 - similarity) / (1 + similarity) * (F.col("l.size") + F.col("r.size")) + 1e-6)


def _star(members: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(id, hub): lines that may be similar to a hub of their band and are not joined to it; every turn has other hubs."""
    drawn = F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), *[c for c in members.columns if c != "band"])
    hubs = members.groupBy("band").agg(F.min(drawn).alias("hub")).select("band", "hub.*")
    both = members.alias("l").join(hubs.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.root") != F.col("r.root")) & _may_reach(similarity))
    return both.select("l.id", F.col("r.id").alias("hub")).distinct()


def _rest(members: DataFrame, similarity: float, thin: int = 1) -> DataFrame:
    """(id, hub): pairs of a band that may be similar and are not joined, all or one of ``thin``; large bands by pairs of shards."""
    shards = members.groupBy("band").agg(F.ceil(F.count("*") / F.lit(float(SHARD))).cast("int").alias("shards"))
    placed = members.join(shards, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    left = placed.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("shards") - 1)))
    right = placed.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("band", "i", "j")]
    once = (F.col("l.i") < F.col("l.j")) | (F.col("l.id") < F.col("r.id"))
    if thin > 1:
        once &= F.pmod(F.xxhash64(F.least("l.id", "r.id"), F.greatest("l.id", "r.id")), F.lit(thin)) == 0
    both = left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & once & (F.col("l.root") != F.col("r.root")) & _may_reach(similarity))
    return both.select(F.least("l.id", "r.id").alias("id"), F.greatest("l.id", "r.id").alias("hub")).distinct()


def _work(members: DataFrame) -> tuple[int, float]:
    """(rows, pairs of one band in different components)."""
    parts = members.groupBy("band", "root").agg(F.count("*").cast("double").alias("n"))
    bands = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    rows, pairs = bands.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(rows or 0), pairs or 0.0


def linked(all_lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): components of the links between lines that share a band."""
    bands = written(buckets(all_lines), "buckets")
    ends = bands.select("id").distinct()
    texts = all_lines.select(F.xxhash64("line").alias("id"), "line").join(ends.hint("shuffle_hash"), "id", "left_semi").distinct()
    texts = written(texts, "texts")
    # The first star, around the least line of a band, and the bands that it leaves open.
    found = written(bands.filter("id <> low").select("id", F.col("low").alias("hub")).distinct(), "pairs")
    links = written(verified(found, texts, similarity), "links")
    roots = components(links, "id", "hub")
    left = written(_open(bands.select("band", "id"), roots), "open")
    discard(bands, found, links)
    unsure = texts.join(left.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    members = written(left.join(sketches(unsure), "id"), "members")
    discard(left)
    turn, before, thinned = 1, None, False
    while True:
        # Stars while they shrink what is left by much, a few of the pairs that are still many, then every pair left.
        rows, pairs = _work(members)
        last = pairs <= EACH * rows or thinned
        thinned = before is not None and pairs > before * 3 / 4
        before = pairs
        if last or thinned:
            found = _rest(members, similarity, 1 if last else THIN)
        else:
            found = _star(members, turn, similarity)
        found = written(found, "pairs")
        # Roots stand for the links that they come from.
        known = roots.select(F.col("node").alias("id"), F.col("root").alias("hub"))
        links, old = written(verified(found, texts, similarity).unionByName(known), "links"), roots
        roots = components(links, "id", "hub")
        discard(found, links, old)
        if last:
            discard(members, texts)
            return roots
        old, members, turn = members, written(_open(members, roots), "members"), turn + 1
        discard(old)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs whose sets of shingles reach the similarity; ``texts`` has one row (id, line) for each line."""
    shingles = lambda line: F.array_distinct(_hashes(_shingles(F.col(line))))
    both = pairs.join(texts.select("id", F.col("line").alias("a")), "id")
    # The shingles of a hub are made once, where its pairs meet.
    hubs = texts.withColumnRenamed("id", "hub").join(pairs.select("hub").distinct().hint("shuffle_hash"), "hub", "left_semi")
    both = both.join(evaluated(hubs, y=shingles("line")).select("hub", "y").hint("merge"), "hub")
    rows = evaluated(both, x=shingles("a")).select("id", "hub", "x", "y")
    rows = rows.filter(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
    shared = evaluated(rows, shared=F.size(F.array_intersect("x", "y")))
    return shared.filter(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("id", "hub")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(row, places): lines to remove from every row: all but the first, by (key, row, place), of every component."""
    # The smaller sides of joins with lines and texts are hashed, so that those need no sort.
    roots = linked(lines(docs, key, text), similarity)
    # A line counts where it stands first; null keys come last.
    at = F.struct(F.col("key").isNull().alias("n"), "key", "row", "place")
    ids = F.xxhash64("line").alias("id")
    n = lines(docs, key, text).select(ids).groupBy("id").agg(F.count("*").alias("n"))
    again = n.join(roots.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"))
    at = F.struct(F.col("key").isNull().alias("n"), "key", "row", "place")
    places = lines(docs, key, text).select(ids, "row", "place", at.alias("at"))
    rows = written(places.join(again.hint("shuffle_hash"), "id").select("root", "row", "place", "at"), "repeated")
    first = rows.groupBy("root").agg(F.min("at").alias("first"))
    gone = rows.join(first.hint("shuffle_hash"), "root").filter(F.col("at") != F.col("first"))
    return gone.groupBy("row").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of the text, and n_lines and n_removed.

    Lines end at \\n; lines without a word always stay. Of similar or equal lines, in
    one text or many, the first by key and place stays. A null text stays null. Rows
    with equal key and text count as one, so they stay alike; a null key comes last.
    An empty table gives an empty result. Columns of the input named like the results
    are replaced.
    """
    rows = docs.drop("n_lines", "n_removed", "__row", "__places", "__kept", "__lines")
    gone = removals(docs, key, text, similarity).withColumnRenamed("row", "__row").withColumnRenamed("places", "__places")
    rows = rows.withColumn("__row", F.xxhash64(key, F.coalesce(text, F.lit(""))))
    rows = rows.join(gone.hint("shuffle_hash"), "__row", "left")
    rows = evaluated(rows, __lines=F.split(text, "\n", -1))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(every, F.col("__places")), lambda i: F.get("__lines", i))
    left = F.when(F.col("__places").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size("__places"), F.lit(0)).cast("bigint")
    n_lines = F.coalesce(F.size(F.filter("__lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("bigint")
    rows = evaluated(rows, __kept=left, n_lines=n_lines, n_removed=n_removed)
    return rows.withColumn(text, F.col("__kept")).drop("__row", "__places", "__kept", "__lines")
