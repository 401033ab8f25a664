"""Similarity joins of word sets over a whole corpus, without comparing all pairs.

Words are put in order of rarity. Two sets that are similar enough share a word among
the rarest of each, their prefixes, so an inverted index of the prefixes meets all
similar sets, and common words are in no prefix unless a set has hardly any other. A word
of more than ``RARE`` sets joins none by itself: sets that share no rarer one share two
such words, and meet on the first two. What the sets of a list have after the words that
they meet on is compared in the task that has the list, by numpy: a bitmap of the words
tells most pairs apart, the others are counted. Each set asks for the earliest one only
and leaves a list with its first answer, so no pairs are written or moved, and many copies
are as quick as few. Lists beyond ``CROWD`` are cut into shards that meet by two. Pairs so
small that any shared word makes them similar never meet one by one: the index keeps what
is asked of them by word and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.session import kept

# Sets that may share a word for it to join them by itself.
RARE = 6000
# Sets of a list, or of two shards of a longer one, that a task compares.
CROWD = 20_000
# Rows that a task compares at once, their bytes, and pairs of a long list that it holds.
GATHERED, BYTES, HELD = 1 << 16, 1 << 26, 1 << 17
# Lists up to this are compared side by side; of longer ones only as many of the earliest sets.
SHORT, AHEAD = 48, 8


def by_rarity(sets: DataFrame, rare: int = RARE, crowd: int = CROWD) -> DataFrame:
    """(key, first, n, words, ids, rare, calm): one row per set, its words from the rarest in the corpus on.

    ``ids`` are numbers of the words in that order. The first ``rare`` of them stand in few
    sets, and the first ``calm`` in no more than a task compares.
    """
    listed = sets.select("key", "first", F.explode("words").alias("word"))
    # One row per word, written, so that its number is the same wherever it is read.
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    counts = kept(counts.orderBy("count", "word").withColumn("id", F.monotonically_increasing_id()), "words")
    rows = listed.join(counts, "word").groupBy("key").agg(
        F.any_value("first").alias("first"), F.count(F.lit(1)).cast("int").alias("n"),
        F.sort_array(F.collect_list(F.struct("id", "word"))).alias("o"), F.sort_array(F.collect_list("id")).alias("ids"),
        F.count_if(F.col("count") <= rare).cast("int").alias("rare"), F.count_if(F.col("count") <= crowd).cast("int").alias("calm"),
    )
    return rows.select("key", "first", "n", F.transform("o", lambda w: w["word"]).alias("words"), "ids", "rare", "calm")


def _ceil(product: Column, by: int) -> Column:
    return F.floor((product + (by - 1)) / by)


def _least(num: int, den: int) -> Column:
    """Words that a set shares at least with one that is similar to it, if it has to share two."""
    return F.greatest(_ceil(F.col("n") * num, den), F.lit(2)).cast("int")


def prefixes(ordered: DataFrame, num: int, den: int, of: str = "words") -> DataFrame:
    """(key, first, n, ids, rare, place, word) of the prefixes that serve pairs which have to share two words or more.

    ``word`` is one of the words, or its number where they are taken ``of`` the ids.
    """
    length = F.greatest(F.col("n") - _least(num, den) + 1, F.lit(0)).cast("int")
    return ordered.select("key", "first", "n", "ids", "rare", F.posexplode(F.slice(of, F.lit(1), length)).alias("place", "word"))


def common_pairs(ordered: DataFrame, num: int, den: int) -> DataFrame:
    """(key, first, n, rest, calm, one, two): pairs of common words that may be the first two that similar sets share.

    Sets that share a rarer word meet on it, so here all that they share is common, and
    sets with too few of such words are left out. ``rest`` has the words after the two;
    where ``calm``, one of the two is in no more sets than a task compares.
    """
    last = F.col("n") - _least(num, den) + 1
    ids = F.col("ids")
    pairs = F.transform(
        F.sequence(F.col("rare"), last - 1),
        lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(F.get(ids, i).alias("one"), F.get(ids, j).alias("two"), i.alias("i"), j.alias("j"))),
    )
    rows = ordered.filter((F.col("n") - F.col("rare") >= _least(num, den)) & (F.col("rare") < last))
    found = rows.select("key", "first", "n", "ids", "calm", F.explode(F.flatten(pairs)).alias("p"))
    rest = F.slice("ids", F.col("p.j") + 2, F.col("n"))
    return found.select("key", "first", "n", rest.alias("rest"), (F.col("p.i") < F.col("calm")).alias("calm"), "p.one", "p.two")


def sharded(pairs: DataFrame, crowd: int) -> DataFrame:
    """(key, first, n, rest, one, two, block, side): the rows of longer lists once for every shard that theirs has to meet.

    Two shards meet in a block, where ``side`` tells them apart. It is -1 where all rows meet.
    """
    longer = pairs.filter(~F.col("calm")).groupBy("one", "two").agg(F.ceil(F.count(F.lit(1)) / F.lit(crowd / 2)).cast("int").alias("shards"))
    longer = kept(longer.filter(F.col("shards") > 2), "long-lists")
    names = ["key", "first", "n", "rest", "one", "two"]
    if longer.isEmpty():
        return pairs.select(*names, F.lit(0).alias("block"), F.lit(-1).alias("side"))
    shards = F.coalesce("shards", F.lit(1))
    rows = pairs.join(longer, ["one", "two"], "left").select(*names, shards.alias("shards"))
    own = F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    block = F.least("own", "other") * F.col("shards") + F.greatest("own", "other")
    return met.select(*names, block.alias("block"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))


class _Lists:
    """Sets in lists, one after another; those of a list from the earliest on."""

    def __init__(self, new: np.ndarray, side: np.ndarray, n: np.ndarray, rest: pa.ListArray, before: int, num: int, den: int) -> None:
        """``new``: whether a row begins a list; ``rest``: words of a set beyond the ``before`` that all of its list share."""
        offsets = rest.offsets.to_numpy().astype(np.int64)
        self.values = rest.values.to_numpy()[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.side, self.n, self.before, self.num, self.den = side, n.astype(np.int64), before, num, den
        self.sizes = np.diff(self.offsets)
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, len(new)))
        self.start = np.repeat(self.starts, self.lengths)
        self.place = np.arange(len(new)) - self.start
        self.best = np.full(len(new), -1)
        self.marks = self._marks()
        # No two sets share more words than they share bits and have words beyond their bits; half of both is more than the least.
        slack = self.sizes - np.bitwise_count(self.marks).sum(axis=0, dtype=np.int64)
        # Rounding may let a pair pass, not leave one out.
        self.wants = (self.n * (num / (num + den) - 1e-6) - (before + slack) / 2 - 0.01).astype(np.float32)
        self.names: tuple[np.ndarray, int] | None = None

    def _marks(self) -> np.ndarray:
        """A bitmap of 128 bits for the words of each row."""
        hashes = (self.values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        bits = np.uint64(1) << (hashes & np.uint64(63))
        high = hashes > np.uint64(63)
        marks = np.zeros((2, len(self.sizes)), np.uint64)
        some = self.sizes > 0
        if some.any():
            at = self.offsets[:-1][some]
            for i, bits_of in enumerate((np.where(high, np.uint64(0), bits), np.where(high, bits, np.uint64(0)))):
                marks[i, some] = np.bitwise_or.reduceat(bits_of, at)
        return marks

    def _named(self) -> tuple[np.ndarray, int]:
        """Small numbers of the words of all rows, and how many there may be."""
        if self.names is None:
            low = self.values & ((1 << 33) - 1)
            by = int(low.max(initial=0)) + 1
            names, most = (self.values >> 33) * by + low, (int(self.values.max(initial=0) >> 33) + 1) * by
            if most > 1 << 36:
                found, names = np.unique(self.values, return_inverse=True)
                most = len(found) + 1
            self.names = names, most
        return self.names

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets of rows ``a`` are similar to those of ``b``: their words counted."""
        names, most = self._named()
        codes = []
        for rows in (a, b):
            sizes = self.sizes[rows]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - (ends - sizes), sizes)
            codes.append(np.repeat(np.arange(len(rows)), sizes) * most + names[at])
        both = np.concatenate(codes)
        both.sort()
        twice = both[1:][both[1:] == both[:-1]] // most
        shared = np.bincount(twice, minlength=len(a)) + self.before
        return shared * (self.num + self.den) >= (self.n[a] + self.n[b]) * self.num

    def _found(self, later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Which of these pairs may meet and are similar."""
        found = (self.side[later] == -1) | (self.side[later] != self.side[earlier])
        at = np.flatnonzero(found)
        for some in np.array_split(at, len(at) // HELD + 1):
            if len(some):
                found[some] = self.similar(later[some], earlier[some])
        return found

    def side_by_side(self) -> None:
        """Every set against the first of its list, the second, and so on; all of them in short lists."""
        most = np.repeat(np.where(self.lengths > SHORT, AHEAD, SHORT), self.lengths)
        rows = np.flatnonzero(self.place > 0)
        turn = 0
        while len(rows):
            earlier = self.start[rows] + turn
            bits = np.bitwise_count(self.marks[0][rows] & self.marks[0][earlier]) + np.bitwise_count(self.marks[1][rows] & self.marks[1][earlier])
            at = np.flatnonzero(bits >= self.wants[rows] + self.wants[earlier])
            at = at[self._found(rows[at], earlier[at])]
            self.best[rows[at]] = earlier[at]
            turn += 1
            rows = rows[(self.best[rows] < 0) & (self.place[rows] > turn) & (most[rows] > turn)]

    def long_list(self, start: int, length: int) -> None:
        """The sets of a list that are not answered yet against the others, block by block."""
        rows = start + AHEAD + 1 + np.flatnonzero(self.best[start + AHEAD + 1:start + length] < 0)
        at = start + AHEAD
        while len(rows):
            end = min(at + max(HELD // len(rows), 16), start + length)
            marks = [np.bitwise_count(m[rows][:, None] & m[at:end][None, :]) for m in self.marks]
            i, j = np.nonzero(marks[0] + marks[1] >= self.wants[rows][:, None] + self.wants[at:end][None, :])
            later, earlier = rows[i], at + j
            real = earlier < later
            later, earlier = later[real], earlier[real]
            found = self._found(later, earlier)
            # The pairs of a set stand from its earliest on.
            which, first = np.unique(later[found], return_index=True)
            self.best[which] = earlier[found][first]
            at = end
            rows = rows[(self.best[rows] < 0) & (rows > at)]

    def earliest(self) -> np.ndarray:
        """The row of the earliest similar set of its list before it, for every row; -1 for none."""
        self.side_by_side()
        for start, length in zip(self.starts, self.lengths):
            if length > SHORT:
                self.long_list(int(start), int(length))
        return self.best


def _earliest_in(on: int, before: int, num: int, den: int):
    """An Arrow function from rows (the ``on`` columns of a list, key, first, n, rest, side), ordered, to (key, earliest)."""
    def answered(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        key, first, n, rest, side = (c.combine_chunks() for c in rows.columns[on:])
        key, first = key.to_numpy(), first.to_numpy()
        best = _Lists(new, side.to_numpy(), n.to_numpy(), rest, before, num, den).earliest()
        found = np.flatnonzero(best >= 0)
        return pa.RecordBatch.from_arrays([pa.array(key[found], pa.int64()), pa.array(first[best[found]], pa.int64())], names=["key", "earliest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size, enough, full = [], 0, 0, GATHERED, BYTES
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            size += batch.nbytes
            if count < enough and size < full:
                continue
            rows = pa.Table.from_batches(held)
            new = _new_lists(rows, on)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield answered(rows.slice(0, last), new[:last])
                rows = rows.slice(last)
            # What is left of a list waits for the rest of it.
            held, count, size = rows.to_batches(), rows.num_rows, rows.nbytes
            enough, full = 2 * count + GATHERED, 2 * size + BYTES
        if count:
            rows = pa.Table.from_batches(held)
            yield answered(rows, _new_lists(rows, on))

    return run


def _new_lists(rows: pa.Table, on: int) -> np.ndarray:
    """Whether each row begins a list."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for column in rows.columns[:on]:
        values = column.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def earlier_pairs(ordered: DataFrame, num: int, den: int, crowd: int = CROWD) -> DataFrame:
    """(key, earliest): sets and the first of those before them that are similar, of pairs that share two words or more.

    ``key`` and ``first`` are numbers. A set may come more than once, for each list that it is in.
    """
    def met(rows: DataFrame, on: list[str], before: int) -> DataFrame:
        """Sets that meet on ``on``, having ``before`` words in common."""
        rest = ["key", "first", "n", "rest", "side"]
        numbers = [F.col(c).cast("bigint").alias(c) if c in ("key", "first") else F.col(c) for c in rest]
        dealt = rows.select(*on, *numbers).repartition(*on).sortWithinPartitions(*on, "first")
        return dealt.mapInArrow(_earliest_in(len(on), before, num, den), "key bigint, earliest bigint")

    few = prefixes(ordered, num, den, "ids").filter(F.col("place") < F.col("rare"))
    few = few.select("key", "first", "n", F.slice("ids", F.col("place") + 2, F.col("n")).alias("rest"), "word", F.lit(-1).alias("side"))
    common = sharded(common_pairs(ordered, num, den), crowd)
    return met(few, ["word"], 1).unionByName(met(common, ["one", "two", "block"], 2))


def earliest_similar(sets: DataFrame, num: int = 1, den: int = 4, rare: int = RARE, crowd: int = CROWD) -> DataFrame:
    """(key, earliest): the least ``first`` of the sets whose Jaccard similarity to a set reaches num / den, itself included.

    ``sets`` has (key, words, first): distinct sets of distinct words and anything that
    orders. An empty set is similar to none. Exact.
    """
    sets = kept(sets.select("key", "words", "first"), "sets")
    # Sets go by a number that follows their order.
    sets = kept(sets.orderBy("first", "key").withColumn("number", F.monotonically_increasing_id()), "numbered-sets")
    number = F.col("number")
    ordered = by_rarity(sets.select(number.alias("key"), "words", number.alias("first")), rare, crowd)
    ordered = kept(ordered.drop("words"), "ordered-sets")
    # Sizes that add up to this at most make one shared word enough.
    one = (num + den) // num
    small = ordered.filter(F.col("n") < one).select("key", "n", "first", F.explode("ids").alias("word"))
    index = small.groupBy("word", F.col("n").alias("size")).agg(F.min("first").alias("earliest"))
    asked = small.select("key", "word", F.explode(F.sequence(F.lit(1), F.lit(one) - F.col("n"))).alias("size"))
    found = asked.join(index, ["word", "size"]).select("key", "earliest")
    found = found.unionByName(earlier_pairs(ordered, num, den, crowd))
    found = found.unionByName(sets.select(number.alias("key"), number.alias("earliest")))
    best = found.groupBy(F.col("key").alias("number")).agg(F.min("earliest").alias("best"))
    firsts = sets.select(number.alias("best"), F.col("first").alias("earliest"))
    return best.join(firsts, "best").join(sets.select("number", "key"), "number").select("key", "earliest")
