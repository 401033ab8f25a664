"""Exact Jaccard join of documents on word n-grams by T-occurrence search (DivideSkip).

Two sets that reach the similarity share at least T elements. A query takes the
inverted lists of its elements, sets the longest L of them aside, merges the short
ones, keeps the sets that occur T - L times there, and looks those up in the long
lists by binary search.

To spread the search, sets are first dealt into blocks that lose no link. Sets of
size s and t that reach the similarity differ in at most k elements; cut by hash
into k + m parts, they agree in m parts at least. So every set is filed under the
content of its parts but for empty ones, which say nothing: a set with e empty parts
shares m - e keys at least with any similar one. If m or more are empty, it is filed
under the elements of its prefix too, the least hashes of which similar sets share one.

Sets that share fewer keys than they need are not similar, and most that share a key
share few: a part may hold one common element only. Sets under a key of few sets are
met pair by pair and their common keys counted. Keys of many sets would make too many
pairs: a set with fewer of those than it needs leaves them, as it shares one of the
others with any similar set; those that stay are joined to a star. The components of
what is left are the blocks: similar sets are always in one block, and a set moves to
its block once. A block larger than a task should hold is cut into shards, and every
pair of shards is searched by a task of its own. Tasks return only links that join
what was not joined before, so a group of n copies gives about n links, not n * n.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import discard, written
from ledgerloom.llm.components import components

# Sets in a shard of a block.
SHARD = 2048
# Postings beyond which short lists are merged by one sort instead of a heap.
HEAP = 4096
# Weight of the length of lists in the choice of how many are long (DivideSkip's mu).
MU = 0.0085
# One part more than needed for so many elements that may differ: that many keys similar sets share.
SPARE = 8
# Sets under a key that are met pair by pair.
FEW = 8
# Sets that a task remembers, to file equal ones once.
SEEN = 1 << 19

_words = regex.compile(r"[^\x20\x09-\x0D]+").findall
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Odd factors that tell the places of an n-gram apart.
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


class Shingler:
    """Texts to sorted arrays of distinct n-gram hashes (64 bits)."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _words((text or "").translate(_lower))
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > 1 << 19:
            self.known.clear()
        known = self.known
        hashes = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh3_64_intdigest(word)
            hashes[i] = h
        n = min(self.n, len(words))
        grams = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            grams = _mix(grams + hashes[i : len(hashes) - n + 1 + i] * np.uint64(_FACTORS[i % len(_FACTORS)]))
        return np.unique(grams)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def intervals(most: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(greatest size, parts, parts that similar sets agree in) of size intervals; similar sets lie in one or in neighbours."""
    found, low = [], 1
    while low <= most:
        high = low * den // num
        # |s| + |t| <= 2 * high, and s, t differ in at most (1 - j) / (1 + j) of that.
        differ = (den - num) * 2 * high // (den + num)
        agree = 2 + differ // SPARE if differ else 1
        found.append((high, differ + agree, agree))
        low = high + 1
    return found


class Filer:
    """Keys of a set: one for each part that is not empty, in its size interval and in the next one; its prefix if many are empty.

    The lowest bit of a key is that of its interval's number.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.table = num, den, intervals(1 << 16, num, den)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, int, list[int]]:
        """(keys, first interval, how many keys of the first and of the second similar sets share)."""
        size = len(grams)
        while self.table[-2][0] < size:
            self.table = intervals(self.table[-1][0] * 2, self.num, self.den)
        i = int(np.searchsorted([high for high, *_ in self.table], size))
        keys, needs = [], []
        for k in (i, i + 1):
            _, parts, agree = self.table[k]
            place = (grams >> np.uint64(17)) % np.uint64(parts)
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
            filled = place[order][starts]
            sums = _mix(np.add.reduceat(_mix(grams[order]), starts))
            salt = np.uint64((k * _FACTORS[1]) % (1 << 64))
            found = [_mix(sums + filled * np.uint64(_FACTORS[0]) + salt)]
            empty = parts - len(filled)
            if empty >= agree:
                # Similar sets share at least this many elements, so one of the others' least at the latest.
                shared = -(-self.num * size // self.den)
                found.append(_mix(_mix(np.sort(grams)[: size - shared + 1]) + salt))
            keys += [x & ~np.uint64(1) | np.uint64(k & 1) for x in found]
            needs.append(max(agree - empty, 1))
        return np.concatenate(keys), i, needs


class Joined:
    """Union-find over 0..n-1 with labels in one array, so that many members can be compared at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def union(self, a: int, b: int) -> bool:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.label[moved] = x
        self.members[x] += moved
        return True


def search(index: list[np.ndarray], queries: list[np.ndarray], offset: int, joined: Joined, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links (query, offset + indexed set) that join two components, by DivideSkip.

    Members of ``joined`` are the queries first; with ``offset`` 0 queries and index are the same sets.
    """
    n = max(len(index), 1)
    sizes = np.array([len(s) for s in index], np.int64)
    tokens = np.concatenate([*index, np.empty(0, np.uint64)])
    owners = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    # Places of all lists one after the other: list number * n + owner is sorted.
    numbers = np.cumsum(np.r_[0, np.diff(tokens) != 0][: len(tokens)]) if len(tokens) else np.empty(0, np.int64)
    places = numbers * n + owners
    for q, grams in enumerate(queries):
        if not len(grams):
            continue
        begin, end = np.searchsorted(tokens, grams, "left"), np.searchsorted(tokens, grams, "right")
        lengths = end - begin
        # The least overlap with any set that is large enough.
        least = -(-num * len(grams) // den)
        n_long = min(least - 1, int(least / (MU * np.log2(max(int(lengths.max()), 2)) + 1)))
        by_length = np.argsort(lengths, kind="stable")
        cut = len(grams) - n_long
        lists = [owners[begin[i] : end[i]] for i in by_length[:cut] if lengths[i]]
        if not lists:
            continue
        candidates, counts = _merged(lists, least - n_long)
        size = sizes[candidates]
        keep = (den * np.minimum(size, len(grams)) >= num * np.maximum(size, len(grams))) & (joined.label[candidates + offset] != joined.label[q])
        if not offset:
            keep &= candidates > q
        long = by_length[cut:][lengths[by_length[cut:]] > 0]
        starts = numbers[begin[long]] * n
        for c, count in zip(candidates[keep].tolist(), counts[keep].tolist()):
            if joined.label[c + offset] == joined.label[q]:
                continue
            # One binary probe in each long list.
            at = np.minimum(np.searchsorted(places, starts + c), len(places) - 1)
            shared = count + int(np.count_nonzero(places[at] == starts + c))
            if den * shared >= num * (len(grams) + int(sizes[c]) - shared):
                joined.union(q, c + offset)
                yield q, c + offset


def _merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists that occur ``least`` times, with their counts."""
    total = sum(map(len, lists))
    if total > HEAP:
        found, counts = np.unique(np.concatenate(lists), return_counts=True)
        keep = counts >= least
        return found[keep], counts[keep]
    found, counts = [], []
    heads = [(int(x[0]), i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heads)
    while heads:
        member, n = heads[0][0], 0
        while heads and heads[0][0] == member:
            _, i, at = heads[0]
            n += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heads, (int(lists[i][at + 1]), i, at + 1))
            else:
                heapq.heappop(heads)
        if n >= least:
            found.append(member)
            counts.append(n)
    return np.array(found, np.int64), np.array(counts, np.int64)


def _file(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, n_shingles, digest, set, keys, interval, needs): the set's size, digest and number, its keys, and what ``Filer`` says of them.

    A task files equal sets once.
    """
    def run(batches):
        shingle, file, seen = Shingler(n), Filer(num, den), set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, digests, numbers, keys, firsts, needs = [], [], [], [], [], []
            for key, text in zip(ids, batch.column(1).to_pylist()):
                grams = shingle(text)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                own, first, need = None, None, None
                if key is not None and len(grams) and digest not in seen:
                    own, first, need = file(grams)
                    own = own.view(np.int64)
                    if len(seen) < SEEN:
                        seen.add(digest)
                sizes.append(len(grams))
                digests.append(digest)
                numbers.append(int.from_bytes(digest[:8], "little", signed=True))
                keys.append(own)
                firsts.append(first)
                needs.append(need)
            arrays = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(firsts, pa.int32()), pa.array(needs, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "digest", "set", "keys", "interval", "needs"])

    schema = "id bigint, n_shingles bigint, digest binary, set bigint, keys array<bigint>, interval int, needs array<int>"
    return docs.select("id", "text").mapInArrow(run, schema)


def near_sets(filed: DataFrame, few: int) -> DataFrame:
    """(a, b) pairs of sets' numbers whose components hold all similar sets."""
    keyed = filed.select("set", F.explode("keys").alias("key"))
    around = Window.partitionBy("key")
    shared = keyed.select("key", "set", F.min("set").over(around).alias("low"), F.max("set").over(around).alias("high")).filter("low <> high")
    info = filed.filter("keys is not null").groupBy("set").agg(F.any_value("interval").alias("interval"), F.any_value("needs").alias("needs"))
    shared = shared.select("key", "set").distinct().join(info, "set")
    second = F.col("key").bitwiseAND(1) != F.col("interval").bitwiseAND(1)
    k = F.when(second, F.col("interval") + 1).otherwise(F.col("interval"))
    need = F.when(second, F.get("needs", F.lit(1))).otherwise(F.get("needs", F.lit(0)))
    shared = written(shared.select("key", "set", k.alias("k"), need.alias("need")), "shared")
    sizes = shared.groupBy("key").agg(F.count("*").alias("members"))
    met = shared.join(sizes, "key")
    large = met.filter(F.col("members") > few).groupBy("set", "k").agg(F.count("*").alias("large"))
    met = met.join(large, ["set", "k"], "left").fillna({"large": 0}).withColumn("stays", F.col("large") >= F.col("need"))
    met = written(met, "met")
    # Keys of many sets: a star of those that need them.
    wide = met.filter((F.col("members") > few) & F.col("stays"))
    stars = wide.join(wide.groupBy("key").agg(F.min("set").alias("hub")), "key").filter("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    # Keys of few sets: pairs, and how many keys they share.
    rows = met.filter(F.col("members") <= few)
    pairs = rows.alias("l").join(rows.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.set") < F.col("r.set")))
    both = F.col("l.stays") & F.col("r.stays")
    # Keys of many sets that two sets may share, though no star joins them.
    unseen = F.when(both, F.lit(0)).otherwise(F.least("l.large", "r.large"))
    needed = F.greatest("l.need", "r.need") - unseen
    counted = pairs.groupBy(F.col("l.set").alias("a"), F.col("r.set").alias("b"), F.col("l.k").alias("k")).agg(F.count("*").alias("n"), F.max(needed).alias("needed"))
    found = written(stars.unionByName(counted.filter(F.col("n") >= F.col("needed")).select("a", "b")).distinct(), "near")
    discard(shared, met)
    return found


def _links(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) links found in (block, i, j, side, id, text) rows, a pair of shards after the other."""
    def pair(rows: list[tuple], shingle: Shingler, same: bool) -> Iterator[tuple[int, int]]:
        left = [(i, shingle(t)) for side, i, t in rows if side == 0]
        right = [(i, shingle(t)) for side, i, t in rows if side == 1]
        if same:
            joined, index, offset = Joined(len(left)), left, 0
        else:
            joined, index, offset = Joined(len(left) + len(right)), right, len(left)
        names = [i for i, _ in left + right]
        for a, b in search([s for _, s in index], [s for _, s in left], offset, joined, num, den):
            yield names[a], names[b]

    def run(batches):
        shingle, held, at = Shingler(n), [], None
        found: list[tuple[int, int]] = []
        for batch in batches:
            for block, i, j, side, key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if at != (block, i, j):
                    if len(held) > 1:
                        found += pair(held, shingle, at[1] == at[2])
                    held, at = [], (block, i, j)
                held.append((side, key, text))
            if found:
                yield _edge_batch(found)
                found = []
        if len(held) > 1:
            found += pair(held, shingle, at[1] == at[2])
        if found:
            yield _edge_batch(found)

    dealt = members.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "id")
    return dealt.select("block", "i", "j", "side", "id", "text").mapInArrow(run, "a bigint, b bigint")


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, similarity: tuple[int, int] = (90, 100), shard: int = SHARD, few: int = FEW) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that links of ``similarity`` lead to.

    A null or empty text has an empty set and is linked with nothing; a text of fewer
    than ``n`` words is one shingle. Rows that share a key are one document as far as
    components go, each with its own n_shingles. A null key gets a null component.
    An empty table gives an empty result; other columns are left out.
    """
    num, den = similarity
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    filed = written(_file(rows, n, num, den), "filed")
    # Equal sets: one stands for all.
    first = filed.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = filed.join(first, "digest").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    same = written(same, "same")
    near = near_sets(filed, few)
    names = filed.filter("keys is not null").groupBy("set").agg(F.min("id").alias("id"))
    edges = near.join(names.select(F.col("set").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("set").alias("b"), F.col("id").alias("y")), "b")
    stored = components(edges, "x", "y")
    discard(near)
    blocks = stored.withColumnRenamed("node", "id").withColumnRenamed("root", "block")
    shards = blocks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("shards"))
    placed = blocks.join(shards, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    seats = F.transform(every, lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), (F.col("own") > other).cast("int").alias("side")))
    placed = placed.select("id", "block", F.explode(seats).alias("s")).select("id", "block", "s.*")
    # One plan at every size: how many sets have a block grows with the input.
    members = rows.filter("id is not null").join(placed.hint("merge"), "id")
    links = written(_links(members, n, num, den), "links")
    roots = components(links.unionByName(same))
    discard(links, same, stored)
    joined = filed.select("id", "n_shingles").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return joined.select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "id").alias("component_id"))

