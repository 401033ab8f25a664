"""Removal of repeated strings by a logarithmic family of suffix arrays.

Suffixes are cut at the match length, as only equality of that many bytes counts,
and an array keeps them in the order of a 128-bit key of those bytes: equal suffixes
stand side by side in it as they would in byte order, and a place costs 16 bytes
instead of the string.

Spark spreads the suffixes: every window of the match length is filed under its
least short substring (a minimizer), so equal windows always meet in one task. The
windows of a text that share a minimizer are neighbours and travel as one stretch of
bytes. A task gets the stretches of its share batch by batch, in the order of
documents. A new batch is sorted into a suffix array, merge-scanned against every
level of the index, and becomes a level itself; levels of about equal size merge, so
there are logarithmically many and a suffix is moved logarithmically often. The
index keeps one place for all copies of a window.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

MATCH = 50
# Length of the substrings among which the least is taken.
SEED = 8
# Bytes of text for each share of the suffixes, and documents in a batch.
SHARE = 3 << 20
# Texts are cut into stretches in groups of about so many bytes; stretches leave a task when so many bytes are held.
GROUP = 1 << 20
HELD = 48 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
STIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * factor
    return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = pick(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Rolling:
    """Keys of any stretches of ``data``: two polynomial hashes, by prefix sums modulo 2**64."""

    TABLES = [_mix(np.arange(256, dtype=np.uint64) * SPREAD + np.uint64(salt), STIR) for salt in (1, 2)]
    BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not self.powers or len(self.powers[0][0]) <= n:
            size = np.full(max(2 * n, 1 << 16), 0, np.uint64)
            made = []
            for base in self.BASES:
                both = []
                for factor in (base, pow(base, -1, 1 << 64)):
                    size[:] = np.uint64(factor)
                    size[0] = 1
                    both.append(np.cumprod(size))
                made.append(tuple(both))
            Rolling.powers = made
        self.sums = [np.r_[np.uint64(0), np.cumsum(table[data] * power[:n])] for table, (power, _) in zip(self.TABLES, self.powers)]

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [(sums[ends] - sums[starts]) * inverse[starts] for sums, (_, inverse) in zip(self.sums, self.powers)]
        return _mix(a, SPREAD), b


def stretches(data: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the minimizer) of all runs of windows with minimizers of one value."""
    width = match - SEED + 1
    seeds = _mix(_eights(data), SPREAD)
    least = _sliding(seeds, width, np.minimum)
    # Windows are filed by the value, so a run goes on where another place takes over with the same one.
    n = len(least)
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], n] - 1, least[first]


class Levels:
    """The index: sorted arrays of window keys, each at most half as large as the one before it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the sorted keys some level has."""
        found = np.zeros(len(a), bool)
        for x, y in self.levels:
            at = np.searchsorted(x, a)
            # Keys whose first halves agree stand side by side.
            for step in range(64):
                place = np.minimum(at + step, len(x) - 1)
                same = x[place] == a
                found |= same & (y[place] == b) & (at + step < len(x))
                if not (same & ~found & (at + step + 1 < len(x))).any():
                    break
            else:
                raise ValueError("too many keys agree in one half")
        return found

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(a):
            x, y = self.levels.pop()
            a, b = np.r_[x, a], np.r_[y, b]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
        self.levels.append((a, b))


def repeated(levels: Levels, data: np.ndarray, lengths: np.ndarray, docs: np.ndarray, match: int) -> np.ndarray:
    """Which windows of a batch of stretches also start in a smaller document; the batch joins the index.

    ``data`` holds the stretches one after the other, ``docs`` the number of the document of each.
    """
    ends = np.cumsum(lengths)
    windows = lengths.astype(np.int64) - match + 1
    before = np.cumsum(windows) - windows
    places = np.arange(int(windows.sum())) + np.repeat(ends - lengths - before, windows)
    a, b = Rolling(data).keys(places, places + match)
    owner = np.repeat(docs, windows)
    # The suffix array of the batch.
    order = np.argsort(a)
    a, b, owner = a[order], b[order], owner[order]
    head = np.r_[True, a[1:] != a[:-1]]
    group = np.cumsum(head) - 1
    if (b != b[head][group]).any():
        # Different windows agree in one half of their keys.
        again = np.lexsort((b, a))
        order, a, b, owner = order[again], a[again], b[again], owner[again]
        head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(head) - 1
    smallest = np.minimum.reduceat(owner, np.flatnonzero(head))
    known = levels.holds(a[head], b[head])
    hit = known[group] | (owner > smallest[group])
    levels.add(a[head][~known], b[head][~known])
    out = np.empty(len(places), bool)
    out[order] = hit
    return out


def _pack(parts: list[np.ndarray]) -> bytes:
    # Documents follow each other, so their steps are small numbers.
    parts[0] = np.diff(parts[0], prepend=0)
    raw = b"".join([np.int64(len(p)).tobytes() + p.tobytes() for p in parts])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    out[0] = np.cumsum(out[0])
    return out


PACKED = (np.int64, np.int64, np.int32, np.int32, np.uint8)


def _file(docs: DataFrame, shares: int, batch_docs: int, match: int) -> DataFrame:
    """(share, batch, packed): stretches of all texts by the share of their minimizer.

    Rows with share -1 hold stretches that equal one of a smaller document of the
    same task: they are repeated whatever else there is, and need no search. A
    string that many documents have so leaves a task about once.
    """
    def cut(ids, rows, bases, texts):
        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(lengths)
        first, last, seed = stretches(data, match)
        # Windows that leave their text are cut off; stretches are divided at the ends of texts.
        doc = np.searchsorted(ends, first, "right")
        more = np.searchsorted(ends, last, "right")
        crossing = np.flatnonzero(more != doc)
        if len(crossing):
            extra_first, extra_last, extra_seed, extra_doc = [], [], [], []
            for c in crossing.tolist():
                for d in range(doc[c] + 1, more[c] + 1):
                    extra_first.append(ends[d - 1])
                    extra_last.append(min(last[c], ends[d] - 1))
                    extra_seed.append(seed[c])
                    extra_doc.append(d)
            last[crossing] = ends[doc[crossing]] - 1
            first, last = np.r_[first, np.array(extra_first, first.dtype)], np.r_[last, np.array(extra_last, last.dtype)]
            seed, doc = np.r_[seed, np.array(extra_seed, seed.dtype)], np.r_[doc, np.array(extra_doc, doc.dtype)]
        last = np.minimum(last, ends[doc] - match)
        keep = last >= first
        first, last, seed, doc = first[keep], last[keep], seed[keep], doc[keep]
        size = last - first + match
        key, row, at = ids[doc], rows[doc], (first - np.r_[0, ends][doc] + bases[doc]).astype(np.int32)
        # Equal stretches in one group: all but those of the smallest document are settled.
        x, y = Rolling(data).keys(first, last + match)
        x = x ^ _mix(size.astype(np.uint64), STIR)
        order = np.lexsort((key, y, x))
        same = np.r_[False, (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        settled = np.zeros(len(order), bool)
        settled[order] = key[order] > key[order][head]
        share = (_mix(seed, STIR) % np.uint64(shares)).astype(np.int64)
        share[settled] = -1
        batch = key // batch_docs
        batch[settled] = 0
        order = np.lexsort((batch, share))
        bounds = np.flatnonzero(np.r_[True, (np.diff(share[order]) != 0) | (np.diff(batch[order]) != 0)])
        for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
            own = order[lo:hi]
            n = size[own].astype(np.int32)
            payload = np.empty(0, np.uint8)
            if share[own[0]] >= 0:
                payload = data[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            yield (int(share[own[0]]), int(batch[own[0]])), (key[own], row[own], at[own], n, payload)

    def run(batches):
        ids, rows, bases, texts, size = [], [], [], [], 0
        parts: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        held = 0

        def take():
            nonlocal held, ids, rows, bases, texts, size
            for where, found in cut(np.array(ids, np.int64), np.array(rows, np.int64), np.array(bases, np.int64), texts):
                parts[where].append(found)
                held += found[4].nbytes
            ids, rows, bases, texts, size = [], [], [], [], 0

        def leave():
            nonlocal held
            # Stretches go as their packed form comes.
            yield from _batches((*where, _pack([np.concatenate(x) for x in zip(*parts.pop(where))])) for where in list(parts))
            held = 0

        for batch in batches:
            for key, row, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                # Long texts in pieces that overlap so far that every window is in one of them.
                for base in range(0, len(text) - match + 1, GROUP):
                    ids.append(key)
                    rows.append(row)
                    bases.append(base)
                    texts.append(text[base : base + GROUP + match - 1])
                    size += len(texts[-1])
                    if size >= GROUP:
                        take()
                    if held >= HELD:
                        yield from leave()
        if texts:
            take()
        yield from leave()

    return docs.select("key", "row", "bytes").mapInArrow(run, "share bigint, batch bigint, packed binary")


def _batches(rows) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 64:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    share, batch, packed = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(share, pa.int64()), pa.array(batch, pa.int64()), pa.array(packed, pa.binary())], names=["share", "batch", "packed"])


def _spans(filed: DataFrame, match: int) -> DataFrame:
    """(key, row, begin, end): repeated stretches of bytes, some of them overlapping, from (share, batch, packed) in order."""
    def spans(parts, hits) -> pa.RecordBatch:
        key, row, at, lengths = parts
        windows = lengths - match + 1
        # Runs of repeated windows, not across stretches.
        edge = np.zeros(int(windows.sum()), bool)
        starts = np.r_[0, np.cumsum(windows)[:-1]]
        edge[starts] = True
        begins = np.flatnonzero(hits & (edge | ~np.r_[False, hits[:-1]]))
        ends = np.flatnonzero(hits & (np.r_[edge[1:], True] | ~np.r_[hits[1:], False]))
        owner = np.searchsorted(starts, begins, "right") - 1
        first = at[owner] + begins - starts[owner]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[owner]), pa.array(row[owner]), pa.array(first.astype(np.int64)), pa.array((first + ends - begins + match).astype(np.int64))],
            names=["key", "row", "begin", "end"],
        )

    def run(batches):
        levels, now, held = Levels(), None, []

        def settle():
            keys, rows, at, lengths, data = (np.concatenate(x) for x in zip(*held))
            return spans((keys, rows, at, lengths), repeated(levels, data, lengths, keys, match))

        for batch in batches:
            for share, number, packed in zip(*[c.to_pylist() for c in batch.columns]):
                if share < 0:
                    keys, rows, at, lengths, _ = _unpack(packed, PACKED)
                    yield spans((keys, rows, at, lengths), np.ones(int((lengths - match + 1).sum()), bool))
                    continue
                if now != (share, number):
                    if held:
                        yield settle()
                        held = []
                    if now is None or now[0] != share:
                        levels = Levels()
                    now = (share, number)
                held.append(_unpack(packed, PACKED))
        if held:
            yield settle()

    ordered = filed.repartition("share", F.when(F.col("share") < 0, F.xxhash64("packed"))).sortWithinPartitions("share", "batch")
    return ordered.mapInArrow(run, "key bigint, row bigint, begin bigint, end bigint")


def _compressed(rows: DataFrame) -> DataFrame:
    """(doc, key, row, packed): texts made small before they move."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([pack.compress(t) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["doc", "key", "row", "packed"])

    return rows.select("doc", "key", "row", "bytes").mapInArrow(run, "doc bigint, key bigint, row bigint, packed binary")


def _kept(rows: DataFrame, key: str, keep_text: bool) -> DataFrame:
    """Cut the spans out of the bytes and describe what is left."""
    def run(batches):
        for batch in batches:
            out = []
            for name, data, begins, ends in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data = zstandard.ZstdDecompressor().decompress(data)
                removed, n_spans, at, parts = 0, 0, 0, []
                for begin, end in sorted(zip(begins or [], ends or [])):
                    if begin > at or not n_spans:
                        n_spans += 1
                        parts.append(data[at:begin])
                        at = begin
                    if end > at:
                        removed += end - at
                        at = end
                parts.append(data[at:])
                kept = b"".join(parts)
                out.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = MATCH, batches: int = 8, keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): texts without strings that a smaller document has.

    Every byte covered by a string of ``match`` (16 or more) bytes that also starts in
    a document with a smaller key goes; strings are judged on the input. ``kept`` (the
    bytes left) is filled with ``keep_text``. Null counts as empty, a null key as larger
    than all others. Rows with equal keys are one document as far as "smaller" goes.
    An empty table gives an empty result; other columns are left out.
    """
    if match < 16:
        raise ValueError("strings of fewer than 16 bytes are not matched")
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), whole.alias("bytes"))
    rows = rows.withColumn("key", F.coalesce("doc", F.lit(2**62)))
    total, low, high = rows.agg(F.sum(F.octet_length("bytes")), F.min("doc"), F.max("doc")).first()
    shares = max(1, -(-(total or 0) // SHARE))
    batch_docs = max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    # A number that tells rows of one key apart, the same for equal texts; none is needed where keys differ.
    repeated_keys = not rows.groupBy("key").count().filter("count > 1").isEmpty()
    row = F.xxhash64(F.sha2("bytes", 256)) if repeated_keys else F.lit(0).cast("bigint")
    rows = rows.withColumn("key", F.col("key") - F.lit(low or 0)).withColumn("row", row)
    found = _spans(_file(rows, shares, batch_docs, match), match).groupBy("key", "row").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    joined = _compressed(rows).join(found, ["key", "row"], "left")
    return _kept(joined.select(F.col("doc").alias(key), "packed", F.col("s.begin").alias("b"), F.col("s.end").alias("e")), key, keep_text)
