"""Phrase collocations by prefix-free parsing: n-grams are counted in distinct chunks, weighted by their frequency.

Parsing. A text is a row of words with breaks at punctuation, and, as no frequent phrase
holds a rare word, at words that are rare in the whole corpus; a word alone between
breaks goes. Wherever the hash of two neighbouring words hits a trigger value, a chunk
begins; so equal passages fall into equal chunks wherever they stand. A chunk owns the n-grams that begin in it, before
the next trigger, and carries the few words after that which they reach into. Chunks
overlap by these words, and each n-gram still belongs to one chunk.

Counting. The distinct chunks form a dictionary with their frequency in the parse, and
n-grams are counted once for each entry, times its frequency. Most are rare, so pairs and
triples of words are first counted as short hashes, sorted and packed, and a bitmap of
fixed size keeps the hashes that reach the limit. Phrases are then counted as text only
where all their pairs and triples are in the bitmaps: no phrase is more frequent than a
part of it. A bitmap never denies a frequent phrase, so counts are exact, and if it fills
up only more is counted than need be.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import by_bytes, discard, written

LONGEST, LEAST, TOP = 5, 100, 2000
# A longer phrase hides a part of it when it has this share of the part's occurrences, in percent.
HIDES = 100
# One in so many pairs of words begins a chunk, and a chunk owns at most so many words and breaks.
TRIGGER, OWN = 16, 64
# Bits of the bitmap of frequent phrases; 1 MiB whatever the input.
BITS = 1 << 23
# Bits of a short hash; entries that a task gathers before it adds them up; words of the corpus for each part of
# the hashes, and the greatest number of parts.
SHORT, GATHERED, PART, PARTS = 40, 1 << 22, 1 << 20, 1 << 16
# Bytes of text that are parsed at once, words counted at once, words that a worker remembers, rows of a batch on its way out.
BYTES, WORDS, KNOWN, ROWS = 2 << 20, 1 << 19, 1 << 19, 1 << 16

BREAKS = r"[.,;:!?\n\x0b\x0c\r]+"


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _codes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code and row of every token between spaces, the token of every code)."""
    lists = pc.split_pattern(rows, " ")
    tokens = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    return tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, tokens.dictionary


def _is(tokens: pa.Array, token: str) -> np.ndarray:
    return pc.equal(tokens, token).to_numpy(zero_copy_only=False)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """(code and text of every word and break, the token of every code, the code of a break)."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    spaced = pc.replace_substring(pc.replace_substring_regex(lower, BREAKS, " \n "), "\t", " ")
    codes, row, tokens = _codes(spaced)
    keep = ~_is(tokens, "")[codes]
    tokens = pa.concat_arrays([tokens, pa.array(["\n"])])
    stop = len(tokens) - 1
    # One code for all breaks.
    code_of = np.where(_is(tokens, "\n"), stop, np.arange(stop + 1))
    return code_of[codes[keep]], row[keep], tokens, stop


def parse(texts: pa.Array, longest: int, hashes: Hashes, langs: list[str] | None = None, words: Marks | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, chunk, words that it owns): words with a space between them, and a line break between pieces.

    With ``words``, the bitmap of frequent words of ``langs``, the others are breaks too.
    """
    codes, row, tokens, stop = _tokens(texts)
    h = np.array([hashes[token] for token in tokens.to_pylist()], np.uint64)
    is_break = codes == stop
    if words is not None and len(codes):
        lang = np.array([hashes[name] for name in langs], np.uint64)
        is_break = is_break | ~words.has(_short(lang[row], [h[codes]]))
    # A word without a neighbour is in no phrase, and one break says as much as several.
    same = row[1:] == row[:-1]
    joined = ~is_break[1:] & ~is_break[:-1] & same
    is_break = ~(np.r_[False, joined] | np.r_[joined, False])[: len(codes)]
    keep = ~is_break | np.r_[False, ~is_break[:-1] & same][: len(codes)]
    codes, row, is_break = np.where(is_break, stop, codes)[keep], row[keep], is_break[keep]
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64)
    h = h[codes]
    begins = np.ones(n, bool)
    # A pair of tokens that hits the trigger ends a chunk; so does the end of a text.
    pairs = _mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(TRIGGER) == 0
    begins[1:] = np.r_[False, pairs[:-1]] | (row[1:] != row[:-1])
    starts = np.flatnonzero(begins)
    # Triggers are seldom far apart; where they are, a chunk ends after OWN places.
    times = -(-np.diff(np.r_[starts, n]) // OWN)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts = np.repeat(starts, times) + step * OWN
    ends = np.r_[starts[1:], n]
    # The words after a chunk that its n-grams reach into: up to the next break or the end of the text.
    stops = np.flatnonzero(np.r_[is_break, True] | np.r_[False, row[1:] != row[:-1], True])
    reach = np.minimum(ends + longest - 1, stops[np.searchsorted(stops, ends)])
    reach = np.where(is_break[ends - 1], ends, reach)
    count = np.r_[0, np.cumsum(~is_break)]
    owned = count[ends] - count[starts]
    some = owned > 0
    starts, reach, owned = starts[some], reach[some], owned[some]
    size = reach - starts
    offsets = np.r_[0, np.cumsum(size)]
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(pa.array(codes[places])))
    return row[starts], pc.binary_join(listed, " "), owned


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, phrase, f): every word with its occurrences."""
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES):
                codes, row, tokens, stop = _tokens(part.column(1))
                langs = part.column(0).dictionary_encode()
                lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                some = codes != stop
                ids, pairs = pd.factorize(lang[row[some]] << 32 | codes[some])
                if len(pairs):
                    arrays = [langs.dictionary.take(pa.array(pairs >> 32)), tokens.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(np.bincount(ids))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "f"])

    counts = _rows(docs, text, lang).mapInArrow(run, "lang string, phrase string, f bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def dictionary(docs: DataFrame, text: str, lang: str, longest: int, words: Marks) -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of frequent words with their frequency."""
    marks = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES):
                row, chunks, own = parse(part.column(1), longest, hashes, part.column(0).to_pylist(), marks.value)
                langs = part.column(0).take(pa.array(row))
                for lo in range(0, len(row), ROWS):
                    yield pa.RecordBatch.from_arrays([langs.slice(lo, ROWS), chunks.slice(lo, ROWS), pa.array(own[lo : lo + ROWS], pa.int32())], names=["lang", "chunk", "own"])

    chunks = _rows(docs, text, lang).mapInArrow(run, "lang string, chunk string, own int")
    return chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("n"))


class Marks:
    """A bitmap of fixed size in which every phrase has two bits, by its short hash."""

    def __init__(self, bits: DataFrame):
        """From (word, bits) rows; a fixed number of words comes to the driver."""
        table = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(BITS // 64, np.uint64)
        self.words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)

    @staticmethod
    def places(short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _mix(short * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS), _mix(short + np.uint64(1)) % np.uint64(BITS)

    @classmethod
    def batch(cls, short: np.ndarray) -> pa.RecordBatch:
        """(word, bits) of some hashes."""
        places = np.concatenate(cls.places(short))
        bits = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int32)), pa.array(bits)], names=["word", "bits"])

    def has(self, short: np.ndarray) -> np.ndarray:
        found = np.ones(len(short), bool)
        for place in self.places(short):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
        return found


def _short(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Short hashes of phrases from the hashes of their language and words, in order."""
    h = _mix(lang)
    for word in words:
        h = _mix(h + word)
    return h >> np.uint64(64 - SHORT)


def marked_words(words: DataFrame) -> Marks:
    """The bitmap of (lang, phrase) rows of single words."""
    def run(batches):
        hashes = Hashes()
        for batch in batches:
            lang, word = [np.array([hashes[x] for x in batch.column(i).to_pylist()], np.uint64) for i in range(2)]
            yield Marks.batch(_short(lang, [word]))

    return Marks(words.select("lang", "phrase").mapInArrow(run, "word int, bits bigint"))


class Grams:
    """The phrases that some distinct chunks own; ``marks`` has bitmaps of frequent phrases by their size."""

    def __init__(self, table: pa.Table, marks: dict[int, Marks], hashes: Hashes):
        self.marks = marks
        self.codes, self.chunk, self.tokens = _codes(table["chunk"].combine_chunks())
        self.langs = table["lang"].combine_chunks().dictionary_encode()
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.chunk]
        own, self.n = table["own"].to_numpy(), table["n"].to_numpy()
        is_word = ~_is(self.tokens, "\n")[self.codes]
        before = np.cumsum(is_word) - is_word
        starts = np.r_[0, np.flatnonzero(np.diff(self.chunk)) + 1]
        self.owned = is_word & (before - before[starts][self.chunk] < own[self.chunk])
        self.h = np.array([hashes[token] for token in self.tokens.to_pylist()], np.uint64)
        self.lang_h = np.array([hashes[name] for name in self.langs.dictionary.to_pylist()], np.uint64)
        self.fits = {1: is_word}

    def short(self, at: np.ndarray, size: int) -> np.ndarray:
        return _short(self.lang_h[self.lang[at]], [self.h[self.codes[at + k]] for k in range(size)])

    def stand(self, size: int) -> np.ndarray:
        """Where a phrase of ``size`` words stands whose parts may be frequent, as a mask of its begins."""
        if size not in self.fits:
            shorter = self.stand(size - 1)
            fits = shorter[:-1] & shorter[1:]
            if size == 2:
                fits &= self.chunk[1:] == self.chunk[:-1]
            if size in self.marks:
                some = np.flatnonzero(fits)
                fits[some] = self.marks[size].has(self.short(some, size))
            self.fits[size] = fits
        return self.fits[size]

    def begins(self, size: int) -> np.ndarray:
        fits = self.stand(size)
        return np.flatnonzero(fits & self.owned[: len(fits)])

    def counts(self, size: int) -> list[pa.Array] | None:
        """(langs, phrases, sums) of the phrases of ``size`` words."""
        at = self.begins(size)
        if not len(at):
            return None
        ids = self.lang[at]
        for k in range(size):
            ids, _ = pd.factorize(ids << 32 | self.codes[at + k])
        count = int(ids.max()) + 1
        # Weights stay far below 2**53, so floating sums of them are whole.
        sums = np.bincount(ids, weights=self.n[self.chunk[at]]).astype(np.int64)
        first = np.empty(count, np.int64)
        first[ids[::-1]] = at[::-1]
        words = [self.tokens.take(pa.array(self.codes[first + k])) for k in range(size)]
        return [self.langs.dictionary.take(pa.array(self.lang[first])), pc.binary_join_element_wise(*words, " "), pa.array(sums)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of (lang, chunk, own, n) with about WORDS words together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(batch.column(2)).as_py() or 0
        if size >= WORDS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _added(short: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with their sums."""
    order = np.argsort(short)
    short, n = short[order], n[order]
    head = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
    return short[head], np.add.reduceat(n, head)


def _pack(short: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes as steps, and their sums, byte by byte of equal weight."""
    planes = [np.diff(short, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T, n.astype(np.int64).view(np.uint8).reshape(-1, 8).T]
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(short)).tobytes() + b"".join([p.tobytes() for p in planes]))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(raw, np.uint8, 16 * count, 8).reshape(2, 8, count)
    steps, n = [np.ascontiguousarray(p.T).view(kind).reshape(-1) for p, kind in zip(planes, (np.uint64, np.int64))]
    return np.cumsum(steps, dtype=np.uint64), n


def _part_bits(words: int) -> int:
    """Parts of the hashes, as a power of two: one for so many words of the corpus."""
    return min(max(words // PART, 1).bit_length(), PARTS.bit_length() - 1)


def marked_grams(chunks: DataFrame, size: int, least: int, marks: dict[int, Marks], words: int) -> Marks:
    """The bitmap of phrases of ``size`` words whose short hashes occur ``least`` times."""
    known = chunks.sparkSession.sparkContext.broadcast(marks)
    bits = _part_bits(words)

    def gather(batches):
        hashes, held, n_held = Hashes(), [], 0

        def out():
            short, n = _added(*[np.concatenate(x) for x in zip(*held)])
            part = (short >> np.uint64(SHORT - bits)).astype(np.int32)
            bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(part) != 0]), len(part)]
            packed = [_pack(short[lo:hi], n[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), pa.array(packed, pa.binary())], names=["part", "packed"])

        for table in _groups(batches):
            grams = Grams(table, known.value, hashes)
            at = grams.begins(size)
            if len(at):
                held.append(_added(grams.short(at, size), grams.n[grams.chunk[at]]))
                n_held += len(held[-1][0])
                if n_held >= GATHERED:
                    yield from out()
                    held, n_held = [], 0
        if held:
            yield from out()

    def reach(batches):
        now, short, n, held, n_held = None, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    if held:
                        short, n = _added(*[np.concatenate(x) for x in zip((short, n), *held)])
                    if len(short):
                        yield Marks.batch(short[n >= least])
                    now, short, n, held, n_held = part, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
                held.append(_unpack(packed))
                n_held += len(held[-1][0])
                # What has come is added up before it outgrows what differs.
                if n_held >= max(GATHERED, len(short)):
                    short, n = _added(*[np.concatenate(x) for x in zip((short, n), *held)])
                    held, n_held = [], 0
        if held:
            short, n = _added(*[np.concatenate(x) for x in zip((short, n), *held)])
        if len(short):
            yield Marks.batch(short[n >= least])

    gathered = chunks.select("lang", "chunk", "own", "n").mapInArrow(gather, "part int, packed binary")
    dealt = gathered.repartition("part").sortWithinPartitions("part")
    return Marks(dealt.mapInArrow(reach, "word int, bits bigint"))


def frequent(chunks: DataFrame, longest: int, least: int, marks: dict[int, Marks], words: int) -> DataFrame:
    """(lang, phrase, f) of 2 to ``longest`` words that occur ``least`` times, from the dictionary.

    A task adds up what it counts and sends it packed, by parts of the phrases' hashes.
    """
    known = chunks.sparkSession.sparkContext.broadcast(marks)
    bits = _part_bits(words)

    def gather(batches):
        hashes, seen = Hashes(), Counter()

        def out():
            parts = defaultdict(list)
            for (lang, phrase), n in seen.items():
                parts[xxhash.xxh3_64_intdigest(phrase) >> (64 - bits)].append((lang, phrase, n))
            seen.clear()
            for part in list(parts):
                packed = zstandard.ZstdCompressor(level=1).compress(json.dumps(list(zip(*parts.pop(part)))).encode())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "packed"])

        for table in _groups(batches):
            grams = Grams(table, known.value, hashes)
            for size in range(2, longest + 1):
                langs, phrases, sums = grams.counts(size) or ([], [], [])
                for lang, phrase, n in zip(*[x.to_pylist() if len(x) else [] for x in (langs, phrases, sums)]):
                    seen[lang, phrase] += n
            if len(seen) >= GATHERED:
                yield from out()
        if seen:
            yield from out()

    def reach(batches):
        now, seen = None, Counter()

        def out():
            found = [(lang, phrase, n) for (lang, phrase), n in seen.items() if n >= least]
            seen.clear()
            for lo in range(0, len(found), ROWS):
                columns = zip(*found[lo : lo + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    yield from out()
                    now = part
                for lang, phrase, n in zip(*json.loads(zstandard.ZstdDecompressor().decompress(packed))):
                    seen[lang, phrase] += n
        yield from out()

    gathered = chunks.select("lang", "chunk", "own", "n").mapInArrow(gather, "part int, packed binary")
    return gathered.repartition("part").sortWithinPartitions("part").mapInArrow(reach, "lang string, phrase string, f bigint")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, hides: int = HIDES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Text is lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at
    spaces and tabs. n counts a language's words, f a phrase's occurrences inside
    pieces. A candidate has 2 to ``longest`` words and a = f >= ``least``; cut after its
    first k words into parts of l and r occurrences it scores 1000 * a * n / (l * r),
    rounded down, and its lowest score counts, of equal ones that of the smallest k.
    Candidates inside a longer one with ``hides`` percent of their occurrences go. Rows
    are ranked by score, a (both falling) and phrase. A null language is ``und``; null
    and empty texts have no words. Repeated rows count as often as they stand. An empty
    table gives an empty result, as do languages without candidates; other columns are
    left out.
    """
    words = written(word_counts(docs, text, lang), "words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    common = written(words.filter(F.col("f") >= least), "words")
    discard(words)
    chunks = written(dictionary(docs, text, lang, longest, marked_words(common)), "chunks")
    n_words, marks = totals.agg(F.sum("n")).first()[0] or 0, {}
    for size in range(2, min(longest, 3) + 1):
        marks[size] = marked_grams(chunks, size, least, dict(marks), n_words)
    phrases = written(frequent(chunks, longest, least, marks, n_words), "phrases")
    discard(chunks)
    counts = common.unionByName(phrases)
    counts = written(counts.withColumn("size", F.size(F.split("phrase", " "))), "counts")
    discard(common, phrases)
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    # What a phrase hides: frequencies only fall with length, so parts of one word less are enough.
    part = lambda first: F.array_join(F.slice(words, F.lit(first), F.col("size") - 1), " ")
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array(part(1), part(2))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ones = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(hides) * F.col("a"), F.lit(True)))
    cut = open_ones.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    # Products in 38 digits; a quotient is at most 1000 * n.
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    cut = cut.withColumn("top", F.lit(1000).cast("decimal(4, 0)") * F.col("a").cast("decimal(15, 0)") * wide("n")).withColumn("bottom", wide("l") * wide("r"))
    scored = cut.withColumn("score", F.expr("top div bottom").cast("bigint"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
