"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge can only be undone by bytes to its right through a chain of earlier rules,
each of which joins a right end of what the later rule waits for. The longest such
chain from the right ends of a token bounds how far ahead its end depends on the text:
the sufficient lookahead of that token, worked out from the merge list; the greatest of
them is that of the list. Every piece goes through the transducer: as soon as a token's
lookahead has been read, no rule can join it to what follows, so it is given out with
all before it, and only the rest is held. Decoding runs an incremental byte-to-text
machine.

Whole texts are walked in blocks, so memory does not grow with them beyond the
text itself; pieces seen before come from a cache of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm.common import by_bytes

#: Fixed values of the byte-level format: its split pattern and the bytes that stand for themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

BLOCK = 1 << 16
CACHE = 1 << 17
# Bytes of texts whose ids are held at once.
HELD = 1 << 20
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file to byte: the other bytes take the code points from 256 on."""
    others = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge list, ids and special strings of a byte-level tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        letters, model = byte_letters(), spec["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        ids = model["vocab"]
        self.bytes_of = {i: raw(token) for token, i in ids.items()}
        self.of_byte = [ids[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.longest = max(map(len, self.bytes_of.values()))
        after = lookaheads([(raw(a), raw(b)) for a, b in pairs])
        self.lookahead = max(after.values(), default=0)
        # By id: bytes after a token that make its end final.
        self.after = {i: after.get(token, 0) for i, token in self.bytes_of.items()}
        self.window = 2 * (self.longest + self.lookahead)

    def merged(self, data: bytes) -> list[int]:
        of_byte = self.of_byte
        return merge([of_byte[b] for b in data], self.rules, self.made)


def lookaheads(pairs: list[tuple[bytes, bytes]]) -> dict[bytes, int]:
    """For every token, the bytes after it that decide whether any rule merges across its end.

    A rule (u, v) needs v, and v stays whole unless an earlier rule joins one of the
    right ends that v is built from with what follows: the need of that rule comes on
    top. A token's end is open to the rules of all its right ends and its own.
    """
    need: dict[bytes, int] = defaultdict(int)
    ends: dict[bytes, set[bytes]] = defaultdict(set)

    def right_ends(token: bytes) -> set[bytes]:
        seen, open_ends = {token}, [token]
        while open_ends:
            for end in ends[open_ends.pop()] - seen:
                seen.add(end)
                open_ends.append(end)
        return seen

    for u, v in pairs:
        need[u] = max(need[u], len(v) + max(need[end] for end in right_ends(v)))
        ends[u + v].add(v)
    return {token: max(need[end] for end in right_ends(token)) for token in {*need, *ends, *[v for _, v in pairs]}}


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a place that decide whether any rule merges across it."""
    return max(lookaheads(pairs).values(), default=0)


def merge(symbols: list[int], rules: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The tokens of a window: the earliest rule first, leftmost place first."""
    n, get = len(symbols), rules.get
    if n < 64:
        ranks = [get(pair, NONE) for pair in zip(symbols, symbols[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            symbols[i : i + 2] = [made[rank]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), NONE)
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rules[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rules]
    heapq.heapify(heap)
    live = list(symbols)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if live[i] < 0 or j >= n or get((live[i], live[j]), NONE) != rank:
            continue
        live[i], live[j] = made[rank], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            right = get((live[i], live[after[i]]), NONE)
            if right != NONE:
                heapq.heappush(heap, (right, i))
        if before[i] >= 0:
            left = get((live[before[i]], live[i]), NONE)
            if left != NONE:
                heapq.heappush(heap, (left, before[i]))
    return [s for s in live if s >= 0]


class Transducer:
    """Bytes in, tokens out as soon as no later byte can change them."""

    # Bytes that are taken in before tokens are looked for.
    STEP = 64

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held, self.wait = bytearray(), self.STEP

    def push(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.STEP):
            self.held += data[at : at + self.STEP]
            if len(self.held) >= self.wait:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        tokens = self.v.merged(self.held)
        rest, last = 0, len(tokens)
        # The last token whose lookahead is there; all before it are as final as its end.
        while last and rest < self.v.after[tokens[last - 1]]:
            last -= 1
            rest += len(self.v.bytes_of[tokens[last]])
        yield from tokens[:last]
        del self.held[: len(self.held) - rest]
        # Where nothing is final yet, more is read before the next look.
        self.wait = max(self.STEP, 2 * rest)

    def finish(self) -> Iterator[int]:
        yield from self.v.merged(self.held)
        self.held, self.wait = bytearray(), self.STEP


class Pieces(dict):
    """Piece of text to its ids in decimal, joined by commas; two generations of ``CACHE`` pieces are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer, self.older = Transducer(vocabulary), {}

    def __missing__(self, piece: str) -> str:
        entry = self.older.get(piece)
        if entry is None:
            entry = ",".join(map(str, [*self.transducer.push(piece.encode()), *self.transducer.finish()]))
        if len(piece) <= 32:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = entry
        return entry


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pieces = vocabulary, Pieces(vocabulary)
        self.split = regex.compile(SPLIT).findall
        # A cut after something visible and before white space never divides a piece.
        self.cut = regex.compile(r"\S(?=\s)").search
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.decoded = {str(i): data for i, data in self.v.bytes_of.items()}

    def encoded(self, text: str) -> Iterator[str]:
        """Ids of the text, joined by commas, block by block."""
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield str(self.v.special[part])
                continue
            at = 0
            while at < len(part):
                found = self.cut(part, at + BLOCK) if len(part) - at > BLOCK else None
                end = found.end() if found else len(part)
                yield ",".join(map(self.pieces.__getitem__, self.split(part[at:end])))
                at = end

    def ids(self, text: str) -> list[int]:
        return [int(i) for block in self.encoded(text) for i in block.split(",")]

    def decode(self, ids: list[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join([machine.decode(self.v.bytes_of[i]) for i in ids]) + machine.decode(b"", final=True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text they decode to; a block at a time."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in self.encoded(text):
            tokens = block.split(",")
            ids.update(f",{block}".encode() if n else block.encode())
            n += len(tokens)
            decoded.update(machine.decode(b"".join(map(self.decoded.__getitem__, tokens))).encode())
        decoded.update(machine.decode(b"", final=True).encode())
        return n, ids.hexdigest(), decoded.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(text: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(Vocabulary(text))
    return _codecs[key]


def _with(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in columns.items()]])


def _texts(column) -> list[str]:
    return [value or "" for value in column.to_pylist()]


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text; null counts as empty, empty has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    rows = docs.drop(name)
    schema = _with(rows.schema, **{name: T.ArrayType(T.IntegerType())})

    def run(batches):
        work = codec(shared.value)
        for batch in batches:
            for part in by_bytes(batch, batch.schema.get_field_index(text), HELD):
                ids = [work.ids(t) for t in _texts(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer_file: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    kept = rows.drop(name)
    schema = _with(kept.schema, **{name: T.StringType()})

    def run(batches):
        work = codec(shared.value)
        for batch in batches:
            texts = [work.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs``, n_tokens, ids, and ``decodes``: whether the ids decode to the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids", "decodes")]
    schema = _with(docs.select(*others).schema, n_tokens=T.LongType(), ids=T.ArrayType(T.IntegerType()), decodes=T.BooleanType())

    def run(batches):
        work = codec(shared.value)
        for batch in batches:
            for part in by_bytes(batch, len(others), HELD):
                texts = _texts(part.column(len(others)))
                ids = [work.ids(t) for t in texts]
                same = [work.decode(i) == t for i, t in zip(ids, texts)]
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*others, "n_tokens", "ids", "decodes"])

    return docs.select(*others, text).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, without keeping ids or texts.

    Null counts as the empty text. Repeated rows give repeated results, an empty
    table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        work = codec(shared.value)
        for batch in batches:
            found = [work.digest(t) for t in _texts(batch.column(1))]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
