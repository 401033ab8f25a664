"""Packing by power-of-two decomposition: no sequence holds ids of two documents, and none is padded.

A document of n ids is cut into pieces of the greatest length and, for the rest, into
one piece for each binary digit of it, from the longest to the shortest. Pieces of
equal length form a bucket, and every piece is a sequence of its bucket, so a batch
drawn from one bucket is rectangular. A sequence's number holds its bucket (from the
longest on), its task and its place in the task, so ordering by it goes through the
buckets, and nothing has to move or be counted first.

Ids come word by word: the tokenizer removes white space and never looks across it, so
a word's ids do not depend on its neighbours, and a worker asks for a word once as long
as it comes up again before many others.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

MOST = 2048
# The id that ends every document.
END = 1
# Characters of a text that are split into words at once, and words that a worker remembers before it begins anew;
# those of the time before are remembered for as long again.
BLOCK, KNOWN = 1 << 18, 300_000
# Bits of a sequence's number for its place among a task's pieces of one length, and for these and the task.
PLACE, TASK = 33, 58
# Bytes of ids in a batch on its way out.
BATCH = 4 << 20

_words = re.compile(r"[^\x20\x09-\x0D]+")
_gap = re.compile(r"[\x20\x09-\x0D]")
# Words of printable ASCII and Latin letters; the one letter whose small form has two characters is left out.
_latin = re.compile(r"[!-~À-ÖØ-öø-įı-ɏ]+\Z")
#: Fixed values of the vocabulary: how it cuts lower-case text, for the characters of such words.
_cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏⱥⱦ]+|[0-9]|[^a-zß-öø-ɏⱥⱦ0-9]+").findall
#: Fixed values of the vocabulary: bytes that stand for themselves; the others follow from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_SHOWN = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _SHOWN)}


class Ids:
    """Words to their ids as little-endian unsigned 32-bit numbers.

    Words of Latin letters, digits and marks are made small and cut here, and the model
    of the vocabulary merges each part; all others, and those that might hold a special
    token, go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            shown = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(_AS_SHOWN)
            found = self.known[part] = array("I", [token.id for token in self.merge(shown)]).tobytes()
        return found

    def _learn(self, words: set[str]) -> None:
        whole = []
        for word in words:
            if word.isascii() and word.isalpha():
                # Letters alone are one part.
                self.known[word] = self._part(word.lower())
            elif _latin.match(word) and "<|" not in word:
                self.known[word] = b"".join([self._part(part) for part in _cut(word.lower())])
            else:
                whole.append(word)
        for word, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            self.known[word] = array("I", e.ids).tobytes()

    def of_words(self, words: list[str]) -> bytes:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set(words).difference(known)
        if new and older:
            again = [word for word in new if word in older]
            known.update(zip(again, map(older.__getitem__, again)))
            new.difference_update(again)
        if new:
            self._learn(new)
        return b"".join(map(known.__getitem__, words))

    def of_text(self, text: str) -> bytes:
        found, at = [], 0
        while at < len(text):
            gap = _gap.search(text, at + BLOCK)
            end = gap.end() if gap else len(text)
            found.append(self.of_words(_words.findall(text, at, end)))
            at = end
        return b"".join(found)


_workers: dict[str, Ids] = {}


def lengths(n: int, most: int = MOST) -> list[int]:
    """The lengths of the pieces of ``n`` ids: ``most`` as often as it fits, then falling powers of two."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pieces(docs: DataFrame, vocabulary: str, key: str, text: str, most: int, end: int) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id): the pieces of all documents."""
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _workers:
            _workers[vocabulary] = Ids(vocabulary)
        ids, seen, held, size = _workers[vocabulary], Counter(), [], 0
        task = TaskContext.get().partitionId() << PLACE
        bucket = {most >> n: n << TASK for n in range(most.bit_length())}
        last = np.array([end], "<u4").tobytes()
        kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ids.of_text(whole or "") + last
                total, start = len(found) // 4, 0
                for n in lengths(total, most):
                    held.append((name, start, n, found[4 * start : 4 * (start + n)], total, bucket[n] | task | seen[n]))
                    seen[n] += 1
                    start += n
                    size += 4 * n + 64
                    if size >= BATCH:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()
                held, size = [], 0

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint"
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): every id of every document in one sequence.

    ``ids`` are little-endian unsigned 32-bit numbers; ``most`` is a power of two. The
    length of a sequence is its bucket, and as a sequence holds one piece, its offset is
    0. Numbers of sequences differ and may leave gaps; a task that runs again gives the
    same ones. A null or empty text is a document of the end id alone. Rows that share a key, and
    rows with a null key, are documents of their own; only their pieces tell them apart.
    An empty table gives an empty result; other columns are left out.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the greatest length has to be a power of two")
    found = pieces(docs, vocabulary, key, text, most, end)
    return found.select(F.col("id").alias(key), "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))
