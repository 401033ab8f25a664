"""Append-only tables with an index that tells which files may hold a key.

The data files lie side by side in one folder. ``_keys`` beside them has, for every
file, marks of the keys in it: the highest bits of a key's hash name a word of 64 bits,
and three of its lower bits are set there. Rows of one word are written to the same
file, so a file owns few words; looking up keys is an equi-join on the word. It never
misses a key, and takes a file for a key that it lacks about once in fifty times where
it owns the key's word. A write that was cut off before its files were indexed loses
nothing: files without an entry are read, and the next write indexes them.

Nothing here depends on a fixed number of folders or tasks: files are as large as the
adaptive planner makes partitions, and a key with very many rows is spread over several.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Keys that share a word of 64 bits.
KEYS_PER_WORD = 6
# A null word stands for a file without rows.
INDEX = "file string, bits int, word bigint, marks bigint"


def read_or_empty(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """The table at ``path``, or an empty one before the first write."""
    if not path:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _word(h: str, bits: str) -> Column:
    return F.expr(f"shiftrightunsigned({h}, 64 - {bits})")


def _marks(h: str) -> Column:
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * n}) & 63 as int))" for n in range(3)))


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of keys that counts null as a value."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


class KeyedTable:
    """The table below ``path`` with columns of ``schema``, looked up by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)

    def rows(self, files: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some files."""
        return read_or_empty(self.spark, self.path if files is None else [f"{self.path}/{name}" for name in files], self.schema)

    def files(self) -> list[str]:
        """Names of the data files, as the reader lists them."""
        return [name.rsplit("/", 1)[-1] for name in self.rows().inputFiles()]

    def index(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/_keys", INDEX)

    def holding(self, keys: DataFrame) -> list[str]:
        """Names of the files that may hold one of ``keys``; those without an index entry are among them."""
        files = self.files()
        if not files:
            return []
        # One row for each file, as in the listing that the driver has anyway.
        known = {r.file: r.bits for r in self.index().groupBy("file").agg(F.max("bits").alias("bits")).collect()}
        found = {name for name in files if name not in known}
        sizes = sorted({known[name] for name in files if known.get(name)})
        if sizes:
            hashes = keys.select(key_hash(self.key).alias("h")).distinct()
            asked = hashes.select("h", F.explode(F.array(*[F.lit(b) for b in sizes])).alias("bits"))
            asked = asked.select("bits", _word("h", "bits").alias("word"), _marks("h").alias("mask"))
            met = self.index().join(asked, ["bits", "word"]).filter(F.col("marks").bitwiseAND(F.col("mask")) == F.col("mask"))
            found |= {r.file for r in met.select("file").distinct().collect()}
        return [name for name in files if name in found]

    def append(self, rows: DataFrame, n_keys: int) -> list[str]:
        """Write rows of about ``n_keys`` keys and index their files; returns the files' names."""
        bits = max(1, math.ceil(math.log2(max(n_keys, 1) / KEYS_PER_WORD + 1)))
        before = set(self.files())
        placed = rows.withColumn("__word", F.shiftrightunsigned(key_hash(self.key), 64 - bits))
        placed.hint("rebalance", F.col("__word")).drop("__word").write.mode("append").parquet(self.path)
        new = [name for name in self.files() if name not in before]
        self.add_to_index(new, bits)
        return new

    def add_to_index(self, names: Sequence[str], bits: int) -> None:
        if not names:
            return
        hashes = self.rows(names).select(F.col("_metadata.file_name").alias("file"), key_hash(self.key).alias("h"))
        words = hashes.groupBy("file", F.lit(bits).alias("bits"), F.shiftrightunsigned("h", 64 - bits).alias("word")).agg(F.bit_or(_marks("h")).alias("marks"))
        every = self.spark.createDataFrame([(name, None, None, None) for name in names], INDEX)
        words.unionByName(every).write.mode("append").parquet(f"{self.path}/_keys")

    def repair(self) -> list[str]:
        """Index the files that a cut-off write left without an entry; returns their names."""
        known = {r.file for r in self.index().select("file").distinct().collect()}
        lost = [name for name in self.files() if name not in known]
        n = self.rows(lost).agg(F.approx_count_distinct(key_hash(self.key))).first()[0] if lost else 0
        self.add_to_index(lost, max(1, math.ceil(math.log2(n / KEYS_PER_WORD + 1))))
        return lost

    def matching(self, keys: DataFrame, by: Sequence[str] | None = None, files: Sequence[str] | None = None) -> DataFrame:
        """The stored rows of ``keys``, compared on the columns ``by``; only files that may hold them are read."""
        by = list(by or self.key)
        stored = self.rows(self.holding(keys) if files is None else files)
        return stored.alias("s").join(keys.select(*by).distinct().alias("k"), same_keys("s", "k", by), "left_semi")
