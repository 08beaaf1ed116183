"""Helpers of the operators of this folder: stored stages, bounded memos, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators.ranking import assign_ids
from pairlab.session import cut_lineage, read_table

__all__ = ["ByteMemo", "Memo", "WordHasher", "as_bytes", "fresh", "has_integer_key", "input_parts", "int_crc", "mix", "on_integer_keys", "read_table", "rows_of", "store"]


def store(df: DataFrame, label: str) -> DataFrame:
    """Write the frame below ``spark.checkpoint.dir`` and go on from the copy."""
    return cut_lineage(df, label)


def as_bytes(column: str) -> Column:
    """Text as UTF-8 bytes; a null is the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def int_crc(value: Column) -> Column:
    """Unsigned CRC-32 of an integer written in decimal."""
    return F.crc32(value.cast("string").cast("binary"))


def has_integer_key(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def on_integer_keys(df: DataFrame, key: str, keyed: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` makes of the frame, for keys of any type that has an order.

    Integer keys go in as they are. Others are numbered in their order, and the numbers
    in ``key`` and in ``keyed`` (a key that ``run`` names per row) become keys again, so
    that a smallest number is a smallest key. Null keys stay null.
    """
    if has_integer_key(df, key):
        return run(df)
    name, number = fresh(df, "__name"), fresh(df, "__number")
    names = df.select(F.col(f"`{key}`").alias(name)).filter(F.col(name).isNotNull()).distinct()
    ids = store(assign_ids(store(names, "names"), [F.col(name)], number).withColumn(number, F.col(number).cast("bigint")), "numbers")
    numbered = df.join(ids, F.col(f"`{key}`") == F.col(name), "left").drop(key, name).withColumnRenamed(number, key)
    found = run(numbered)
    for column in (key, keyed):
        of = ids.select(F.col(number).alias("__id"), F.col(name).alias("__as"))
        swapped = [F.col("__as").alias(c) if c == column else F.col(f"`{c}`") for c in found.columns]
        found = found.join(of, F.col(f"`{column}`") == F.col("__id"), "left").select(*swapped)
    return found


def input_parts(df: DataFrame) -> int:
    """Partitions of an input: the measure by which group counts follow the data."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that lists of long texts stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


class Memo(dict):
    """A dict that computes what it lacks and holds at most twice ``limit`` values.

    When it is full, its values become the old ones, of which those asked for again
    come back. It bounds memory only: what it returns does not hang on what it holds.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        value = self[key] = self.compute(key) if value is None else value
        return value


class ByteMemo(Memo):
    """A memo of texts and their codes that holds at most about twice ``limit`` bytes."""

    #: What a key and a value take beside their own bytes.
    OVERHEAD = 200

    def __init__(self, compute: Callable, limit: int):
        super().__init__(compute, limit)
        self.held = 0

    def __missing__(self, key):
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        value = self.old.pop(key, None)
        value = self[key] = self.compute(key) if value is None else value
        self.held += self.OVERHEAD + len(key) + len(value)
        return value


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, position by position; the order of the two counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class WordHasher:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as 64-bit hashes (XXH64), A-Z lower-cased."""

    def __init__(self, limit: int = 100_000):
        self.memo = Memo(xxhash.xxh64_intdigest, limit)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
