"""Shared helpers of the training-data operators: scratch tables, word hashing, table reading."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.scratch import scratch_path, scratch_root  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under the shared scratch folder and reads it back: lineage ends there, so a
    lost executor costs no recomputation. Column types and order stay. The folder goes when the JVM ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The byte classes of the contract's words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_TABLE = np.zeros(256, np.uint8)
WORD_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_TABLE[0x80:] = np.arange(0x80, 0x100)
WORD_BYTES = bytes(int(x) or 0x20 for x in WORD_TABLE)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _STEP, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits depend on all."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def chunks(column, most: int = 1 << 20):
    """An Arrow string column as (first row, byte array, offsets) pieces of about ``most`` bytes, whole rows each."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, row of each word, start, end in bytes) of one piece from chunks(), words lower-cased."""
    low = WORD_TABLE[data]
    word = low != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1]
    inner = inner[(inner < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    at = np.flatnonzero(word)
    which = np.cumsum(first)[at] - 1
    value = low[at].astype(np.uint64) * _POWERS[(at - starts[which]) & 255]
    begin = np.searchsorted(at, starts)
    h = mix(np.add.reduceat(value, begin))
    ends = np.append(at[begin[1:] - 1], at[-1]) + 1
    return h, np.searchsorted(offsets, starts, "right") - 1, starts, ends
