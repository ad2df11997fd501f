"""Sharding by histogram sort: shards of nearly equal bytes, cut out of one order of all documents.

Keys are 128 bits: the hash of a text, then the hash of its id and place, so equal texts stand together, in one shard or in shards
next to each other, and a text that a third of all rows share can still be cut. Splitters are found by counting: each pass over the
keys (written once, without the texts) counts exact rows and bytes below candidate boundaries in all partitions, and each splitter's
bracket shrinks to the two nearest ones, until the bytes below are within ``tolerance`` of its share or no row is left in between.
Then the texts are exchanged once, to the partition that their key falls into, sorted there and written, many partitions a shard.

The law is ``bytes``: sizes of shards are equal up to ``tolerance`` of a shard and a document. Splitters between the partitions of a
shard are looser. Slots come from counts of what was written, so they are gapless whatever the order of rows that are alike.

A null text has size 1 and the checksum of an empty one; a null id is kept; repeated rows are told apart by their place in the
table (a re-run task must read rows in the same order, as from files); other columns are written along; an empty table gives no
rows. Text is moved once; the driver holds splitters, a few numbers for each partition.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import col, fresh, scratch, scratch_path, table

SHARDS = 8
PART_BYTES = 64 << 20  # text of a partition of the exchange
NEAR = 1 / 64  # of a bracket, on both sides of where the goal should lie
_HALF, _LOW = 1 << 63, 0


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """docs with two halves of the key and the size, under names of their own."""
    names = fresh(docs, "__key", "__tie", "__size")
    place = F.monotonically_increasing_id()
    key, tie = F.xxhash64(F.coalesce(col(text), F.lit(""))), F.xxhash64(F.coalesce(col(doc_id).cast("string"), F.lit("")), place)
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + 1
    return docs.select(*(col(c) for c in docs.columns), key.alias(names[0]), tie.alias(names[1]), size.alias(names[2])), names


def _halves(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit numbers as two signed halves, as hashes are."""
    return np.array([(b >> 64) - _HALF for b in bounds], np.int64), np.array([(b & ((1 << 64) - 1)) - _HALF for b in bounds], np.int64)


def places(key: np.ndarray, tie: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds (first, second) are at or below each (key, tie)."""
    at = np.searchsorted(first, key, "right")
    left = np.searchsorted(first, key, "left")
    for i in np.flatnonzero(at > left):  # few: a bound within the very text of a row
        at[i] = left[i] + np.searchsorted(second[left[i] : at[i]], tie[i], "right")
    return at


def count_below(keys: DataFrame, bounds: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int] | None]]:
    """Below each ascending bound, and of all keys at the end: exact (rows, bytes). Between each two: the least and the largest key.
    One pass, added up in each task first."""
    halves = _halves(bounds)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key, tie, size = (b.column(i).to_numpy() for i in range(3))
            at = places(key, tie, *halves)
            order = np.lexsort((tie, key, at))
            key, tie, at = key[order], tie[order], at[order]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            if len(begin):
                end = np.append(begin[1:], len(at))
                cols = [at[begin], end - begin, np.add.reduceat(size[order], begin), key[begin], tie[begin], key[end - 1], tie[end - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    names = ["at", "n", "bytes", "k0", "t0", "k1", "t1"]
    found = keys.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("at")
    found = found.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min(F.struct("k0", "t0")).alias("least"), F.max(F.struct("k1", "t1")).alias("most"))
    each, ends = np.zeros((2, len(bounds) + 1), np.int64), [None] * (len(bounds) + 1)
    for r in found.collect():
        each[:, r["at"]] = r["n"], r["bytes"]
        ends[r["at"]] = tuple((x[0] + _HALF << 64) + x[1] + _HALF for x in (r["least"], r["most"]))
    return list(zip(*each.cumsum(axis=1).tolist())), ends


def splitters(keys: DataFrame, parts: int, shards: int = SHARDS, tolerance: float = 0.001, loose: float = 0.1, probes: int = 7, most_passes: int = 60) -> tuple[list[int], int]:
    """(the parts - 1 boundaries between partitions, passes made) of keys (key, tie, size); parts is a multiple of shards. The bytes
    below a boundary of shards are within tolerance of a shard of what they should be, others within loose of a partition, or the
    boundary stands at the nearest row."""
    counted, ends = count_below(keys, [])
    (rows, total), passes = counted[0], 1
    if not rows:
        return [_LOW] * (parts - 1), passes
    share = total / parts
    # of each boundary: the nearest bounds at or below its goal and above it, with rows and bytes below them
    low = [(ends[0][0], 0, 0)] * (parts - 1)
    high = [(ends[0][1] + 1, rows, total)] * (parts - 1)
    goal = [share * (j + 1) for j in range(parts - 1)]
    slack = [tolerance * total / shards if (j + 1) % (parts // shards) == 0 else loose * share for j in range(parts - 1)]

    def done(j: int) -> bool:
        (a, n, at), (b, m, to) = low[j], high[j]
        return min(goal[j] - at, to - goal[j]) <= slack[j] or m - n <= 1 or b - a <= 1

    while open_ := [j for j in range(parts - 1) if not done(j)]:
        if passes > most_passes:
            raise ValueError("splitters don't settle")
        asked = set()
        for j in open_:
            (a, _, at), (b, _, to) = low[j], high[j]
            # keys are hashes, so bytes lie evenly but for large documents: some probes close in on the goal, the rest cut evenly
            wide, near = b - a, (goal[j] - at) / (to - at)
            for where in [near - NEAR, near, near + NEAR, *((i + 1) / (probes + 1) for i in range(probes))]:
                asked.add(a + min(max(int(wide * where), 1), wide - 1))
            asked |= {a, b}
        bounds = sorted(asked)
        (counted, ends), passes = count_below(keys, bounds), passes + 1
        for j in open_:
            i = bisect_left(bounds, low[j][0])
            while counted[i + 1][1] <= goal[j]:
                i += 1
            # all rows of the bracket lie between the keys that were met there
            low[j], high[j] = (ends[i + 1][0], *counted[i]), (ends[i + 1][1] + 1, *counted[i + 1])
    return [low[j][0] if goal[j] - low[j][2] <= high[j][2] - goal[j] else high[j][0] for j in range(parts - 1)], passes


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id="doc_id", text="text", part_bytes: int = PART_BYTES, **how) -> DataFrame:
    """Writes docs as Parquet under path, a folder for each shard, in key order, and returns read_shards() of it."""
    keyed, names = _keyed(docs, doc_id, text)
    keys = scratch(keyed.select(*names))
    total = keys.agg(F.coalesce(F.sum(names[2]), F.lit(0))).first()[0]
    parts = shards * max(1, -(-total // (part_bytes * shards)))
    bounds, _ = splitters(keys, parts, shards, **how)
    shared = docs.sparkSession.sparkContext.broadcast(_halves(bounds))

    @F.pandas_udf("int")
    def part_of(key, tie):
        import pandas as pd

        return pd.Series(places(key.to_numpy(), tie.to_numpy(), *shared.value).astype(np.int32))

    part, shard, at = fresh(docs, "part", "shard", "at_in_part")
    own = [col(c) for c in docs.columns]
    # by id of the partition, not by its hash: each partition gets one range of keys
    dealt = keyed.withColumn(part, part_of(names[0], names[1])).repartitionById(parts, F.col(part)).sortWithinPartitions(part, names[0], names[1])
    placed = dealt.select(*own, F.col(names[2]), F.col(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at))
    placed.withColumn(shard, F.floor(F.col(part) / (parts // shards)).cast("int")).write.partitionBy(shard).parquet(path)
    return read_shards(docs, path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What write_shards wrote of docs: their columns, shard, slot (from 0 in each shard, gapless) and size, under names of their own
    if docs has such."""
    spark = docs.sparkSession
    part, shard, at = fresh(docs, "part", "shard", "at_in_part")
    size, (slot, bytes_, first) = _sizes(docs), fresh(docs, "slot", "size", "first_in_part")
    kinds = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{size}` long, `{part}` int, `{at}` long, `{shard}` int"])
    rows = spark.read.schema(kinds).parquet(path)
    counts = rows.groupBy(shard, part).agg(F.count("*").alias("n")).orderBy(shard, part).collect()  # a row for each partition
    firsts, before, last = [], 0, None
    for r in counts:
        before = before if r[0] == last else 0
        firsts.append((r[1], before))
        before, last = before + r[2], r[0]
    starts = spark.createDataFrame(firsts, f"`{part}` int, `{first}` long")
    both = rows.join(F.broadcast(starts), part) if len(firsts) <= 1_000_000 else rows.join(starts, part)
    return both.select(*(col(c) for c in docs.columns), F.col(shard), (F.col(first) + F.col(at)).alias(slot), F.col(size).alias(bytes_))


def _sizes(docs: DataFrame) -> str:
    return fresh(docs, "__key", "__tie", "__size")[2]


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = write_shards(docs, scratch_path(spark))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
