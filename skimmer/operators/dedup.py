"""Duplicates by content and by origin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.functions.text import characters, let
from skimmer.operators.match import small
from skimmer.scratch import scratch


def bit_votes(words: Column, bits: int = 64) -> Column:
    """A fingerprint by bit majority of the words' hashes, as a long; equal texts have equal ones. No words: zero."""

    def vote(hashes: Column) -> Column:
        ones = F.aggregate(
            hashes, F.array_repeat(F.lit(0), bits),
            lambda s, h: F.transform(s, lambda n, i: n + F.call_function("shiftright", h, i).bitwiseAND(F.lit(1)).cast("int")),
        )
        set_bits = F.transform(ones, lambda n, i: F.when(2 * n > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(set_bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))

    return let(F.transform(words, lambda w: F.xxhash64(w)), vote)


def shingled(text: Column, width: int = 4) -> Column:
    """Overlapping groups of lower-case letters and digits; a shorter text is one group."""

    def groups(chars: Column) -> Column:
        last = F.greatest(F.size(chars) - width, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws("", *(F.get(chars, i + j) for j in range(width))))

    return let(characters(F.regexp_replace(F.lower(text), r"[^\w]+", "")), groups)


def _hashes(groups: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 42) of four bytes each, given as little-endian numbers, as the built-in has it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (np.uint64(42) + p5 + np.uint64(4)) ^ (groups.astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _majority(text: bytes, piece: int = 32_768) -> int:
    """The bit majority of the hashes of all groups of four bytes; sixteen-bit lanes hold the votes of a piece."""
    data, n, ones = np.frombuffer(text, np.uint8), len(text) - 3, np.zeros((16, 4), np.int64)
    lanes = np.uint64(0x0001000100010001)
    for at in range(0, n, piece):
        d = data[at : min(at + piece, n) + 3].astype(np.uint32)
        h = _hashes(d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24)
        for k in range(16):
            ones[k] += np.array([((h >> np.uint64(k)) & lanes).sum()], "<u8").view("<u2")
    bits = (2 * ones.T.ravel() > n).astype(np.uint8)  # bit 16 j + k is in lane j of shift k
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """bit_votes(shingled(text)) for texts of any length: the built-in form takes 64 interpreted steps for each group."""
    kept = F.regexp_replace(F.lower(text), r"[^\w]+", "")  # ASCII letters, digits and _ only

    @F.pandas_udf("long")
    def votes(texts):
        with np.errstate(over="ignore"):
            return texts.map(lambda t: _majority(t.encode())).astype("int64")

    # no nulls go in: with one, the numbers of its batch would come back as floats
    long = F.when(kept.isNotNull(), votes(F.coalesce(kept, F.lit(""))))
    return F.when(F.length(kept) < 4, bit_votes(F.array(kept))).otherwise(long)


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("`__at` = 1").drop("__at")


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def related_and_pushed(accepted: DataFrame, thresholds: DataFrame, cap: int = 10, scope: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(related, pushed) of accepted rows (seq, hash, orig_id, pid, score): the sequential rule in window form.

    Equal where rows of one orig_id have one profile and equal hashes one orig_id; streaming.push.engine is the stateful form. First
    rows and pushes are written once."""
    first = scratch(first_by(accepted, ["hash"], ["seq"]))
    over = first.join(small(scratch(thresholds.select("pid", "threshold"))), "pid")
    over = first_by(over.where(F.round("score", 12) > F.col("threshold")), ["orig_id"], ["seq"]).drop("threshold")
    pushed = over.withColumn("at", F.row_number().over(Window.partitionBy("pid", *scope).orderBy("seq"))).where(F.col("at") <= cap).drop("at")
    pushed = scratch(pushed)
    earlier = pushed.select("orig_id", F.col("seq").alias("pushed_at"))
    related = first.join(earlier, "orig_id", "left").where("pushed_at is null or seq <= pushed_at").drop("pushed_at")
    return related, pushed
