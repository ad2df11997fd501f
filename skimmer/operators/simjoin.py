"""Exact joins of vectors by cosine.

Against few keywords, their matrix is broadcast behind a check of its size and multiplied with each batch of words. Else tables meet
in tiles: the right side is grouped under centres; by the triangle inequality of angles, a vector x can only have partners in a group
if its angle to the centre is at most the group's widest plus the angle of the cut, and at least its narrowest less that. Groups and
their visitors are cut into blocks of ``block`` rows by hash, so a crowded group is many tiles, each one matrix product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.scratch import scratch

BROADCAST_BYTES = 64 << 20
MARGIN = 1e-7  # of angles, against rounding
VISITORS = 256  # rows that are copied to all the groups they visit at a time


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(column) -> np.ndarray:
    x = _matrix(column)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def units_or_zero(column, size: int) -> np.ndarray:
    """Unit rows of one length, zeros for null."""
    out, there = np.zeros((len(column), size)), np.asarray(column.is_valid())
    if there.any():
        out[there] = _units(column.drop_null())
    return out


def usable(vectors: DataFrame, word: str = "word") -> DataFrame:
    """(word, vec) as doubles, of vectors that aren't null, zero or of null or non-finite entries."""
    v = F.col("vec").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col("vec").isNotNull()).where(fine).select(F.col(word).alias("word"), v.alias("vec"))


def against_few(words: DataFrame, keys: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """(word, keyword, sim) of each word with each of the keywords, both (word, vec) of one length; None if the keys are too many."""
    size = keys.agg(F.count("*"), F.max(F.size("vec"))).first()
    if size[0] * (size[1] or 0) * 8 > most_bytes:
        return None
    got = keys.toArrow()
    names, units = got.column("word").to_pylist(), _units(got.column("vec").combine_chunks())
    shared = words.sparkSession.sparkContext.broadcast((names, units))

    def run(batches):
        import pyarrow as pa

        names, units = shared.value
        right = pa.array(names, pa.string())
        step = max(1, (1 << 20) // max(len(names), 1))
        for b in batches:
            for at in range(0, b.num_rows if len(names) else 0, step):
                part = b.slice(at, step)
                sims = _units(part.column(1)) @ units.T
                row, key = (x.ravel() for x in np.indices(sims.shape))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), right.take(pa.array(key)), pa.array(sims.ravel())], ["word", "keyword", "sim"])

    return words.select("word", "vec").mapInArrow(run, "word string, keyword string, sim double")


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the unit rows, each the farthest from those before."""
    if not len(x):
        return x
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def over(left: DataFrame, right: DataFrame, least: float, centres: int = 64, block: int = 2048, sample: int = 4096) -> tuple[DataFrame, dict]:
    """((word, keyword, sim) of all pairs whose cosine is over least, {pairs: all there are, met: those multiplied}).

    Tables are (word, vec), words unique in each and vectors of one length; equal words of both tables meet like others. Centres come from
    the ``sample`` rows of least hash: a bounded choice that decides what is skipped, not what is found."""
    spark = left.sparkSession
    right, left = scratch(usable(right)), scratch(usable(left))
    some = right.orderBy(F.xxhash64("word")).limit(sample).toArrow()
    middles = far_apart(_units(some.column("vec").combine_chunks()), centres)
    n_left, n_right = left.count(), right.count()
    if not n_left or not n_right:
        return spark.createDataFrame([], "word string, keyword string, sim double"), {"pairs": 0, "met": 0}
    cut = float(np.arccos(np.clip(least, -1, 1))) + MARGIN
    shared = spark.sparkContext.broadcast(middles)

    def homes(batches):
        import pyarrow as pa

        for b in batches:
            near = _units(b.column(1)) @ shared.value.T
            home = near.argmax(axis=1) if len(near) else np.zeros(0, int)
            angle = np.arccos(np.clip(near[np.arange(len(home)), home], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home, pa.int32()), pa.array(angle)], ["word", "vec", "home", "angle"])

    at_home = scratch(right.mapInArrow(homes, "word string, vec array<double>, home int, angle double"))
    groups = {r.home: r for r in at_home.groupBy("home").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}  # one a centre
    low, high = np.full(len(middles), np.inf), np.full(len(middles), -np.inf)
    for g, r in groups.items():
        low[g], high[g] = r.low, r.high

    def visits(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, VISITORS):
                b = whole.slice(at, VISITORS)
                angle = np.arccos(np.clip(_units(b.column(1)) @ shared.value.T, -1, 1))
                row, group = np.nonzero((angle <= high + cut) & (angle >= low - cut))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(group, pa.int32())], ["word", "vec", "home"])

    seen = left.mapInArrow(visits, "word string, vec array<double>, home int")
    guests = {r.home: r.n for r in seen.groupBy("home").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(g, max(1, -(-r.n // block)), max(1, -(-guests.get(g, 0) // block))) for g, r in groups.items()], "home int, rows int, guests int")
    dealt = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = [at_home.drop("angle").join(F.broadcast(parts), "home").select("home", dealt("rows").alias("i"), every("guests").alias("j"), "word", "vec")]
    sides += [seen.join(F.broadcast(parts), "home").select("home", every("rows").alias("i"), dealt("guests").alias("j"), "word", "vec")]

    def product(own, guest):
        import pyarrow as pa

        a, b = guest.combine_chunks(), own.combine_chunks()
        x, y = _units(a.column("vec").combine_chunks()), _units(b.column("vec").combine_chunks())
        sims = x @ y.T if len(x) and len(y) else np.zeros((0, 0))
        i, j = np.nonzero(sims > least)
        return pa.table({"word": a.column("word").take(pa.array(i)), "keyword": b.column("word").take(pa.array(j)), "sim": pa.array(sims[i, j])})

    tile = ["home", "i", "j"]
    found = sides[0].groupBy(*tile).cogroup(sides[1].groupBy(*tile)).applyInArrow(product, "word string, keyword string, sim double")
    return found, {"pairs": n_left * n_right, "met": sum(r.n * guests.get(g, 0) for g, r in groups.items())}
