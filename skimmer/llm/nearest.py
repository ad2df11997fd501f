"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors of unit length are turned by a learned rotation (iterative quantisation on a bounded sample) and reduced to signs.
Radius: fitted on the same sample, the Hamming distance within which ``wanted`` of the true neighbours of sampled queries lie.
Neighbours among all rows are nearer than those in a sample, so the radius errs on the wide side; it is one number for
the whole search and doesn't depend on how rows are dealt out.

Index: rows are read in chunks of ``chunk``; a code is cut into substrings, each with its own table. By the pigeonhole principle a
code within radius r = m s + a of a query (m tables) agrees with it up to s bits on one of the first a + 1 substrings or up to
s - 1 bits on one of the others, so probing the tables with all values that near retrieves every code within the radius. Those
are reranked by the cosine of the original vectors in double precision, and the best of all chunks are kept.

A query with fewer than k others within the radius (far from everything) is searched again: its radius grows until each chunk
gives ``candidates`` codes. Equal vectors form one class, searched and compared once: of each class only the least ids can be among
the nearest. Queries go in blocks of a fixed size, one at a time, so what the driver and the tasks hold is bounded.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skimmer.llm.common import col, scratch, table


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dimensions x bits): principal directions, then the rotation that brings signs nearest to the projections."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :bits]
    v, rng = x @ axes, np.random.default_rng(7)
    r = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def codes(x: np.ndarray, model) -> np.ndarray:
    """A uint64 by row; bits above those of the model are zero."""
    mean, turn = model
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = (unit - mean) @ turn >= 0
    return (bits.astype(np.uint64) << np.arange(turn.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


@lru_cache(maxsize=256)
def flips(width: int, most: int) -> np.ndarray:
    """All values of up to ``most`` set bits among ``width``."""
    return np.array([sum(1 << b for b in c) for k in range(min(most, width) + 1) for c in combinations(range(width), k)], np.int64)


class Index:
    """Substring tables over codes: each holds the rows in the order of their substring, and where each value begins."""

    def __init__(self, code: np.ndarray, bits: int, tables: int):
        self.code, self.bits, self.tables = code, bits, tables
        cut = [bits * i // tables for i in range(tables + 1)]
        self.parts = [(np.uint64(a), b - a) for a, b in zip(cut, cut[1:])]
        self.rows, self.begin = [], []
        for shift, width in self.parts:
            value = ((code >> shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            self.rows.append(np.argsort(value, kind="stable"))
            self.begin.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))]))

    def within(self, q: np.uint64, radius: int) -> np.ndarray:
        """The rows of all codes within the radius, in order."""
        steps, more = divmod(radius, self.tables)
        found = []
        for t, (shift, width) in enumerate(self.parts):
            step = steps if t <= more else steps - 1
            if step < 0:
                continue
            probes = int((q >> shift) & np.uint64((1 << width) - 1)) ^ flips(width, step)
            first, count = self.begin[t][probes], self.begin[t][probes + 1]
            count -= first
            some = count > 0
            first, count = first[some], count[some]
            rows = self.rows[t][np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
            found.append(rows[np.bitwise_count(self.code[rows] ^ q) <= radius])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def near(self, q: np.uint64, least: int) -> np.ndarray:
        """The rows of all codes within the smallest radius of a ladder that holds ``least`` codes (or all there are)."""
        for radius in range(self.tables - 1, self.bits + self.tables, self.tables):
            found = self.within(q, min(radius, self.bits))
            if len(found) >= min(least, len(self.code)):
                break
        return found


def fit_radius(x: np.ndarray, model, k: int, wanted: float, queries: int = 512) -> int:
    """The Hamming distance within which ``wanted`` of the k nearest others of the first ``queries`` rows of x lie, in x."""
    unit, code = x / np.linalg.norm(x, axis=1, keepdims=True), codes(x, model)
    apart = []
    for i in range(min(queries, len(x))):
        score = unit @ unit[i]
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        apart.append(np.bitwise_count(code[best] ^ code[i]))
    apart = np.sort(np.concatenate(apart)) if apart else np.zeros(0)
    return int(apart[min(len(apart) - 1, int(np.ceil(wanted * len(apart))))]) if len(apart) else 0


def vectors_of(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v as doubles) of the rows whose vectors are there, not zero, without null or non-finite components, and of the
    commonest length (ties: the shorter one)."""
    rows = df.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def search(df: DataFrame, vec_id="vec_id", vector="embedding", queries=None, k: int = 5, bits: int = 64, tables: int = 4, candidates: int = 256, wanted: float = 0.98, sample: int = 20_000, block: int = 16_384, chunk: int = 65_536, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query by cosine, ties to the smaller id; fewer if there are fewer.

    queries: a condition on vec_id (default: divisible by 50). Vectors that are null, zero, not finite or of another length than
    the rest, and rows without an id, take no part. Rows that repeat an id are one row of each vector. Empty tables give no
    rows; other columns are not read. parts: how many files the classes are written to, no matter to the result."""
    spark = df.sparkSession
    asked = F.col("vec_id") % 50 == 0 if queries is None else queries
    rows = usable(df, vec_id, vector).distinct()
    rows = scratch(rows.withColumn("key", F.sha2(F.to_json(F.col("v")), 256)))
    least = Window.partitionBy("key").orderBy("vec_id")
    # of a class of equal vectors, its k + 1 least ids are all that any query can have among its nearest
    members = scratch(rows.withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1).select("key", "at", "vec_id"))
    classes = members.where("at = 1").join(rows, ["key", "vec_id"]).select("key", F.col("vec_id").alias("class"), "v")
    classes = scratch(classes.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "key"))
    few = classes.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow().to_pandas()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(few):
        return none
    x = np.stack(few["v"].to_numpy())
    model = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), min(bits, x.shape[1], 64))
    radius, best_k = fit_radius(x, model, k, wanted), k + 1
    goal = scratch(rows.where(asked).select("key").distinct().join(classes, "key").select("key", "v"))

    def found_by(asked_rows: DataFrame, radius: int | None) -> DataFrame:
        """(q, key, score): the k + 1 best classes of each query, a block of queries at a time; without a radius it grows."""
        blocks, done = max(1, -(-asked_rows.count() // block)), None
        for b in range(blocks):
            mine = asked_rows if blocks == 1 else asked_rows.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
            got = mine.toArrow().to_pandas()
            if not len(got):
                continue
            shared = spark.sparkContext.broadcast((got["key"].to_numpy(), np.stack(got["v"].to_numpy()), model))

            def run(batches, shared=shared):
                import pyarrow as pa

                names, qx, model = shared.value
                q, qsize = codes(qx, model), np.sqrt((qx * qx).sum(axis=1))

                def solve(held):
                    t = pa.Table.from_batches(held)
                    keys, x = t.column("key").combine_chunks(), vectors_of(t.column("v"))
                    index, size, out = Index(codes(x, model), model[1].shape[1], tables), np.sqrt((x * x).sum(axis=1)), []
                    for i in range(len(names)):
                        near = index.near(q[i], candidates) if radius is None else index.within(q[i], radius)
                        score = (x[near] @ qx[i]) / (size[near] * qsize[i])
                        if len(near) > best_k:
                            keep = np.flatnonzero(score >= np.partition(score, -best_k)[-best_k])  # ties stay
                            near, score = near[keep], score[keep]
                        out.append((np.full(len(near), i), near, score))
                    a, c, s = (np.concatenate(z) for z in zip(*out))
                    return pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), keys.take(pa.array(c)), pa.array(s)], ["q", "key", "score"])

                held, n = [], 0
                for batch in batches:
                    held.append(batch)
                    n += batch.num_rows
                    if n >= chunk:
                        yield solve(held)
                        held, n = [], 0
                if n:
                    yield solve(held)

            some = classes.select("key", "v").mapInArrow(run, "q string, key string, score double")
            best = Window.partitionBy("q").orderBy(F.desc("score"), "class")
            some = some.join(classes.select("key", "class"), "key").withColumn("at", F.row_number().over(best)).where(F.col("at") <= best_k)
            some = scratch(some.select("q", "key", "class", "score"))
            shared.destroy()
            done = some if done is None else done.unionByName(some)
        return done if done is not None else spark.createDataFrame([], "q string, key string, class long, score double")

    found = found_by(goal, radius)
    enough = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= best_k)
    short = scratch(goal.join(enough.select(F.col("q").alias("key")), "key", "left_anti"))
    if not short.isEmpty():
        again = found_by(short, None)
        found = found.join(short.select(F.col("key").alias("q")), "q", "left_anti").unionByName(again)
    # the k + 1 best classes hold the k best others of any member of the query's class
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = found.select("q", "key", "score").join(members.select("key", "vec_id"), "key").select("q", "score", "vec_id")
    named = scratch(named.withColumn("at", F.row_number().over(top)).where(F.col("at") <= best_k).drop("at"))
    each = rows.where(asked).select(F.col("vec_id").alias("query_id"), F.col("key").alias("q")).join(named, "q").where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
