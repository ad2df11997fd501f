"""Similarity of a text and a profile.

pairs (word, keyword, sim) hold what two words are to each other: 1 for equal ones, else their cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimmer.operators import simjoin
from skimmer.operators.match import small
from skimmer.scratch import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def word_pairs(words: DataFrame, keywords: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """(word, keyword, sim) of each word in use with each keyword; words without vectors have 0 with all but themselves, and no row.
    Few keywords are one broadcast matrix behind a check of its bytes; many are joined in tiles, see simjoin. Vectors that are null, zero
    or hold null or non-finite entries count as none."""
    fine = simjoin.usable(vectors)
    used, asked = words.select("word").distinct(), keywords.select("word").distinct()
    own, keys = used.join(fine, "word"), scratch(asked.join(fine, "word"))
    near = simjoin.against_few(own, keys)
    if near is None:
        near = simjoin.over(own, keys, -2.0 if least is None else least)[0]
    near = near.where(F.col("word") != F.col("keyword"))
    if least is not None:
        near = near.where(F.col("sim") > least)
    same = used.join(small(asked), "word").select("word", F.col("word").alias("keyword"), F.lit(1.0).alias("sim"))
    return near.unionByName(same)


def best_per_keyword(matched: DataFrame, tokens: DataFrame, optionals: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, pid, keyword, n_optional, best): the best similarity of any token to each of the profile's keywords, 0 at least."""
    keys = matched.join(small(optionals.select("pid", F.col("word").alias("keyword"), "n_optional")), "pid")
    sims = tokens.join(small(pairs), "word").groupBy(key, "keyword").agg(F.max("sim").alias("sim"))
    return keys.join(sims, [key, "keyword"], "left").select(key, "pid", "keyword", "n_optional", F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)).alias("best"))


def best_sums(tokens: DataFrame, optionals: DataFrame, vectors: DataFrame, key: str, cut: float) -> DataFrame | None:
    """(key, pid, total, met): the sum of best_per_keyword's best over a profile's keywords, and how many are over the cut. A text's
    tokens are multiplied with all keywords and only their best is kept, so no pair is a row. None if the keywords are too many for
    a broadcast, or words have several vectors."""
    own = scratch(optionals.select("pid", "word").join(simjoin.usable(vectors), "word", "left").select("pid", "word", "vec"))
    size = own.agg(F.count("*"), F.max(F.size("vec"))).first()
    if size[0] * (size[1] or 1) * 8 > simjoin.BROADCAST_BYTES or size[0] != optionals.count():
        return None
    got = own.orderBy("pid", "word").toArrow().combine_chunks()
    pids, starts = np.unique(got.column("pid").to_numpy(), return_index=True)
    places: dict = {}
    for i, w in enumerate(got.column("word").to_pylist()):
        places.setdefault(w, []).append(i)
    shared = tokens.sparkSession.sparkContext.broadcast((pids, starts, places, simjoin.units_or_zero(got.column("vec").combine_chunks(), size[1] or 1)))
    kinds = tokens.schema[key].dataType.simpleString(), optionals.schema["pid"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        pids, starts, places, units = shared.value
        step = max(1, (1 << 20) // max(len(units), 1))
        last, held = None, None  # the text that may go on in the next piece

        def table(texts, best, kind):
            add = lambda x: np.add.reduceat(x, starts, axis=1).ravel()
            at = np.repeat(np.arange(len(texts)), len(pids))
            return pa.RecordBatch.from_arrays([pa.array(texts, kind).take(pa.array(at)), pa.array(np.tile(pids, len(texts))), pa.array(add(best)), pa.array(add((best > cut).astype(np.int64)))], [key, "pid", "total", "met"])

        for b in batches:
            for at in range(0, b.num_rows if len(units) else 0, step):
                part = b.slice(at, step)
                kind, texts = part.schema.field(0).type, part.column(0).to_numpy(zero_copy_only=False)
                sims = np.maximum(simjoin.units_or_zero(part.column(2), units.shape[1]) @ units.T, 0.0)
                for i, w in enumerate(part.column(1).to_pylist()):
                    sims[i, places.get(w, ())] = 1.0
                first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
                texts, best = texts[first], np.maximum.reduceat(sims, first, axis=0)
                if held is not None and last == texts[0]:
                    best[0] = np.maximum(best[0], held)
                elif held is not None:
                    texts, best = np.concatenate([np.array([last], texts.dtype), texts]), np.concatenate([held[None], best])
                if len(texts) > 1:
                    yield table(texts[:-1], best[:-1], kind)
                last, held = texts[-1], best[-1].copy()
        if held is not None:
            yield table(np.array([last]), held[None], kind)

    rows = tokens.select(key, "word").join(simjoin.usable(vectors), "word", "left").select(key, "word", "vec")
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"`{key}` {kinds[0]}, pid {kinds[1]}, total double, met long")


def scores(matched: DataFrame, tokens: DataFrame, optionals: DataFrame, vectors: DataFrame, key: str, version: int = 1, cut: float = 0.5) -> DataFrame:
    """(key, pid, sim): score() of best_per_keyword() over all pairs of words and keywords; pairs are rows only where keywords are many."""
    sums = best_sums(tokens, optionals, vectors, key, cut)
    if sums is None:
        pairs = scratch(word_pairs(tokens, optionals, vectors))
        return score(best_per_keyword(matched, tokens, optionals, pairs, key), key, version, cut)
    sizes = small(optionals.groupBy("pid").agg(F.first("n_optional").alias("n_optional")))
    rows = matched.join(sizes, "pid").join(sums, [key, "pid"], "left")
    total, met, n = F.coalesce("total", F.lit(0.0)), F.coalesce("met", F.lit(0)), F.col("n_optional")
    form = {1: F.sqrt(F.try_divide(met, n)), 2: F.try_divide(total, n), 3: total}[version]
    return rows.select(key, "pid", F.coalesce(form, F.lit(0.0)).alias("sim"))


def score(best: DataFrame, key: str, version: int = 1, cut: float = 0.5) -> DataFrame:
    """(key, pid, sim). 1: root of the share of keywords met (above cut); 2: mean of the best; 3: their sum."""
    n, total = F.first("n_optional"), F.sum("best")
    met = F.sum(F.when(F.col("best") > cut, 1).otherwise(0))
    form = {1: F.sqrt(F.try_divide(met, n)), 2: F.try_divide(total, n), 3: total}[version]
    return best.groupBy(key, "pid").agg(F.coalesce(form, F.lit(0.0)).alias("sim"))


def final(sim: Column) -> Column:
    return sim / 2 + 0.5


def argmax(scores: DataFrame, key: str) -> DataFrame:
    """(key, pid, similarity): the best profile, the lowest on ties."""
    best = scores.groupBy(key).agg(F.max(F.struct("sim", (-F.col("pid")).alias("back"))).alias("best"))
    return best.select(key, (-F.col("best.back")).alias("pid"), final(F.col("best.sim")).alias("similarity"))


def exact_sim(met: Column, n_optional: Column, version: int = 1) -> Column:
    """score() where only equal words count: met of n_optional keywords are there."""
    return {1: F.sqrt(F.try_divide(met, n_optional)), 2: F.try_divide(met, n_optional), 3: met.cast("double")}[version]


def exact_score(matched: DataFrame, tokens: DataFrame, optionals: DataFrame, key: str) -> DataFrame:
    """Version 1 where only equal words count: no vectors are needed."""
    met = tokens.join(small(optionals.select("pid", "word")), "word").groupBy(key, "pid").agg(F.count("*").alias("met"))
    n = small(optionals.select("pid", "n_optional").distinct())
    return matched.join(n, "pid").join(met, [key, "pid"], "left").select(key, "pid", F.sqrt(F.coalesce("met", F.lit(0)) / F.col("n_optional")).alias("sim"))
