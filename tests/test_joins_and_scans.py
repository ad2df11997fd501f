"""Similarity joins, running scans and decayed histories against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimmer.operators import push, scan, similarity, simjoin


def frame(spark, x, prefix="w"):
    return spark.createDataFrame([(f"{prefix}{i}", [float(c) for c in v]) for i, v in enumerate(x)], "word string, vec array<double>")


@pytest.mark.parametrize("least,block", [(0.9, 50), (0.3, 2048), (-2.0, 100)])
def test_join_over_a_cut_equals_all_pairs(spark, least, block):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    x = np.concatenate([m + 0.2 * rng.normal(size=(40, 8)) for m in middles] + [np.repeat(middles[:1], 30, axis=0)])
    y = np.concatenate([m + 0.2 * rng.normal(size=(20, 8)) for m in middles])
    found, met = simjoin.over(frame(spark, x), frame(spark, y, "k"), least, centres=12, block=block)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit(x) @ unit(y).T
    want = {(f"w{i}", f"k{j}") for i, j in zip(*np.nonzero(sims > least))}
    rows = found.collect()
    assert {(r.word, r.keyword) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.sim - sims[int(r.word[1:]), int(r.keyword[1:])]) < 1e-12 for r in rows)
    assert met["pairs"] == len(x) * len(y) and (met["met"] < met["pairs"] / 2 if least == 0.9 else True)


def test_join_of_odd_vectors(spark):
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [None, 1.0]), ("f", [2.0, 0.0])], "word string, vec array<double>")
    assert sorted((r.word, r.keyword) for r in simjoin.over(odd, odd, 0.5)[0].collect()) == [("a", "a"), ("a", "f"), ("f", "a"), ("f", "f")]
    assert simjoin.over(odd.limit(0), odd, 0.5)[0].collect() == [] and simjoin.over(odd, odd.limit(0), 0.5)[0].collect() == []


def test_few_and_many_keywords_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = frame(spark, rng.normal(size=(60, 5)))
    words, keys = v.select("word").unionByName(spark.createDataFrame([("no vector",)], "word string")), v.select("word").where("word < 'w2'")
    few = {(r.word, r.keyword): round(r.sim, 12) for r in similarity.word_pairs(words, keys, v).collect()}
    monkeypatch.setattr(simjoin.against_few, "__defaults__", (1,))
    many = {(r.word, r.keyword): round(r.sim, 12) for r in similarity.word_pairs(words, keys, v).collect()}
    assert few == many and len(few) == 60 * keys.count()


def test_running_scan_equals_a_loop_and_cuts_a_hot_key(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), 0 if rng.random() < 0.9 else int(rng.integers(1, 4)), None if rng.random() < 0.05 else float(rng.normal()), bool(rng.random() < 0.4)) for i in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "seq long, pid int, sim double, pushed boolean")
    got = {r.seq: (r.received, r.n_pushed) for r in push.counters(df).collect()}
    tops = {r.seq: r.top for r in scan.running(df, ["pid"], "seq", maxima={"top": F.col("sim")}, before=True).collect()}
    seen: dict = {}
    for seq, pid, sim, pushed in sorted(rows):
        n, k, top = seen.get(pid, (0, 0, None))
        assert tops[seq] == top
        seen[pid] = (n + 1, k + pushed, top if sim is None else sim if top is None else max(top, sim))
        assert got[seq] == seen[pid][:2]
    sizes = [r["count"] for r in df.where("pid = 0").withColumn("b", scan.cut(df, "seq")).groupBy("b").count().collect()]
    assert len(sizes) == scan.BLOCKS and max(sizes) < 3 * sum(sizes) / scan.BLOCKS
    assert scan.running(df.limit(0), ["pid"], "seq", sums={"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("cuts", [[], [1], [2, 3], [1, 2, 5, 9]])
def test_days_merged_equal_the_whole(spark, cuts):
    from skimmer.operators import history

    rng = np.random.default_rng(6)
    rows = [(p, f"{d:02d}", float(rng.random())) for p in range(4) for d in range(1 if p == 0 else 12) if p < 3 or d > 4]
    stats = spark.createDataFrame(rows, "pid int, day string, rank_score double")
    want = {r.pid: round(r.threshold, 12) for r in history.thresholds(stats).collect()}
    kept = None
    for low, high in zip([0, *cuts], [*cuts, 99]):
        new = history.decayed(stats.where(F.col("day").cast("int").between(low, high - 1)), "rank_score")
        kept = new if kept is None else history.merged(kept, new)
    assert {r.pid: round(r.threshold, 12) for r in history.forecasts(kept).collect()} == want
    assert history.forecasts(history.decayed(stats.limit(0), "rank_score")).collect() == []


def test_sums_of_the_best_without_a_row_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = frame(spark, rng.normal(size=(60, 5))).unionByName(spark.createDataFrame([("none", None), ("zero", [0.0] * 5)], "word string, vec array<double>"))
    names = [f"w{i}" for i in range(60)] + ["none", "zero", "unknown"]
    tokens = spark.createDataFrame(sorted({(i // 9, names[int(j)]) for i, j in enumerate(rng.integers(0, 63, 300))} | {(40, n) for n in names}), "t int, word string")
    opts = spark.createDataFrame([(p, w, 4) for p, ws in ((0, ["w1", "none", "w5", "unknown"]), (3, ["w1", "w2", "zero", "w9"])) for w in ws], "pid int, word string, n_optional int")
    met = spark.createDataFrame([(t, p) for t in (*range(30), 40, 99) for p in (0, 3, 7)], "t int, pid int")
    found = lambda version: {(r.t, r.pid): round(r.sim, 9) for r in similarity.scores(met, tokens, opts, v, "t", version, 0.4).collect()}
    pairs = similarity.word_pairs(tokens, opts, v)
    want = [{(r.t, r.pid): round(r.sim, 9) for r in similarity.score(similarity.best_per_keyword(met, tokens, opts, pairs, "t"), "t", x, 0.4).collect()} for x in (1, 2, 3)]
    whole = similarity.word_pairs
    monkeypatch.setattr(similarity, "word_pairs", None)
    assert [found(x) for x in (1, 2, 3)] == want and len(want[0]) == 64
    monkeypatch.setattr(similarity, "word_pairs", whole)
    monkeypatch.setattr(simjoin, "BROADCAST_BYTES", 10)
    assert found(2) == want[1]


def test_visits_are_copied_a_few_rows_at_a_time(spark, monkeypatch):
    from pyspark import AccumulatorParam

    class Most(AccumulatorParam):  # of the largest batch that goes out
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    sizes = spark.sparkContext.accumulator(0, Most())
    rng = np.random.default_rng(9)
    v = frame(spark, rng.normal(size=(1500, 4))).coalesce(1)
    whole = type(v).mapInArrow

    def watched(self, f, schema, *more):
        def run(batches):
            for b in f(batches):
                sizes.add(b.num_rows if "home" in b.schema.names and "angle" not in b.schema.names else 0)
                yield b

        return whole(self, run, schema, *more)

    monkeypatch.setattr(type(v), "mapInArrow", watched)
    assert simjoin.over(v, v, -0.5, centres=16)[0].count() > 0
    assert 0 < sizes.value <= 256 * 16
