"""The trained tagger against all sequences of tags, and its counts against a loop."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimmer.operators import tagger
from skimmer.operators.tagger import Tagger


def best_of_all(m, words):
    def value(p):
        return sum((m.start[t] if i == 0 else m.follow[p[i - 1], t]) + m.spelled(w)[t] for i, (w, t) in enumerate(zip(words, p)))

    return [m.tags[t] for t in max(itertools.product(range(len(m.tags)), repeat=len(words)), key=value)]


@pytest.mark.parametrize("seed", range(3))
def test_tags_are_the_best_of_all(seed):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    random_log = lambda *shape: np.log(rng.dirichlet(np.ones(3), *shape))
    m = Tagger(["DT", "NN", "VB"], random_log(), random_log(3), {w: random_log() for w in "abcd"}, {"x": random_log()}, np.log(np.ones(3) / 9))
    texts = [[r.choice(["a", "b", "c", "d", "yx", "q"]) for _ in range(r.randrange(7))] for _ in range(50)]
    assert m.tag(texts) == [best_of_all(m, t) for t in texts]
    assert m.tag([]) == [] and m.tag([[], []]) == [[], []]


def test_training_and_the_filter(spark, monkeypatch):
    sentences = [["the/DT", "old/JJ", "cat/NN", "runs/VB"], ["the/DT", "dog/NN", "sleeps/VB", "quietly/RB"], ["a/DT", "bird/NN", "sings/VB"]] * 3
    rows = [(i, k, *x.split("/")) for i, s in enumerate(sentences) for k, x in enumerate(s)]
    table = spark.createDataFrame(rows + [(99, 0, None, "NN"), (98, None, "x", "NN")], "sentence long, at int, word string, tag string")
    m = Tagger.train(table)
    assert m.tags == ["DT", "JJ", "NN", "RB", "VB"] and np.exp(m.follow).sum(axis=1) == pytest.approx(np.ones(5)) and np.exp(m.start).sum() == pytest.approx(1)
    assert m.follow[0, 2] == pytest.approx(np.log((6 + 0.1) / (9 + 0.5)))
    df = spark.createDataFrame([(1, ["the", "cat", "walks", "quietly"]), (2, []), (3, None)], "k int, w array<string>")
    want = {1: ["cat", "walks"], 2: [], 3: None}
    assert {r.k: r.o for r in df.select("k", m.keep(F.col("w")).alias("o")).collect()} == want
    monkeypatch.setattr(tagger, "PIECE", 2)
    assert len(m.tag([["the", "cat"]])[0]) == 2
    none = Tagger.train(table.limit(0))
    assert {r.k: r.o for r in df.select("k", none.keep(F.col("w")).alias("o")).collect()} == {1: [], 2: [], 3: None}
    with pytest.raises(ValueError, match="too many"):
        Tagger.train(table, most_rows=3)


def test_a_large_model_stays_a_table_and_tags_alike(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
    table = spark.createDataFrame([(i, k, word(), r.choice(["DT", "NN", "VB"])) for i in range(60) for k in range(9)], "sentence long, at int, word string, tag string")
    texts = [(i, None if i % 11 == 0 else [r.choice([word(), word() + "d", "xyz"]) for _ in range(i % 13)]) for i in range(150)]
    df = spark.createDataFrame(texts, "k long, w array<string>")
    monkeypatch.setattr(tagger, "BLOCK_BITS", 4)
    want = {x.k: x.kept for x in tagger.filtered(df, "k", "w", table).collect()}
    assert want == {x.k: x.kept for x in df.select("k", Tagger.train(table).keep(F.col("w")).alias("kept")).collect()}
    got = [(x.k, x.kept) for x in tagger.filtered(df, "k", "w", table, most_rows=3).collect()]
    assert len(got) == 150 and dict(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_words_that_decide_themselves_part_a_text(seed, monkeypatch):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    random_log = lambda *shape: np.log(rng.dirichlet(np.ones(3), *shape))
    sure = {w: np.where(np.arange(3) == i, 0.0, -60.0) for i, w in enumerate("xyz")}
    m = Tagger(["DT", "NN", "VB"], random_log(), random_log(3), {w: random_log() for w in "ab"} | sure, {}, np.log(np.ones(3) / 9))
    assert m.decided(np.stack([sure[w] for w in "xyz"])).tolist() == [0, 1, 2] and (m.decided(np.zeros((1, 3))) == -1).all()
    texts = [[r.choice("abqxyz") for _ in range(r.randrange(8))] for _ in range(80)]
    steps, runs = [], Tagger._runs
    monkeypatch.setattr(Tagger, "_runs", lambda self, first, last, *more: (steps.append(int((last - first).max())), runs(self, first, last, *more))[1])
    assert m.tag(texts) == [best_of_all(m, t) for t in texts]
    assert m.tag([list("xyz") * 50_000]) == [["DT", "NN", "VB"] * 50_000]  # no step a word
    assert len(steps) == 1 and steps[0] <= 7


def test_tags_before_may_be_given(spark):
    rows = [(i, k, w, t) for i in range(5) for k, (w, t) in enumerate([("a", "DT"), ("b", "NN"), ("c", "VB")][: 1 + i % 3])]
    table = spark.createDataFrame(rows, "sentence long, at int, word string, tag string")
    given = spark.createDataFrame([(*x, rows[j - 1][3] if x[1] else None) for j, x in enumerate(rows)], "sentence long, at int, word string, tag string, before string")
    got = tagger._counts(given)[0]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, tagger._counts(table)[0].collect()))
