"""The trie against plain searches, and what is built on it."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skimmer.operators import language, trie
from skimmer.operators.trie import Trie


def places(patterns, texts):
    return sorted((i, m.start(), p) for i, x in enumerate(texts) for p in set(patterns) - {""} for m in re.finditer(f"(?={re.escape(p)})", x))


def walked(patterns, texts):
    t = Trie(patterns)
    return sorted((int(r), int(s), t.patterns[p]) for part in t.walk(texts) for r, s, p in zip(*part))


@pytest.mark.parametrize("seed", range(4))
def test_walk_finds_all_places(seed):
    rng = random.Random(seed)
    letters = "abé漢😀\n"
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    patterns, texts = [word(7) for _ in range(80)], [word(90) for _ in range(60)] + ["", ""]
    assert walked(patterns, texts) == places(patterns, texts)
    assert walked([], texts) == walked([""], texts) == walked(patterns, []) == walked(patterns, [""]) == []


def test_walk_without_tables(monkeypatch):
    monkeypatch.setattr(trie, "DENSE", 0)
    patterns, texts = ["ab", "abc", "bc", "c", "zz"], ["abcabc", "zzz", "xy", "cab"]
    assert walked(patterns, texts) == places(patterns, texts)


def test_many_patterns_in_linear_time():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    t = Trie([word(rng.randrange(4, 20)) for _ in range(100_000)])
    text = word(400_000)

    def took(n):
        began = time.process_time()
        for _ in t.walk([text[:n]]):
            pass
        return time.process_time() - began

    took(100_000)
    assert min(took(400_000) for _ in range(3)) < 12 * max(min(took(100_000) for _ in range(3)), 1e-3)
    same = Trie(["a" * k for k in range(1, 30)])  # all lengths at all places
    assert sum(len(p[0]) for p in same.walk(["a" * 1000])) == sum(1000 - k + 1 for k in range(1, 30))


def test_columns_and_rows(spark):
    rows = [(1, "abab"), (2, None), (3, ""), (4, "xx")]
    df, patterns = spark.createDataFrame(rows, "k long, t string"), trie.shared_patterns(spark, ["ab", "b", "ab", ""])
    got = {r.k: r.o if r.o is None else [tuple(x) for x in r.o] for r in df.select("k", trie.occurrences(F.col("t"), patterns).alias("o")).collect()}
    assert got == {1: [("ab", 0, 2), ("b", 1, 2), ("ab", 2, 4), ("b", 3, 4)], 2: None, 3: [], 4: []}
    assert {r.k: r.c for r in df.select("k", trie.contained(F.col("t"), patterns).alias("c")).collect()} == {1: ["ab", "b"], 2: None, 3: [], 4: []}
    assert sorted(map(tuple, trie.pattern_rows(df, "k", F.col("t"), patterns).collect())) == [(1, "ab", 2), (1, "b", 2)]
    assert sorted(map(tuple, trie.place_rows(df, "k", F.col("t"), patterns).collect())) == [(1, "ab", 0, 2), (1, "ab", 2, 4), (1, "b", 1, 2), (1, "b", 3, 4)]
    assert trie.gathered(df, "t", most=2) is None and sorted(trie.gathered(df, "t")) == ["", "abab", "xx"]


def test_label_of_equals_the_joined_form(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    weights = [(g, lang, rng.choice([-1.0, 0.5, 0.25, 1.0])) for g in ("a", "ab", "bc", "d ", "cab") for lang in ("x", "y", "z") if rng.random() < 0.8] + [("a", "x", 0.5)]
    w = spark.createDataFrame(weights, "ngram string, lang string, weight double")
    want = language.labels(language.probabilities(language.ngram_counts(docs, "k", F.col("t"), 3, w), w, "k"), "k").collect()
    got = docs.select("k", language.label_of(F.col("t"), w).alias("f")).where("f is not null").select("k", "f.lang", "f.p").collect()
    assert {(r.k, r.lang, round(r.p, 9)) for r in got} == {(r.k, r.lang, round(r.p, 9)) for r in want} and len(got) == len(want)
    with pytest.raises(ValueError, match="so many"):
        language.label_of(F.col("t"), w, most=3)


def test_identify_decodes_entities(spark):
    corpus = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "été à la forêt")] * 5, "lang string, text string")
    model = language.train(corpus, 2)
    lines = spark.createDataFrame([(1, "&eacute;t&eacute; &#224; la for&ecirc;t"), (2, "the dog")], "k int, t string")
    assert {r.k: r.lang for r in language.identify(lines, "k", "t", model, 2).collect()} == {1: "fr", 2: "en"}
    assert [r.k for r in language.english(lines, "t", model).collect()] == [2]


def test_tries_of_other_patterns_are_not_mixed_up():
    class Shared:
        def __init__(self, value):
            self.value = value

    for i in range(50):  # lists come and go, as broadcasts do in a worker
        assert trie.built(Shared([f"p{i}", f"q{i}"])).patterns == [f"p{i}", f"q{i}"]
    kept = Shared(["a"])
    assert trie.built(kept) is trie.built(kept)


def test_places_of_a_batch_are_not_held_together(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(trie, "PIECE", 1 << 12)
    t, peaks = trie.Trie(["a", "aa", "b"]), []
    for n in (40, 400):
        tracemalloc.start()
        row, pattern, many = t.counts(["a" * 1000] * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert row.tolist() == [i for i in range(n) for _ in range(2)] and pattern.tolist() == [0, 1] * n and many.tolist() == [1000, 999] * n
    assert peaks[1] < 2 * peaks[0]


def test_corpus_counts_equal_those_of_substrings(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice(["en", "fr", None]), r.choice([None, "", "".join(r.choice("ab\u0001é𝒳 ") for _ in range(r.randrange(30)))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = language.substrings(df, "lang", F.col("text"), 3).groupBy("ngram", "lang").count()
    for counted in (1 << 20, 7):
        monkeypatch.setattr(language, "COUNTED", counted)
        assert sorted(map(str, language.corpus_counts(df, 3).collect())) == sorted(str(x).replace("count=", "n=") for x in want.collect())


def test_a_corpus_is_normalised_once_for_training(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([("en", "a b"), ("fr", "c d")] * 3, "lang string, text string")
    model = language.train(rows.select("lang", counted("text").alias("text")), 2, least=1)
    assert model.count() > 0 and seen.value == 6
