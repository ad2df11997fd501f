"""Word vectors trained in parts."""

import numpy as np
import pyarrow as pa

from skimmer.operators import skipgram


def vectors(df):
    return {r.word: np.array(r.vec) for r in df.collect()}


def topics(spark, n=3000):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, [f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 12, 20)]) for i in range(n)], "id long, words array<string>")


def test_words_of_one_topic_are_near(spark):
    for rounds in (1, 2):
        found = vectors(skipgram.word2vec(topics(spark), size=16, parts=3, rounds=rounds, key="id"))
        assert len(found) == 24
        unit = {w: v / np.linalg.norm(v) for w, v in found.items()}
        same = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] == b[0]]
        other = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[0] != b[0]]
        assert np.mean(same) > np.mean(other) + 0.3


def test_same_vectors_again(spark):
    one, two = (vectors(skipgram.word2vec(topics(spark, 300), size=8, parts=3, key="id")) for _ in range(2))
    assert set(one) == set(two) and all(np.allclose(one[w], two[w], rtol=0, atol=1e-12) for w in one)


def test_words_count_over_all_parts(spark):
    rows = [(i, ["often", None, "rare"] if i < 4 else ["often", "five"]) for i in range(9)] + [(9, None), (10, []), (11, [None])]
    for parts in (1, 40):
        found = vectors(skipgram.word2vec(spark.createDataFrame(rows, "id long, words array<string>"), size=4, parts=parts, key="id"))
        assert set(found) == {"often", "five"}
        assert all(np.isfinite(v).all() and np.linalg.norm(v) > 0 for v in found.values())
    assert vectors(skipgram.word2vec(spark.createDataFrame([], "id long, words array<string>"), size=4, key="id")) == {}


def test_one_word_stays_finite(spark):
    rows = spark.range(50).selectExpr("id", "array_repeat('a', 2000) AS words")
    found = vectors(skipgram.word2vec(rows, size=8, parts=2, key="id"))
    assert list(found) == ["a"] and 0 < np.linalg.norm(found["a"]) < 100


def test_parts_grow_with_the_text(spark, monkeypatch):
    texts = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    assert skipgram.pieces_of(texts) == 8
    monkeypatch.setattr(skipgram, "PIECE", 1000)
    assert skipgram.pieces_of(texts) == 100


def test_long_parts_are_cut(monkeypatch):
    """Eight fixed tasks trained all; now a task takes bounded pieces, which together have every word."""
    monkeypatch.setattr(skipgram, "PIECE_WORDS", 100)
    batches = [pa.record_batch({"part": pa.array([7] * 10), "words": pa.array([[f"w{i}", f"v{j}"] * 3 for j in range(10)])}) for i in range(20)]
    rows = [r for b in skipgram._coded(batches) for r in b.to_pylist()]
    pieces = {r["piece"] for r in rows}
    assert len(pieces) == 10 and {p >> 32 for p in pieces} == {7}
    assert sum(sum(r["counts"]) for r in rows if r["words"]) == sum(len(r["codes"]) // 4 for r in rows if r["codes"]) == 20 * 60


def test_a_batch_by_hand():
    """A batch moves vectors as a plain loop over its pairs does."""
    rng = np.random.default_rng(1)
    n, size = 32, 6
    ids, sentence = rng.permutation(n).astype(np.int32), np.repeat(np.arange(4, dtype=np.int32), 8)
    both = rng.normal(size=(n, 2 * size)).astype(np.float32)
    v, u, want = both[:, :size].astype(float), both[:, size:].astype(float), both.astype(float)
    for i in range(n):
        for j in (i - 1, i + 1):
            if 0 <= j < n and sentence[i] == sentence[j]:
                a, b = ids[i], ids[j]
                g = 0.025 * (1 - 1 / (1 + np.exp(-(v[a] @ u[b]))))
                want[a, :size] += g * u[b]
                want[b, size:] += g * v[a]
    skipgram._train(ids, sentence, np.ones(n), both, rng, 1, 0, 0.025, 0, 1)  # a window of one and no draws: nothing is random
    assert np.allclose(both, want, rtol=0, atol=1e-6)
