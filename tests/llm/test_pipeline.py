"""The pipeline's stages on a small corpus with planted cases, and the query's contract columns."""

import random

import pytest

import corpus_pipeline
from skimmer.llm import queries

WORDS = "river stone amber cloud maple harbor lantern meadow copper willow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghij") for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(11), tmp_path_factory.mktemp("sf")
    bench = [(i, prose(rng, 30)) for i in range(3)]
    texts = [prose(rng, 80) for _ in range(120)]
    rows = [(i, t + (" vile loathsome vile" if i % 4 == 0 else ""), "en", f"s{i % 5}", 1) for i, t in enumerate(texts)]
    rows += [(200, texts[1], "en", "s1", 1), (201, texts[2] + " end", "en", "s1", 1)]  # copies
    rows += [(210, bench[0][1] + " " + prose(rng, 60), "en", "s2", 1), (211, prose(rng, 10) + " password=abcdEFGH1234", "en", "s3", 1)]
    rows += [(220, None, "en", "s1", None), (221, "", None, None, 0), (None, prose(rng, 20), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs, seen = corpus_pipeline.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.scratch(stage(spark, docs, folder))
        assert after.columns == docs.columns
        docs = after
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i in range(120) if i % 4}
    toxic, dedup, bench, secret = seen.values()
    assert set(toxic) == clean | {200, 201, 210, 211, 220, 221, None}
    assert set(dedup) == clean | {210, 211, 220, None}  # the two texts without words are alike
    assert set(bench) == set(dedup) - {210}
    assert secret[211].endswith("password=[SECRET]") and all(secret[i] == toxic[i] for i in clean)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == set(secret) and all(r.exact for r in last)


def test_stages_take_an_empty_table(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch(stage(spark, docs, folder))
        assert docs.count() == 0


def test_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_stages_on_odd_tables(spark, tmp_path, toxic):
    """Labels of one class, repeated ids with other texts, nulls in every column, and columns that operators also use."""
    rng = random.Random(17)
    own = "password=" + "Q" * 12
    rows = [(1, prose(rng, 40)), (1, prose(rng, 40)), (1, None), (2, f"é {own}"), (2, f"é {own}"), (None, None), (3, "")]
    rows = [(*r, None if i % 2 else "en", None if i % 3 else "s", None, "a", "b", "c", "d", "e", 1, 2) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, __hash string, __cut string, __grade string, __spans string, found int, root int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, toxic), (2, 0, toxic), (3, None, toxic), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "x y"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.scratch(stage(spark, docs, str(tmp_path)))
        assert after.columns == docs.columns
        docs = after
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str)
    assert got == sorted([(1, rows[0][1], None), (1, rows[1][1], None), (1, None, None), (2, "é password=[SECRET]", 19), (None, None, None)], key=str)
    assert all(r.exact for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
