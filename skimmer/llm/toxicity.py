"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings. The model has one weight per chosen feature, shared by all thresholds, and
one threshold per grade step: P(grade > j) = logistic(w x - b_j); the sum over j is the expected severity. It is fitted on a
bounded sample of labelled rows (``sample`` rows of smallest hash of the id) and scores every row.

Labels may be grades of any number. Where they are 0 and 1 only, the labelled toxic rows are split at the median strength of
their toxic features (each counting 1 + log of its occurrences), into grade 1 (below) and grade 2. That split comes from the
features that also score: it orders texts by how much of the toxic vocabulary they hold, no more.

What bounds the model are parameters: ``sample`` labelled rows, ``most_features`` features, each in ``least_docs`` labelled rows
at least and ``least_z`` strong. Scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from skimmer.llm.common import WORD_TABLE, chunks, col, fresh, mix, scratch, table, word_hashes

BITS = 20
BEGINNINGS = (4, 5, 6)  # bytes of a word


@dataclass
class Model:
    features: np.ndarray  # buckets, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    toxic: np.ndarray  # of the features, those that point to toxic rows

    def over(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j), a row per score w x and a column per j."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -40, 40)))


def buckets(data: np.ndarray, offsets: np.ndarray):
    """(bucket, row) of each feature occurrence of a piece, and the number of words by row."""
    h, rows, starts, ends = word_hashes(data, offsets)
    all_h, all_rows, low = [h], [rows], WORD_TABLE[data]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        value = np.full(len(long), k, np.uint64)
        for j in range(k):
            value = value * np.uint64(257) + low[starts[long] + j]
        all_h.append(mix(value))
        all_rows.append(rows[long])
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    return (np.concatenate(all_h) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(all_rows), n_words


def counted(data: np.ndarray, offsets: np.ndarray, place: np.ndarray):
    """(row, feature index, count) of the chosen features of a piece, and words by row. place: index by bucket, else -1."""
    bucket, rows, n_words = buckets(data, offsets)
    at = place[bucket]
    keep = at >= 0
    pairs, count = np.unique(rows[keep] * (1 << 20) + at[keep], return_counts=True)
    return pairs >> 20, pairs & ((1 << 20) - 1), count, n_words


def fit_ordinal(rows, features, values, grades, n_features: int, ridge: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) by Adam on the mean cumulative-link loss; rows, features, values: a sparse matrix."""
    n, levels = len(grades), int(grades.max(initial=0))
    w, b = np.zeros(n_features), np.linspace(1.0, 2.0, max(levels, 1))
    y = (grades[:, None] > np.arange(len(b))[None, :]).astype(float)
    m, v = np.zeros(n_features + len(b)), np.zeros(n_features + len(b))
    for t in range(1, steps + 1):
        x = np.bincount(rows, w[features] * values, n)
        wrong = 1 / (1 + np.exp(-np.clip(x[:, None] - b[None, :], -40, 40))) - y
        g = np.concatenate([np.bincount(features, (wrong.sum(axis=1) / n)[rows] * values, n_features) + ridge * w, -wrong.mean(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:n_features], np.sort(b - move[n_features:])
    return w, b


def train(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic", sample: int = 20_000, most_features: int = 4096, least_docs: int = 4, least_z: float = 4.0) -> Model | None:
    """None when nothing can be learned: no labelled row, one class only, or no feature that tells. labels: (doc_id, label);
    of a doc_id's labels the largest counts; null ids and labels are no labels; null texts are empty."""
    spark = docs.sparkSession
    rated = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("grade"))
    rated = rated.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # a bounded sample: small enough to broadcast
    rows = scratch(docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(rated), "__id").select("grade", "text"))

    def count(batches):
        import pyarrow as pa

        seen = np.zeros((1 << BITS, 2), np.int32)
        for batch in batches:
            grade = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(1)):
                bucket, row, _ = buckets(data, offsets)
                pair = np.unique(row * (1 << BITS) + bucket)
                toxic = grade[first + (pair >> BITS)] > 0
                bucket = pair & ((1 << BITS) - 1)
                seen[:, 0] += np.bincount(bucket, minlength=1 << BITS).astype(np.int32)
                seen[:, 1] += np.bincount(bucket[toxic], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(seen[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some, 0]), pa.array(seen[some, 1])], ["bucket", "n", "a"])

    totals = rows.agg(F.count("*"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0))).first()
    n, bad = totals[0], totals[1] or 0
    if not 0 < bad < n:
        return None
    # Chosen: the buckets that tell most about the label, by the signed root of a chi-square statistic, damped so that
    # a rare bucket can't pass by chance.
    df = rows.mapInArrow(count, "bucket int, n int, a int").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where(F.col("n") >= least_docs)
    expect = F.col("n") * F.lit(bad / n)
    z = (F.col("a") - expect) / F.sqrt(expect * F.lit(1 - bad / n) + 1)
    best = df.select("bucket", z.alias("z"), "n", "a").where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "bucket").limit(most_features).collect()
    if not best:
        return None
    best = sorted(best, key=lambda r: r.bucket)
    features = np.array([r.bucket for r in best], np.int64)
    toxic = np.array([r.a > 0.5 * r.n for r in best], bool)
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(features))
    shared = spark.sparkContext.broadcast((place, toxic))

    def pick(batches):
        import pyarrow as pa

        place, toxic = shared.value
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                row, at, count, _ = counted(data, offsets, place)
                k = len(offsets) - 1
                cut = np.searchsorted(row, np.arange(k + 1))
                share = np.bincount(row, toxic[at] * (1 + np.log(count)), k).astype(float)  # of no feature at all: whole numbers
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (at, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k), *lists, pa.array(share)], ["grade", "at", "count", "share"])

    got = rows.mapInArrow(pick, "grade int, at array<int>, count array<int>, share double").toArrow().to_pandas()
    grades, share = got["grade"].to_numpy(), got["share"].to_numpy()
    if grades.max(initial=0) == 1:
        grades = grades + ((grades > 0) & (share >= np.median(share[grades > 0])))
    sizes = got["at"].map(len).to_numpy()
    flat = lambda c: np.concatenate([*got[c], np.zeros(0, np.int32)]).astype(np.int64)
    w, b = fit_ordinal(np.repeat(np.arange(len(got)), sizes), flat("at"), 1 + np.log(flat("count")), grades, max(len(features), 1))
    return Model(features, w[: len(features)], b, toxic)


def score(docs: DataFrame, model: Model | None, doc_id="doc_id", text="text", names: tuple[str, str, str] = ("__severity", "__p_toxic", "__grade")) -> DataFrame:
    """Row columns of docs, and severity, P(toxic) and grade under ``names``, which docs must not have.

    Null and empty texts have no features and get the model's base severity; without a model severity and grade are zero;
    repeated rows get equal rows; an empty table gives none."""
    spark = docs.sparkSession
    if set(fresh(docs, *names)) != set(names):
        raise ValueError(f"docs has a column of {names}")
    if model is None or not len(model.features):
        return docs.withColumns(dict(zip(names, (F.lit(0.0), F.lit(0.0), F.lit(0)))))
    place = np.full(1 << BITS, -1, np.int32)
    place[model.features] = np.arange(len(model.features))
    shared = spark.sparkContext.broadcast((model, place))
    at_text = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], DoubleType()), StructField(names[2], IntegerType())])

    def run(batches):
        import pyarrow as pa

        model, place = shared.value
        for batch in batches:
            x = np.zeros(batch.num_rows)
            for first, data, offsets in chunks(batch.column(at_text)):
                row, at, count, _ = counted(data, offsets, place)
                x[first : first + len(offsets) - 1] = np.bincount(row, model.weights[at] * (1 + np.log(count)), len(offsets) - 1)
            over = model.over(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array((over >= 0.5).sum(axis=1).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model | None, doc_id="doc_id", text="text") -> DataFrame:
    """docs without the rows of grade 1 or more; all columns stay."""
    names = fresh(docs, "__severity", "__p_toxic", "__grade")
    return score(docs, model, doc_id, text, tuple(names)).where(col(names[2]) == 0).drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), names=("severity", "p_toxic", "grade"))
    return found.select("doc_id", "severity", "p_toxic", "grade", (F.col("grade") > 0).alias("toxic"))
