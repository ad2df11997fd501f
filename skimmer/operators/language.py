"""Language of a text from all of its substrings that a model weighs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.functions import text as X
from skimmer.functions.decode import html_entities
from skimmer.operators import trie
from skimmer.operators.match import small
from skimmer.scratch import scratch

LEAST_PROBABILITY = 0.6


def substrings(docs: DataFrame, key: str, text: Column, longest: int) -> DataFrame:
    """(key, ngram): all substrings of up to ``longest`` characters, repeats included, made in generated code."""
    rows = docs.select(key, X.characters(text).alias("chars"))
    rows = rows.select(key, "chars", F.posexplode_outer("chars").alias("at", "c")).where("c is not null")
    here = lambda k: F.concat(*(F.get("chars", F.col("at") + j) for j in range(k)))  # noqa: E731  null past the end
    return rows.select(key, F.explode(F.array(*(here(k) for k in range(1, longest + 1)))).alias("ngram")).where("ngram is not null")


def ngram_counts(docs: DataFrame, key: str, text: Column, longest: int, dictionary: DataFrame | None = None) -> DataFrame:
    """(key, ngram, n); with a dictionary only its n-grams, found by a walk of their trie: other substrings are never rows."""
    words = None if dictionary is None else trie.gathered(dictionary, "ngram")
    if words is not None:
        found = trie.pattern_rows(docs, key, text, trie.shared_patterns(docs.sparkSession, [w for w in words if len(w) <= longest]))
        return found.groupBy(key, F.col("word").alias("ngram")).agg(F.sum("n").alias("n"))
    rows = substrings(docs, key, text, longest)
    if dictionary is not None:
        rows = rows.join(small(dictionary.select("ngram").distinct(), 2_000_000), "ngram")
    return rows.groupBy(key, "ngram").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, lang, p): softmax of the summed weights, shifted by their maximum."""
    sums = counts.join(small(weights, 2_000_000), "ngram").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    over = Window.partitionBy(key)
    e = sums.withColumn("e", F.exp(F.col("s") - F.max("s").over(over)))
    return e.select(key, "lang", (F.col("e") / F.sum("e").over(over)).alias("p"))


def labels(p: DataFrame, key: str, least: float = LEAST_PROBABILITY) -> DataFrame:
    """(key, lang, p): the likeliest language; "" under the least probability."""
    best = p.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "lang"))).where("at = 1")
    return best.select(key, F.when(F.col("p") >= least, F.col("lang")).otherwise(F.lit("")).alias("lang"), "p")


#: Texts whose n-grams are counted together, in characters, about.
COUNTED = 1 << 20


def _counted(texts: list[str], longest: int):
    """(n-grams as arrays of code points, counts) of each length up to ``longest``, over all texts together: an n-gram of k characters is
    numbered by that of its first k - 1 and its last one, so numbers stay as small as what is there."""
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(codes))  # characters from here to the text's end
    letters, one = _numbered(codes.astype(np.int64))
    number, spelt = one, letters[:, None]
    for k in range(1, longest + 1):
        if k > 1:
            there = np.flatnonzero(left >= k)
            if not len(there):
                return
            pairs, small = _numbered(number[there] * len(letters) + one[there + k - 1])
            spelt = np.column_stack([spelt[pairs // len(letters)], letters[pairs % len(letters)]])
            number = np.zeros(len(codes), np.int64)
            number[there] = small
            yield spelt, np.bincount(small, minlength=len(pairs))
        else:
            yield spelt, np.bincount(one, minlength=len(letters))


def _numbered(values):
    """(distinct values in order, the number of each): through a table if they are dense, else sorted."""
    top = int(values.max()) + 1
    if top > 4 * COUNTED:
        return np.unique(values, return_inverse=True)
    there = np.bincount(values, minlength=top) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def corpus_counts(corpus: DataFrame, longest: int) -> DataFrame:
    """(ngram, lang, n) of texts (lang, text). Texts of a batch are counted together by language, so that rows are n-grams of a
    million characters and not places."""

    def run(batches):
        import pyarrow as pa

        def counts(lang, texts):
            for spelt, n in _counted(texts, longest):
                flat = spelt.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                k = spelt.shape[1]
                yield pa.record_batch({"ngram": [flat[i : i + k] for i in range(0, len(flat), k)], "lang": pa.array([lang] * len(n), pa.string()), "n": pa.array(n, pa.int64())})

        held: dict = {}
        size: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= COUNTED:
                        yield from counts(lang, held.pop(lang))
                        del size[lang]
        for lang, texts in held.items():
            yield from counts(lang, texts)

    return corpus.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "ngram string, lang string, n long").groupBy("ngram", "lang").agg(F.sum("n").alias("n"))


def train(corpus: DataFrame, longest: int = 3, smoothing: float = 0.5, least: int = 2, bodies: bool = False) -> DataFrame:
    """(ngram, lang, weight): log-probabilities of n-grams by language against their mean, from texts (lang, text). bodies: texts are as
    body_of() gives them already.

    Counts are written once, as the model asks for them several times; n-grams of fewer than ``least`` occurrences are left out."""
    corpus = corpus.select("lang", (F.col("text") if bodies else body_of(F.col("text"))).alias("text"))
    n = scratch(corpus_counts(corpus, longest))
    langs, by_lang = n.select("lang").distinct(), n.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = n.groupBy("ngram").agg(F.sum("n").alias("seen")).where(F.col("seen") >= least).select("ngram")
    grid = kept.join(F.broadcast(langs), how="cross")  # n-grams x a handful of languages: the model itself
    full = grid.join(n, ["ngram", "lang"], "left").join(F.broadcast(by_lang), "lang")
    logp = F.log((F.coalesce("n", F.lit(0)) + smoothing) / (F.col("total") + smoothing))
    mean = F.avg("l").over(Window.partitionBy("ngram"))
    return full.select("ngram", "lang", logp.alias("l")).select("ngram", "lang", (F.col("l") - mean).alias("weight"))


def label_of(text: Column, weights: DataFrame, least: float = LEAST_PROBABILITY, most: int = 2_000_000) -> Column:
    """struct<lang, p> of each text, as labels() of probabilities() give it, with no shuffle: on a stream, too. Null if the text holds
    no n-gram of the model. The model, up to ``most`` weights, goes to every worker as a trie and a matrix."""
    spark = weights.sparkSession
    table = weights.select("ngram", "lang", F.col("weight").cast("double").alias("weight")).where("ngram <> '' and lang is not null").limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError("a model of so many weights is joined: see probabilities()")
    ngrams, langs = table.column("ngram").to_pylist(), table.column("lang").to_pylist()
    names, words = sorted(set(langs)), sorted(set(ngrams))
    at, col = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(names)}
    matrix = np.zeros((len(words), len(names)))
    there = np.zeros((len(words), len(names)), bool)
    where = (np.array([at[w] for w in ngrams], int), np.array([col[x] for x in langs], int))
    np.add.at(matrix, where, table.column("weight").to_numpy())
    there[where] = True
    patterns, model = trie.shared_patterns(spark, words), spark.sparkContext.broadcast((names, matrix, there))

    @F.pandas_udf("lang string, p double")
    def run(texts):
        import pandas as pd

        names, matrix, there = model.value
        size = len(texts)
        sums, met = np.zeros((size, len(names) or 1)), np.zeros((size, len(names) or 1), bool)
        for row, pattern, n in trie.built(patterns).counted([t or "" for t in texts]):
            at, to = row[0], row[-1] + 1  # a text is in one piece
            for j in range(len(names)):
                sums[at:to, j] = np.bincount(row - at, matrix[pattern, j] * n, to - at)
                met[at:to, j] = np.bincount(row - at, there[pattern, j], to - at) > 0
        sums = np.where(met, sums, -np.inf)
        best = sums.argmax(axis=1)  # the first of equal ones, by name
        top = sums[np.arange(size), best]
        some = np.isfinite(top)
        p = 1 / np.exp(sums - np.where(some, top, 0)[:, None]).sum(axis=1, where=met, initial=1e-300)
        lang = [None if not s else names[b] if q >= least else "" for s, b, q in zip(some, best, p)]
        return pd.DataFrame({"lang": lang, "p": np.where(some, p, np.nan)})

    found = run(text)
    return F.when(found["lang"].isNotNull(), found)


def body_of(text: Column) -> Column:
    """What n-grams are taken from: entities decoded, normalised, with its bounds marked."""
    return X.with_bounds(X.normalise_language(html_entities(text)))


def identify(docs: DataFrame, key: str, text: str, weights: DataFrame, longest: int = 3, bodies: bool = False) -> DataFrame:
    """(key, lang, p); keys are unique. weights: as train() makes them, n-grams of up to longest. bodies: texts are as body_of() gives
    them already."""
    body = F.col(text) if bodies else body_of(F.col(text))
    rows = docs.select(key, label_of(body, weights.where(F.length("ngram") <= longest)).alias("__label"))
    return rows.where("`__label` is not null").select(key, "__label.lang", "__label.p")


def english(rows: DataFrame, text: str, weights: DataFrame) -> DataFrame:
    """The rows found to be English, batch or stream."""
    return rows.withColumn("__label", label_of(body_of(F.col(text)), weights)).where(F.col("__label")["lang"] == "en").drop("__label")


def english_lines(lines: DataFrame, key: str, text: str, weights: DataFrame, longest: int = 3) -> DataFrame:
    """The rows found to be English."""
    return english(lines, text, weights.where(F.length("ngram") <= longest))


def label_lists(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(label, ids): the keys of each label, in order."""
    return rows.groupBy(label).agg(F.sort_array(F.collect_list(key)).alias("ids"))
