"""From texts to profiles: token sets, candidates, and the division that tests every clause.

Profiles are a few hundred rows; their tables are broadcast behind a check of their size, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimmer.functions import text as X

#: Rows up to which a profile table is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; counting stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gated(docs: DataFrame, text: str = "text", lang: str | None = "lang", least_ratio: float = 0.7) -> DataFrame:
    """Non-empty texts in English that are clean enough; the cheap tests stand first."""
    kept = docs.where((F.col(text) != "") & F.col(text).isNotNull())
    if lang:
        kept = kept.where(F.col(lang) == "en")
    return kept.where(X.clean_ratio(F.col(text)) >= least_ratio)


def token_set(text: Column, multigrams: list[str] = (), stopwords=X.STOPWORDS, tagger=None, unicode: bool = True) -> Column:
    """Distinct tokens but stop words, and the multi-word keywords that the text contains. tagger: array<string> ->
    array<boolean> of the words to keep (nouns, adjectives, verbs); without one all are kept."""
    stripped = X.strip_marks(text)
    words = X.without_stopwords(X.tokens(stripped, unicode), stopwords)
    if tagger is not None:
        words = tagger(words)
    words = F.array_distinct(words)
    if multigrams:
        words = F.array_union(words, X.contained(stripped, F.array(*map(F.lit, multigrams))))
    return words


def tokens_of(docs: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """(key, word), distinct by construction: no shuffle."""
    return docs.select(key, F.explode(token_set(F.col(text), **how)).alias("word"))


def candidates(tokens: DataFrame, requirements: DataFrame, key: str) -> DataFrame:
    """(key, pid) with any required word in common."""
    return tokens.join(small(requirements.select("pid", "word").distinct()), "word").select(key, "pid").distinct()


def matches(tokens: DataFrame, requirements: DataFrame, n_clauses: DataFrame, key: str) -> DataFrame:
    """(key, pid) whose every clause has a word among the tokens: relational division, candidates and test in one pass."""
    hit = tokens.join(small(requirements), "word").groupBy(key, "pid").agg(F.countDistinct("clause").alias("hit"))
    return hit.join(small(n_clauses.select("pid", "n_clauses")), "pid").where("hit = n_clauses").select(key, "pid")


def scored_matches(tokens: DataFrame, compiled: DataFrame, key: str, optionals: DataFrame | None = None) -> DataFrame:
    """(key, pid, met, n_optional) of matches(), with the number of the profile's optional words that the text holds: one join and
    one aggregate over the tokens. optionals: (pid, optional) where other words than compiled's count, such as expanded ones."""
    own = compiled.select("pid", "optional") if optionals is None else optionals.select("pid", "optional")
    asked = compiled.select("pid", F.posexplode("clauses").alias("clause", "words")).select("pid", "clause", F.explode("words").alias("word"))
    words = asked.unionByName(own.select("pid", F.lit(None).cast("int").alias("clause"), F.explode("optional").alias("word")))
    sizes = compiled.select("pid", "n_clauses").join(own.select("pid", F.size("optional").alias("n_optional")), "pid")
    hit = tokens.join(small(words), "word").groupBy(key, "pid").agg(F.size(F.collect_set("clause")).alias("hit"), F.count_if(F.col("clause").isNull()).alias("met"))
    return hit.join(small(sizes), "pid").where("hit = n_clauses").select(key, "pid", "met", "n_optional")


def matches_by_arrays(docs: DataFrame, compiled: DataFrame, key: str, words: Column) -> DataFrame:
    """The same by array tests; for few profiles, where no shuffle at all is wanted."""
    rows = docs.select(key, words.alias("words")).join(small(compiled.select("pid", "clauses", F.flatten("clauses").alias("any"))), F.arrays_overlap("words", "any"))
    return rows.where(F.forall("clauses", lambda c: F.arrays_overlap(c, F.col("words")))).select(key, "pid")


class Index:
    """Compiled profiles as look-up tables of a task: a text's words to its best profile, row by row. It is what matches(),
    exact_score() and argmax() give, with no shuffle, for streams."""

    def __init__(self, compiled: DataFrame, most: int = 100_000):
        rows = compiled.select("pid", "optional", "clauses").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("so many profiles are joined: see matches()")
        self.shared = compiled.sparkSession.sparkContext.broadcast([(r.pid, list(r.optional), [list(c) for c in r.clauses]) for r in rows])

    def best(self, words: Column) -> Column:
        """struct<pid, similarity>, null if no profile is met."""
        shared = self.shared

        @F.pandas_udf("pid int, similarity double")
        def run(texts):
            import pandas as pd

            asked, n, own = _tables(shared)
            out = []
            for text in texts:
                met: dict = {}
                for w in () if text is None else text:
                    for pid, clause in asked.get(w, ()):
                        met.setdefault(pid, set()).add(clause)
                found = [(-((sum(o in text for o in own[pid]) / len(own[pid])) ** 0.5), pid) for pid, hit in met.items() if len(hit) == n[pid]]
                out.append((min(found)[1], -min(found)[0] / 2 + 0.5) if found else (None, None))
            return pd.DataFrame(out, columns=["pid", "similarity"]).astype({"pid": "Int32", "similarity": "Float64"})

        found = run(words)
        return F.when(found["pid"].isNotNull(), found)


_indices: dict = {}


def _tables(shared):
    """({word: [(pid, clause)]}, {pid: number of clauses}, {pid: its optional words}), made once a worker."""
    if id(shared.value) not in _indices:
        asked: dict = {}
        for pid, _, clauses in shared.value:
            for i, c in enumerate(clauses):
                for w in c:
                    asked.setdefault(w, []).append((pid, i))
        _indices.clear()
        _indices[id(shared.value)] = shared.value, (asked, {pid: len(c) for pid, _, c in shared.value}, {pid: o for pid, o, _ in shared.value})
    return _indices[id(shared.value)][1]
