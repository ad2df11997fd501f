"""Keyword expressions as relations.

"a || b && c" is read as (a or b) and c: alternatives bind tighter than the conjunction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _trimmed(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))


def clauses(required: Column) -> Column:
    """array<array<string>>: clauses of alternatives, lower case; an empty alternative can't match and is left out."""
    parts = F.split(F.lower(required), "&&")
    return F.transform(parts, lambda c: F.filter(F.array_distinct(_trimmed(F.split(c, r"\|\|"))), lambda w: w != ""))


def optional_words(optional: Column) -> Column:
    """Distinct optional keywords, split at tabs or ||; an empty expression is the one empty keyword."""
    return F.array_distinct(_trimmed(F.split(F.lower(optional), r"\t|\|\|")))


def compiled(keywords: DataFrame) -> DataFrame:
    """(pid, optional, clauses, n_clauses, all_words, multigrams)."""
    df = keywords.select("pid", optional_words(F.col("optional")).alias("optional"), clauses(F.col("required")).alias("clauses"))
    every = F.array_union("optional", F.array_distinct(F.flatten("clauses")))
    return df.select("pid", "optional", "clauses", F.size("clauses").alias("n_clauses"), every.alias("all_words"), F.filter(every, lambda w: F.contains(w, F.lit(" "))).alias("multigrams"))


def requirements(compiled: DataFrame) -> DataFrame:
    """(pid, clause, word)."""
    return compiled.select("pid", F.posexplode("clauses").alias("clause", "words")).select("pid", "clause", F.explode("words").alias("word"))


def optionals(compiled: DataFrame) -> DataFrame:
    """(pid, word, n_optional)."""
    return compiled.select("pid", F.explode("optional").alias("word"), F.size("optional").alias("n_optional"))


def inverted_index(requirements: DataFrame) -> DataFrame:
    """(word, pids), pids in order. The joins use requirements itself; this is for look-ups."""
    return requirements.groupBy("word").agg(F.sort_array(F.collect_set("pid")).alias("pids"))


def multigram_list(compiled: DataFrame) -> DataFrame:
    return compiled.select(F.explode("multigrams").alias("word")).distinct()


# -- exact look-up structures: what a trie answers, as joins ----------------------------------------------------------


def lookup(dictionary: DataFrame, words: DataFrame, key: str = "word") -> DataFrame:
    return words.join(dictionary, key)


def subtree(dictionary: DataFrame, prefix: str, key: str = "word") -> DataFrame:
    """The entries that begin with prefix; pushed down to the scan."""
    return dictionary.where(F.startswith(F.col(key), F.lit(prefix)))
