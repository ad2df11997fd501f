"""Pseudo-relevance feedback: a message that beats a topic's best so far lends it its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skimmer.operators import scan
from skimmer.operators.match import small


def record_rows(rows: DataFrame, least: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """Rows (seq, pid, sim) over all earlier ones of their topic and over least. start: (pid, best), what was before."""
    rows = scan.running(rows, ["pid"], "seq", maxima={"best_before": F.when(F.col("sim") > least, F.col("sim"))}, before=True)
    best = F.coalesce("best_before", F.lit(0.0).cast(rows.schema["sim"].dataType))
    if start is not None:
        rows = rows.join(small(start.select("pid", F.col("best").alias("__start"))), "pid", "left")
        best = F.greatest(best, F.coalesce("__start", F.lit(0.0)))
    found = rows.withColumn("best_before", best).drop("__start")
    return found.where((F.col("sim") > F.col("best_before")) & (F.col("sim") > least))


def term_scores(records: DataFrame, words: DataFrame, key: str = "seq") -> DataFrame:
    """(pid, word, score): the summed similarity of the records that hold the word."""
    return records.join(words, key).groupBy("pid", "word").agg(F.sum("sim").alias("score"))


def expansion(scores: DataFrame, k: int = 2) -> DataFrame:
    """The k best words of each topic; ties go by the alphabet."""
    return scores.withColumn("at", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "word"))).where(F.col("at") <= k)


def expanded(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """Profiles (pid, optional) with their expansion words."""
    more = terms.groupBy("pid").agg(F.sort_array(F.collect_list("word")).alias("more"))
    return profiles.join(more, "pid", "left").select("pid", F.array_union("optional", F.coalesce("more", F.array().cast("array<string>"))).alias("optional"))
