"""Writers, partitioned so that each is one pass without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.functions.features import NAMES
from skimmer.sources.readers import profile_id


def digest_line(tag: str = "RUN") -> Column:
    """day, profile, Q0, message, rank, score, run."""
    return F.concat_ws("\t", "day", profile_id(F.col("pid")), F.lit("Q0"), "tid", F.col("rank").cast("string"), F.format_string("%f", "total"), F.lit(tag))


def push_line(tag: str = "RUN") -> Column:
    """profile, message, delivery in epoch seconds, run."""
    return F.concat_ws("\t", profile_id(F.col("pid")), "tid", F.substring(F.col("delivered").cast("string"), 1, 10), F.lit(tag))


def extended_push_line(tag: str = "RUN") -> Column:
    return F.concat_ws("\t", push_line(tag), F.col("similarity").cast("string"), F.col("total").cast("string"), "text")


def write_digest(ranked: DataFrame, path: str, tag: str = "RUN", mode: str = "append") -> None:
    """A folder of lines per day, by profile and rank."""
    rows = ranked.repartition("day").sortWithinPartitions("day", "pid", "rank")
    rows.select("day", digest_line(tag).alias("value")).write.mode(mode).partitionBy("day").text(path)


def write_pushes(pushed: DataFrame, path: str, tag: str = "RUN", extended: bool = False, mode: str = "append") -> None:
    pushed.select((extended_push_line if extended else push_line)(tag).alias("value")).write.mode(mode).text(path)


def write_profiles(results: DataFrame, path: str, mode: str = "append") -> None:
    """Per day and profile one folder of JSON (all columns) and one of "similarity TAB text", best first."""
    rows = results.repartition("day", "pid").sortWithinPartitions("day", "pid", F.desc("similarity"), "tid")
    rows.write.mode(mode).partitionBy("day", "pid").json(f"{path}/json")
    rows.select("day", "pid", F.concat_ws("\t", F.col("similarity").cast("string"), "text").alias("value")).write.mode(mode).partitionBy("day", "pid").text(f"{path}/text")


def write_history(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    stats.write.mode(mode).parquet(path)


def write_history_matrix(wide: DataFrame, path: str, days: list[str]) -> None:
    """The table of fixed width for people: a line of days, a rule, a line per profile. One file: it has a row per profile."""
    spark = wide.sparkSession
    head = spark.createDataFrame([(0, "\t".join(days)), (1, "=" * 160)], "at int, value string")
    body = wide.orderBy("pid").select((F.row_number().over(Window.orderBy("pid")) + 1).alias("at"), F.concat_ws("\t", *(F.col(d).cast("string") for d in days)).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def read_history_matrix(spark, path: str) -> DataFrame:
    """(pid, values) back from it; rows stand in the order of profiles."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))  # a row per profile
    kept = lines.where("at >= 2 and line <> ''")
    return kept.select((F.col("at") - 2).alias("pid"), F.transform(F.split("line", "\t"), lambda x: x.try_cast("double")).alias("values"))


def write_lines(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Kept messages or articles, one a line."""
    rows.select(one_line(F.col(column)).alias("value")).write.mode(mode).text(path)


def write_json(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON objects (value), one a line."""
    lines.select("value").write.mode(mode).text(path)


def write_training(rows: DataFrame, path: str) -> None:
    """The twelve features and the class as data rows of the training format; the header stands in each file."""
    names = [*NAMES, "Importance"]
    head = "@relation messages\n\n" + "\n".join(f"@attribute {c} {'{1,0}' if c == 'Importance' else 'real'}" for c in names) + "\n\n@data"
    rows.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in names)).alias("value")).write.option("lineSep", "\n").mode("overwrite").text(f"{path}/data")
    rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def write_vector_lines(vectors: DataFrame, path: str) -> None:
    """(word, vec) in the text layout of word vectors, without its header."""
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value")).write.mode("overwrite").text(path)


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Trained (word, vec) as a table, and from it in the text layout."""
    vectors.write.mode("overwrite").parquet(f"{path}/model")
    write_vector_lines(vectors.sparkSession.read.parquet(f"{path}/model"), f"{path}/text")
