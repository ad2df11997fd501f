"""Readers. Each returns a DataFrame with a declared schema; nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import text as X
from skimmer.functions.markup import nested_markup
from skimmer.operators.match import small
from skimmer.schema import HISTORY, KEYWORDS, MESSAGE, TRAINING

#: Profiles are numbered from here: index 0 is MB226.
FIRST_PROFILE = 226


def profile_id(index: Column) -> Column:
    return F.concat(F.lit("MB"), (index + FIRST_PROFILE).cast("string"))


def profile_index(name: Column) -> Column:
    return F.substring(name, 3, 10).cast("int") - FIRST_PROFILE


def parse_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Message structs of JSON lines; what isn't an object, isn't well-formed or has no created_at (delete notices) is left out."""
    raw = lines.where(F.startswith(F.col(value), F.lit("{"))).select(F.col(value).alias("json"), F.from_json(value, MESSAGE).alias("m"))
    return raw.where("m.created_at is not null").select("json", "m.*")


def extract(messages: DataFrame) -> DataFrame:
    """(text, tid, orig_id, timestamp_ms, message columns): the retweeted text and id where there are any."""
    again = F.col("retweeted_status")
    return messages.select(
        X.message_text(F.col("user.screen_name"), F.coalesce(again["text"], F.col("text"))).alias("full_text"),
        F.col("id_str").alias("tid"), F.coalesce(again["id_str"], F.col("id_str")).alias("orig_id"), "timestamp_ms",
        *[c for c in messages.columns if c not in ("timestamp_ms",)],
    )


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines files, plain or gzip."""
    return parse_messages(spark.read.text(path))


def enriched(messages: DataFrame, *more: str) -> DataFrame:
    """(value): messages as JSON objects, with more of their columns."""
    return messages.select(F.to_json(F.struct(*MESSAGE.fieldNames(), *more)).alias("value"))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Lines of files as they come in."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def language_lines(spark: SparkSession, path: str) -> DataFrame:
    """(json, text) of messages whose user writes English, without #, @ and addresses; for the language filter."""
    kept = messages(spark, path).where("user.lang = 'en'")
    return kept.select("json", F.regexp_replace(X.collapse_breaks(F.col("text")), r"(https?:/*)[^ ]+|#|@", "").alias("text"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(pid, num, title) of <top> elements, under a root or not; the number is the last five characters. The parser that looks for row
    tags is chosen: the other one reads no second element of a file without a root."""
    raw = spark.read.format("xml").option("useLegacyXMLParser", True).option("rowTag", "top").schema("num string, title string").load(path)
    num = F.right(F.trim(F.regexp_replace("num", r"\s+", " ")), F.lit(5))
    return raw.select(profile_index(num).alias("pid"), num.alias("num"), F.trim(F.regexp_replace(X.collapse_breaks(F.col("title"), ""), "\r", "")).alias("title"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(pid, optional, required) expressions of a keyword file, whose strings hold raw tabs. Profiles go by their id, not by line."""
    raw = spark.read.schema(KEYWORDS).option("allowUnquotedControlChars", True).json(path)
    return raw.where("tid is not null").select(profile_index(F.col("tid")).alias("pid"), F.col("keyword.0").alias("optional"), F.col("keyword.1").alias("required"))


def expanded_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(line, words) of space-separated lines."""
    return spark.read.text(path).select(F.filter(F.split(F.trim("value"), " "), lambda w: w != "").alias("words"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a text-format vector file; the header line of two numbers is left out."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).where(F.size(parts) > 2)
    return rows.select(F.element_at(parts, 1).alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"))


def language_weights(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, lang, weight) of a language model table."""
    return spark.read.schema("ngram string, lang string, weight double").parquet(path)


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, n) of "ngram TAB count" lines; other lines are left out. unsorted() in operators.checks tests the order."""
    line = r"^(.+)\t([0-9]+)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("ngram"), F.regexp_extract("value", line, 2).cast("long").alias("n"))


def language_corpus(spark: SparkSession, path: str, labels: list[str] | DataFrame) -> DataFrame:
    """(lang, text) of labelled lines; reading fails on a label that isn't listed, be it in a list or in a table (lang) of any size."""
    lang, body = X.labelled_line(F.col("value"))
    rows = spark.read.text(path).select(lang.alias("lang"), body.alias("text"))
    if isinstance(labels, DataFrame):
        listed = small(labels.select(F.col("lang").alias("__listed")).distinct())
        rows, known = rows.join(listed, F.col("lang") == F.col("__listed"), "left"), F.col("__listed").isNotNull()
    else:
        known = F.col("lang").isin(labels)
    return rows.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col("lang"))).cast("boolean"))).select("lang", "text")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(day, pid, tid, score) of a folder of daily files, one per day, in the digest's layout; the day is the end of the file's name."""
    raw = spark.read.option("sep", "\t").schema("date string, profile string, q0 string, tid string, rank int, score double, tag string").csv(path)
    name = F.regexp_extract("_metadata.file_name", r"(..)$", 1)
    return raw.select(name.alias("day"), profile_index(F.col("profile")).alias("pid"), "tid", "score")


def digest_history(spark: SparkSession, path: str) -> DataFrame:
    """(day, pid, tid, rank, score) of a digest folder as writers.write_digest leaves it, a folder of lines for each day."""
    part = F.split("value", "\t")
    raw = spark.read.schema("value string, day string").text(path)
    return raw.select(part[0].alias("day"), profile_index(part[1]).alias("pid"), part[3].alias("tid"), part[4].cast("int").alias("rank"), part[5].cast("double").alias("score"))


def named_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def materialised(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path; computed and written first if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an ARFF file of the twelve features and the class; what precedes the data isn't comma-separated."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    rows = raw.where(~F.col("value").rlike(r"^\s*([@%].*)?$")).select(F.from_csv("value", TRAINING).alias("r"))
    return rows.select("r.*")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the articles of an XML dump, plain or bz2 in many files, markup taken out at any depth; redirects and other name
    spaces are left out."""
    raw = spark.read.format("xml").option("useLegacyXMLParser", True).option("rowTag", "page").schema("title string, ns int, redirect string, revision struct<text:string>").load(path)
    body = nested_markup(F.regexp_replace("revision.text", r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>|<(math|nowiki|gallery)\b.*?</\1>", " "))
    for pattern, by in ((r"\[https?://\S+ ?([^\]]*)\]", "$1"), (r"<[^>]+>|'{2,}|={2,}", " "), (r"\s+", " ")):
        body = F.regexp_replace(body, pattern, by)
    return raw.where((F.coalesce("ns", F.lit(0)) == 0) & F.col("redirect").isNull() & F.col("revision.text").isNotNull()).select("title", F.trim(body).alias("text"))


def wiki_words(pages: DataFrame, least: int = 2, most: int = 15, least_words: int = 50) -> DataFrame:
    """(title, words): lower-case words of letters, of articles with enough of them."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\p{L}_]+"), F.lit(0)), lambda w: F.length(w).between(least, most) & ~F.startswith(w, F.lit("_")))
    return pages.select("title", words.alias("words")).where(F.size("words") >= least_words)


def sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
