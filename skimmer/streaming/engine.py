"""The whole engine on a stream, from message lines to digest rows and pushes.

Lines are parsed, gated, matched against the profiles and scored row by row, with no shuffle; profiles, model and thresholds are
tables that each micro-batch joins. Then two states follow one after the other: contents, keyed by hash, so that no profile gathers
in one task, and the push decision of each profile and day. The sink writes a folder for each batch, by its id, so that a batch
that runs again after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import features as R
from skimmer.operators import dedup, feedback, match, push, ranker, similarity
from skimmer.plans.filtering import Profiles
from skimmer.scratch import scratch
from skimmer.sources import readers
from skimmer.streaming import state
from skimmer.streaming.metrics import watched

COLUMNS = ["seq", "tid", "orig_id", "hash", "pid", "day", "score", "similarity", "total", "threshold", "ts"]


def messages(lines: DataFrame, hash_of=None) -> DataFrame:
    """Extracted messages of JSON lines (value), with seq, ts, day and hash."""
    ms = F.col("timestamp_ms").cast("long")
    rows = readers.extract(readers.parse_messages(lines)).drop("json")
    return rows.withColumns({"seq": ms, "ts": F.timestamp_millis(ms), "day": F.date_format(F.timestamp_millis(ms), "yyyyMMdd"), "hash": (hash_of or dedup.fingerprint)(F.col("full_text"))})


def accepted(lines: DataFrame, profiles: Profiles, thresholds: DataFrame, model, gate=None, lang: str | None = None, hash_of=None, unicode: bool = True, least: float = push.LEAST_TOTAL) -> DataFrame:
    """COLUMNS of the messages whose total score is over least. model: the fitted quality model, or rows -> rows with score; gate:
    rows -> rows, such as operators.language.english."""
    rows = watched(messages(lines, hash_of), "received", n=F.count("*"))
    rows = match.gated(rows, "full_text", lang)
    rows = gate(rows) if gate else rows
    words = match.token_set(F.col("full_text"), profiles.multigrams, unicode=unicode)
    rows = rows.withColumn("best", match.Index(profiles.compiled).best(words)).where("best is not null")
    rows = rows.withColumns({"pid": F.col("best.pid"), "similarity": F.col("best.similarity")})
    scored = model(rows) if callable(model) else ranker.predict(model, ranker.numeric(rows.withColumns(R.of_message())))
    kept = push.total_score(scored, least).join(match.small(thresholds.select("pid", "threshold")), "pid")
    return watched(kept.select(*COLUMNS), "accepted", n=F.count("*"))


def filtered(lines: DataFrame, profiles: Profiles, thresholds: DataFrame, model, cap: int = push.CAP, late: str = "1 day", keep_days: int = 2, **how) -> DataFrame:
    """(pid, day, seq, score, received, pushed, kind, tid, similarity, total), kind related or pushed. Contents are remembered
    keep_days after they came last, counters and pushed origins of a day keep_days after its end."""
    rows = accepted(lines, profiles, thresholds, model, **how).withWatermark("ts", late)
    new = state.first_contents(rows, ["hash"], keep_days)
    found = state.decided(new, ["pid", "day"], cap, keep_days, more=["tid", "similarity", "total"])
    return watched(found, "decided", related=F.count_if(F.col("kind") == "related"), pushed=F.count_if(F.col("kind") == "pushed"))


def write_batches(path: str):
    """For foreachBatch: a folder for each batch id, replaced if the batch runs again."""

    def write(batch: DataFrame, at: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={at}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, write=None, name: str | None = None):
    """Starts the stream into path; stop() ends it, and starting again from the same checkpoint goes on where it was. every: the
    trigger's interval; else all that is there now."""
    state.rocks(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(write or write_batches(path)).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def digests(decided: DataFrame) -> DataFrame:
    """The daily digest of what the stream has written."""
    return push.digest(decided.where("kind = 'related'"))


# -- pseudo-relevance feedback: what a batch learns is in the next one's profiles ---------------------------------------


class Feedback:
    """For foreachBatch: classifies each batch with profiles that hold the two best words of earlier records, and takes in its own.

    State is two tables by batch id, each profile's best similarity and its words' scores; a batch reads those of the one before and
    writes its own, so a batch that runs again gives the same. They are small: records of a profile rise, so a profile has few."""

    def __init__(self, profiles: Profiles, path: str, keep: int = 3, lang: str | None = None, unicode: bool = True):
        self.profiles, self.path, self.keep, self.lang, self.unicode = profiles, path, keep, lang, unicode

    def _table(self, spark: SparkSession, name: str, at: int, kinds: str) -> DataFrame:
        return spark.read.schema(kinds).parquet(f"{self.path}/{name}/{at}") if at >= 0 else spark.createDataFrame([], kinds)

    def __call__(self, batch: DataFrame, at: int) -> None:
        """batch: (seq, text[, lang]); at: its id, from 0."""
        spark = batch.sparkSession
        best = self._table(spark, "best", at - 1, "pid int, best double")
        terms = self._table(spark, "terms", at - 1, "pid int, word string, score double")
        p, rows = self.profiles, scratch(match.gated(batch, "text", self.lang))
        tokens = scratch(match.tokens_of(rows, "seq", multigrams=p.multigrams, unicode=self.unicode))
        wanted = feedback.expanded(p.compiled.select("pid", "optional"), feedback.expansion(terms))
        met = match.scored_matches(tokens, p.compiled, "seq", wanted)
        top = similarity.argmax(met.select("seq", "pid", similarity.exact_sim(F.col("met"), F.col("n_optional"), 3).alias("sim")), "seq")
        top.write.mode("overwrite").parquet(f"{self.path}/rows/batch={at}")
        found = spark.read.schema(top.schema).parquet(f"{self.path}/rows/batch={at}")
        records = scratch(feedback.record_rows(found.withColumnRenamed("similarity", "sim"), start=best))
        more = feedback.term_scores(records.select("seq", "pid", "sim"), tokens)
        terms.unionByName(more).groupBy("pid", "word").agg(F.sum("score").alias("score")).write.mode("overwrite").parquet(f"{self.path}/terms/{at}")
        new = best.unionByName(records.select("pid", F.col("sim").alias("best"))).groupBy("pid").agg(F.max("best").alias("best"))
        new.write.mode("overwrite").parquet(f"{self.path}/best/{at}")
        for name in ("best", "terms"):
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{at - self.keep}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
