"""The push decision as a stream.

Each profile keeps what it has received and pushed; rows of a micro-batch are put in order of arrival first. A message's
content is remembered within the watermark, so the state is bounded, unlike sets that only grow. State is in skimmer.streaming.state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.operators.push import CAP
from skimmer.scratch import scratch_path
from skimmer.streaming import state


def pushes(scored: DataFrame, cap: int = CAP, keep_days: int = 2) -> DataFrame:
    """Rows (seq, pid, day, score, threshold, ts) that are pushed, with the counters of their profile and day. State of a day ends
    keep_days after the watermark has passed it."""
    found = state.decided(scored.withWatermark("ts", "1 day"), ["pid", "day"], cap, keep_days, related=False)
    return found.select("seq", "pid", "day", "score", "received", "pushed")


def adaptive(scored: DataFrame, cap: int = CAP, keep_days: int = 2) -> DataFrame:
    """pushes() where a profile that receives more than predicted lowers its own threshold; rows have predicted, too."""
    found = state.decided(scored.withWatermark("ts", "1 day"), ["pid", "day"], cap, keep_days, related=False, adaptive=True)
    return found.select("seq", "pid", "day", "score", "received", "pushed")


def engine(accepted: DataFrame, cap: int = CAP, keep_days: int = 2, scope: tuple[str, ...] = ("pid", "day")) -> DataFrame:
    """(seq, pid, day, score, kind) of accepted rows (seq, hash, orig_id, pid, day, score, threshold, ts), kind related or pushed: the
    sequential rule. A row is left out if its content was related before or its origin pushed before; contents of rows that never
    came this far aren't remembered. Contents and origins are entries of their scope's state; they end keep_days after the
    watermark has passed its day. Rows of one origin or content should fall into one scope."""
    found = state.decided(accepted.withWatermark("ts", "1 day"), list(scope), cap, keep_days, contents=True, more=["pid"])
    return found.select("seq", "pid", "day", "score", "kind")


def new_contents(rows: DataFrame, key: str = "hash", within: str = "1 day") -> DataFrame:
    """The first row of each content within the watermark. It stands after the relevance cut: what was rejected may come again."""
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def daily_counts(scored: DataFrame, late: str = "1 day") -> DataFrame:
    """(start, pid, n, best) per profile and UTC day, once the watermark has passed the day."""
    return scored.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "pid").agg(F.count("*").alias("n"), F.max("score").alias("best")).select(F.col("window.start").alias("start"), "pid", "n", "best")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through to a table; returns it. Checkpoint and table are in the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")

    def keep(batch: DataFrame, at: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def start(lines: DataFrame, per_batch, checkpoint: str, every: str | None = None):
    """Starts a continuous query that hands each micro-batch to per_batch(batch, id); every: its trigger's interval."""
    writer = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def progress_listener(log) -> "object":
    """A listener that gives log(name, rows, rows a second) of each micro-batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            log(event.progress.name, event.progress.numInputRows, event.progress.processedRowsPerSecond)

        def onQueryTerminated(self, event):
            pass

    return Progress()
