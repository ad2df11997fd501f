"""Which messages are pushed now, and the daily digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skimmer.operators import scan
from skimmer.operators.match import small

LEAST_TOTAL, CAP, DIGEST = 0.15, 10, 100
#: Fixed values of the adaptive threshold: the first window, what the threshold and the window are multiplied by.
WINDOW, LOWER, WIDER = 0.618, 0.95, 1.1


def total_score(rows: DataFrame, least: float = LEAST_TOTAL) -> DataFrame:
    return rows.withColumn("total", F.col("similarity") * F.col("score")).where(F.col("total") >= least)


def capped(rows: DataFrame, thresholds: DataFrame, cap: int = CAP, by: str = "score", scope: list[str] = ()) -> DataFrame:
    """The first cap rows of each profile (and scope, such as the day) whose score is over the threshold."""
    over = rows.join(small(thresholds.select("pid", "threshold")), "pid").where(F.round(by, 12) > F.col("threshold"))
    return over.withColumn("at", F.row_number().over(Window.partitionBy("pid", *scope).orderBy("seq"))).where(F.col("at") <= cap)


def adaptive(rows: DataFrame, cap: int = CAP, by: str = "score", scope: list[str] = ()) -> DataFrame:
    """capped() of rows (seq, pid, score, threshold, predicted) whose threshold gives way: after a row that makes received / predicted
    more than the window, the threshold is LOWER times itself and the window WIDER times, once a row. No prediction: never.

    Until the cap is reached, what is lowered depends on the number of rows alone: after r rows it is at most j(r), the windows under
    r / predicted, and one more than after r - 1. So it is r plus the least of j(s) - s so far: a running minimum, no fold."""
    order = Window.partitionBy("pid", *scope).orderBy("seq")
    seen = rows.withColumns({"received": F.row_number().over(order), "first": F.first("threshold").over(order)})
    under = F.ceil(F.log(F.try_divide(F.col("received"), F.col("predicted")) / WINDOW) / F.log(F.lit(WIDER)))
    seen = seen.withColumn("slack", F.greatest(F.coalesce(under, F.lit(0)), F.lit(0)) - F.col("received"))
    so_far = F.least(F.min("slack").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("lowered", F.coalesce(F.col("received") - 1 + so_far, F.lit(0)))
    over = seen.where(F.round(by, 12) > F.col("first") * F.pow(F.lit(LOWER), F.col("lowered"))).drop("slack", "first")
    return over.withColumn("at", F.row_number().over(order)).where(F.col("at") <= cap)


def counters(rows: DataFrame, pushed: str = "pushed") -> DataFrame:
    """Rows received and pushed so far, by profile; a hot profile takes many tasks."""
    return scan.running(rows, ["pid"], "seq", sums={"received": F.lit(1).cast("long"), "n_pushed": F.col(pushed).cast("long")})


def digest(rows: DataFrame, size: int = DIGEST) -> DataFrame:
    """The best of each day and profile, by total score, then arrival."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("day", "pid").orderBy(F.desc("total"), "seq"))).where(F.col("rank") <= size)
