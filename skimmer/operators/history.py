"""History statistics, forecasts and the thresholds that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as related, the rank whose score is kept, its value without rows, the smoothing weight.
LEAST_SCORE, RANK, DEFAULT_SCORE, ALPHA = 0.15, 10, 0.15, 0.8


def daily(scored: DataFrame, profiles: DataFrame, days: DataFrame, least: float = LEAST_SCORE, k: int = RANK, default: float = DEFAULT_SCORE) -> DataFrame:
    """(pid, day, n_related, rank_score) for every profile and day, with or without rows.

    The k-th best score (the least one of fewer) comes from a top-k by window, which prunes before the shuffle."""
    kept = scored.where(F.col("score") >= least)
    counts = kept.groupBy("pid", "day").agg(F.count("*").alias("n_related"))
    top = kept.select("pid", "day", "score", F.row_number().over(Window.partitionBy("pid", "day").orderBy(F.desc("score"))).alias("at")).where(F.col("at") <= k)
    kth = top.groupBy("pid", "day").agg(F.min("score").alias("rank_score"))
    grid = profiles.select("pid").distinct().join(F.broadcast(days.select("day").distinct()), how="cross")  # profiles x days is the result's own size
    return grid.join(counts, ["pid", "day"], "left").join(kth, ["pid", "day"], "left").select("pid", "day", F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"), F.coalesce("rank_score", F.lit(default)).alias("rank_score"))


def smoothed(values: Column, alpha: float = ALPHA) -> Column:
    """Exponential smoothing of an ordered array, begun with the mean of its first two values; the last forecast."""
    seed = F.when(F.size(values) >= 2, (F.get(values, F.lit(0)) + F.get(values, F.lit(1))) / 2).otherwise(F.get(values, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(values, seed.cast("double"), lambda s, x: alpha * x + (1 - alpha) * s))


def decayed(stats: DataFrame, value: str, alpha: float = ALPHA) -> DataFrame:
    """(pid, n, weight, total, first, second): what smoothed() needs of these days, in a form that merges; no list of days is kept.

    total is the decayed sum of the values, weight what a forecast from before them is multiplied by."""
    order = Window.partitionBy("pid")
    rows = stats.select("pid", F.col(value).cast("double").alias("v"), F.row_number().over(order.orderBy("day")).alias("at"), F.count("*").over(order).alias("n"))
    fall = F.pow(F.lit(1 - alpha), F.col("n") - F.col("at"))
    pick = lambda i: F.max(F.when(F.col("at") == i, F.col("v")))
    return rows.groupBy("pid").agg(F.first("n").alias("n"), F.pow(F.lit(1 - alpha), F.first("n")).alias("weight"), F.sum(alpha * F.col("v") * fall).alias("total"), pick(1).alias("first"), pick(2).alias("second"))


def merged(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """decayed() of the days of both, all of earlier's before all of later's: a row a profile is read, whatever the days."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = earlier.alias("a").join(later.alias("b"), F.col("a.pid").eqNullSafe(F.col("b.pid")), "full")
    zero = F.lit(0.0)
    return both.select(
        F.coalesce(a("pid"), b("pid")).alias("pid"), (F.coalesce(a("n"), F.lit(0)) + F.coalesce(b("n"), F.lit(0))).alias("n"),
        (F.coalesce(a("weight"), F.lit(1.0)) * F.coalesce(b("weight"), F.lit(1.0))).alias("weight"),
        (F.coalesce(a("total"), zero) * F.coalesce(b("weight"), F.lit(1.0)) + F.coalesce(b("total"), zero)).alias("total"),
        F.coalesce(a("first"), b("first")).alias("first"), F.when(a("n") >= 2, a("second")).when(a("n") == 1, b("first")).otherwise(b("second")).alias("second"),
    )


def forecasts(state: DataFrame) -> DataFrame:
    """(pid, threshold) from decayed days, as thresholds() gives it from all of them."""
    seed = F.when(F.col("n") >= 2, (F.col("first") + F.col("second")) / 2).otherwise(F.col("first"))
    return state.select("pid", (F.col("weight") * seed + F.col("total")).alias("threshold"))


def ordered(stats: DataFrame, value: str, by: str = "pid") -> DataFrame:
    """(pid, values) by day; a profile has as many values as there are days."""
    rows = F.array_sort(F.collect_list(F.struct("day", F.col(value).cast("double").alias("v"))))
    return stats.groupBy(by).agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def thresholds(stats: DataFrame, value: str = "rank_score", how: str = "forecast", column: int = 13, alpha: float = ALPHA) -> DataFrame:
    """(pid, threshold): the forecast, or the value of one numbered day as it once was."""
    values = ordered(stats, value)
    return values.select("pid", (smoothed(F.col("values"), alpha) if how == "forecast" else F.get("values", F.lit(column))).alias("threshold"))


def moving_average(stats: DataFrame, value: str, days: int = 3) -> DataFrame:
    over = Window.partitionBy("pid").orderBy("day").rowsBetween(-(days - 1), 0)
    return stats.select("pid", "day", F.avg(value).over(over).alias("average"))


def matrix(stats: DataFrame, value: str, days: list[str] | None = None) -> DataFrame:
    """One column per day. Days that are given need no pass to look for them; else all of the table's, as many as the result is wide."""
    rows = stats.groupBy("pid")
    return (rows.pivot("day") if days is None else rows.pivot("day", days)).agg(F.first(value))
