"""Monthly series: lasting losses, plateaus, filling, running bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permanent_loss(quality: DataFrame, below: float = 0.30, frame: int = 6) -> DataFrame:
    """(person, topic, month): the first month that ends ``frame`` months all below the threshold."""
    w = Window.partitionBy("person", "topic").orderBy("month").rowsBetween(-(frame - 1), 0)
    firing = quality.select("person", "topic", "month", F.max("q").over(w).alias("most"), F.count(F.lit(1)).over(w).alias("n")).where((F.col("most") < below) & (F.col("n") == frame))
    return firing.groupBy("person", "topic").agg(F.min("month").alias("month"))


def plateau_month(curves: DataFrame, step: float = 0.01) -> DataFrame:
    """(person, plateau_month): the month behind which no step is ``step`` or more; null if that is the last month."""
    w = Window.partitionBy("person").orderBy("month")
    steps = curves.select("person", F.row_number().over(w).alias("i"), F.abs(F.col("rate") - F.lag("rate").over(w)).alias("d"))
    last = steps.groupBy("person").agg(F.max("i").alias("n"), F.coalesce(F.max(F.when(F.col("d") >= step, F.col("i") - 1)), F.lit(0)).alias("j"))
    return last.select("person", F.when(F.col("j") <= F.col("n") - 2, F.col("j") + 1).alias("plateau_month"))


def first_flat_month(curves: DataFrame, step: float = 0.005, default: int = 12) -> DataFrame:
    """(person, flat_month): the first month whose step is below ``step``, else ``default``."""
    w = Window.partitionBy("person").orderBy("month")
    flat = curves.select("person", F.when(F.abs(F.col("rate") - F.lag("rate").over(w)) < step, F.col("month")).alias("m"))
    return flat.groupBy("person").agg(F.coalesce(F.min("m"), F.lit(default)).alias("flat_month"))


def padded(series: Column, length: int = 12) -> Column:
    """The array cut or filled with its last value (0.0 if empty) to ``length``."""
    last = F.coalesce(F.try_element_at(series, F.lit(-1)), F.lit(0.0))
    filled = F.concat(series, F.array_repeat(last, F.greatest(F.lit(length) - F.size(series), F.lit(0))))
    return F.slice(F.coalesce(filled, F.array_repeat(F.lit(0.0), length)), 1, length)


def running_best(quality: DataFrame) -> DataFrame:
    """Best quality of each topic up to every month."""
    w = Window.partitionBy("person", "topic").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return quality.withColumn("best", F.max("q").over(w))


def cumulative_losses(losses: DataFrame, months: int = 12) -> DataFrame:
    """(person, month, n): losses up to each month of 1..months."""
    grid = losses.select("person").distinct().select("person", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    at = losses.groupBy("person", "month").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("person").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(at, ["person", "month"], "left").select("person", "month", F.sum(F.coalesce("k", F.lit(0))).over(w).alias("n"))


def status(quality: Column, step: Column) -> Column:
    """recovered, partial or lost of one routed request."""
    return F.when((step <= 3) & (quality >= 0.35), "recovered").when((step <= 3) & (quality >= 0.10), "partial").otherwise("lost")


def log_class(quality: Column, step: Column) -> Column:
    """none, ok, partial or weak of one log entry."""
    return F.when((step == 4) | (quality < 0.05), "none").when(quality >= 0.70, "ok").when(quality >= 0.30, "partial").otherwise("weak")
