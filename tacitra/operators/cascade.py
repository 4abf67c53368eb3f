"""What happens if several persons leave together, and how far work can be automated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_removed(removed: DataFrame) -> DataFrame:
    """(person, risk, i): the removed persons by falling risk, i from 0. ``removed`` is a short queue (2 to 5 persons)."""
    return removed.withColumn("i", F.row_number().over(Window.orderBy(F.desc("risk"), F.asc("person"))) - 1)


def category_vectors(profile: DataFrame) -> DataFrame:
    """(person, category, score): the smallest score of a category stands for it."""
    return profile.groupBy("person", "category").agg(F.min("score").alias("score"))


def overlap_factor(vectors: DataFrame, removed: DataFrame, cap: float = 0.5) -> DataFrame:
    """One row tau: mean cosine over all pairs of removed persons, ``cap`` at most, 0 for fewer than two."""
    mine = vectors.join(removed.select("person", "i"), "person")
    norms = mine.groupBy("person").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    people = removed.select("person", "i").join(norms, "person", "left").fillna(0.0, subset=["norm"])
    a, b = people.toDF("pa", "ia", "na"), people.toDF("pb", "ib", "nb")
    pairs = a.join(b, F.col("ia") < F.col("ib"))  # a queue of five persons has ten pairs
    x, y = mine.select(F.col("person").alias("pa"), "category", F.col("score").alias("sa")), mine.select(F.col("person").alias("pb"), "category", F.col("score").alias("sb"))
    dots = x.join(y, "category").groupBy("pa", "pb").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))), F.lit(0.0))
    return pairs.join(dots, ["pa", "pb"], "left").agg(F.least(F.lit(cap), F.coalesce(F.avg(cosine), F.lit(0.0))).alias("tau"))


def cascade_total(removed: DataFrame, tau: DataFrame, step: float = 0.032) -> DataFrame:
    """One row: plain sum of risks, total with overlap (1 at most) and amplification in percent."""
    sums = removed.agg(F.sum("risk").alias("plain"), F.sum(F.col("risk") + step * F.col("i")).alias("stepped"))
    total = F.least(F.lit(1.0), F.col("stepped") * (1 + F.col("tau")))
    return sums.crossJoin(tau).select("plain", total.alias("total"), F.floor(100 * (total - F.col("plain")) / F.col("plain") + 0.5).alias("amplification"))


def live_risk(people: DataFrame, profile: DataFrame, removed: DataFrame, base: float = 0.015, step: float = 0.008, cap: float = 0.95) -> DataFrame:
    """(person, live_risk) of those who stay: a boost per removed person and shared category."""
    cats = profile.select("person", "category").distinct()
    gone = cats.join(removed.select("person", "i"), "person").select("category", (base + step * F.col("i")).alias("boost"))
    boosts = cats.join(gone, "category").groupBy("person").agg(F.sum("boost").alias("boost"))
    stay = people.join(removed.select("person"), "person", "left_anti")
    return stay.join(boosts, "person", "left").select("person", F.least(F.lit(cap), F.col("risk") + F.coalesce("boost", F.lit(0.0))).alias("live_risk"))


def topic_hits(profile: DataFrame, removed: DataFrame) -> DataFrame:
    """(category, hits, state): LOST from two removed holders on."""
    hits = profile.select("person", "category").distinct().join(removed.select("person"), "person").groupBy("category").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("state", F.when(F.col("hits") >= 2, "LOST").otherwise("PARTIAL"))


def exposure(people: DataFrame, profile: DataFrame, topics: DataFrame, junior_floor: float = 35) -> DataFrame:
    """people (person, risk, impact, junior) with exposure, adjusted score, residual gap and quadrant.

    Only categories of ``topics`` count, in numerator and denominator alike.
    """
    weighed = profile.groupBy("person", "category").agg(F.sum("score").alias("w")).join(F.broadcast(topics), "category")
    per = weighed.groupBy("person").agg((F.sum(F.col("w") * F.col("automability")) / F.sum("w")).alias("raw"), F.sum(F.col("w") * (1 - F.col("automability") / 100)).alias("residual"))
    out = people.join(per, "person", "left")
    exposed = F.floor(F.round(F.coalesce("raw", F.lit(0.0)), 9) + 0.5)  # sums of doubles depend on their order; half a point must not
    out = out.withColumn("exposure", F.when(F.col("junior"), F.greatest(exposed, F.lit(junior_floor))).otherwise(exposed))
    base, impact = F.col("risk") * 100, F.floor(F.col("impact") * 100 + 0.5)
    floor = F.when(impact >= 80, 25).when(impact >= 60, 20).otherwise(0)
    out = out.withColumn("adjusted", F.floor(F.round(F.greatest(base * (1 - F.col("exposure") / 100 * 0.5), floor), 9) + 0.5))
    high, wide = F.col("adjusted") >= 20, F.col("exposure") >= 65
    named = F.when(impact >= 80, "Critical Human Capital").when(high & wide, "Transition Risk").when(high, "Critical Human Capital").when(wide, "Automation Candidate").otherwise("Stable")
    return out.select("person", F.col("exposure").cast("double").alias("exposure"), F.col("adjusted").cast("double").alias("adjusted"), F.coalesce("residual", F.lit(0.0)).alias("residual"), named.alias("ai_quadrant"))
