"""Who knows which topic: profiles, top experts, monopolies, concentration and vulnerability.

A profile table has the columns person, topic, cnt, score. All operators are aggregations or windows keyed by person or
topic; where a single row of totals is needed it is joined as a one-row aggregate, never as a window over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rk") -> DataFrame:
    """Row number from 1 within ``keys``; give ``order`` a last column that breaks ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (Spark limits each group before the exchange)."""
    return ranked(df, keys, order).where(F.col("rk") <= k)


def topic_counts(df: DataFrame, person: Column, topic: Column) -> DataFrame:
    return df.groupBy(person.alias("person"), topic.alias("topic")).agg(F.count(F.lit(1)).alias("cnt"))


def expertise_profile(counts: DataFrame) -> DataFrame:
    """score = count / the person's largest count."""
    return counts.withColumn("score", F.col("cnt") / F.max("cnt").over(Window.partitionBy("person")))


def topics_top_expert(profile: DataFrame) -> DataFrame:
    """Per person the number of topics of which it is the first by score (ties: smaller person)."""
    best = profile.groupBy("topic").agg(F.min_by("person", F.struct(-F.col("score"), F.col("person"))).alias("person"))
    return best.groupBy("person").agg(F.count(F.lit(1)).alias("topics_top_expert"))


def topic_monopoly(profile: DataFrame, low: float = 0.3, high: float = 0.5) -> DataFrame:
    """Topics with one scorer above ``low``, who is also above ``high``, credited to that scorer."""
    one = profile.groupBy("topic").agg(
        F.count_if(F.col("score") > low).alias("n"), F.max("score").alias("top"), F.max(F.when(F.col("score") > low, F.col("person"))).alias("person")
    )
    return one.where((F.col("n") == 1) & (F.col("top") > high)).groupBy("person").agg(F.count(F.lit(1)).alias("topic_monopoly"))


def concentration(profile: DataFrame) -> DataFrame:
    """Sum of squared scores over the number of topics (not a Herfindahl index)."""
    return profile.groupBy("person").agg((F.sum(F.col("score") * F.col("score")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("concentration"))


def min_max(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Each column scaled to 0..1 over the whole table; a constant column becomes 0."""
    bounds = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    for c in columns:
        width = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        out = out.withColumn(c + suffix, F.when(width > 0, (F.col(c) - F.col(f"{c}_lo")) / width).otherwise(F.lit(0.0)))
    return out.drop(*bounds.columns)


def topic_vulnerability(profile: DataFrame, low: float = 0.3, k: int = 3) -> DataFrame:
    """Experts, Herfindahl index, vulnerability, its min-max value and the first ``k`` persons of each topic."""
    expert = F.when(F.col("score") > low, F.col("score"))
    sums = profile.groupBy("topic").agg(F.count(expert).alias("n_experts"), F.sum(expert * expert).alias("sq"), F.sum(expert).alias("s"))
    hhi = F.coalesce(F.try_divide(F.col("sq"), F.col("s") * F.col("s")), F.lit(1.0))
    scored = sums.select("topic", "n_experts", F.bround(hhi, 4).alias("hhi"), ((1.0 / F.greatest("n_experts", F.lit(1))) * (1 + hhi)).alias("vulnerability"))
    leaders = top_k(profile, ["topic"], [F.desc("score"), F.asc("person")], k)
    leaders = leaders.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "person", "score"))), lambda x: F.struct(x["person"], x["score"])).alias("top_experts"))
    return min_max(scored, ["vulnerability"]).join(leaders, "topic", "left")


def bandwidth(profile: DataFrame, factor: float = 1.5, months: int = 12) -> DataFrame:
    """Requests a person can take a month: max(1, factor * all counts / months)."""
    return profile.groupBy("person").agg(F.greatest(F.lit(1.0), factor * F.sum("cnt") / months).alias("bandwidth"))


def request_schedule(profile: DataFrame, months: int = 12) -> DataFrame:
    """Requests a month for each topic, halves to even, one at least."""
    return profile.withColumn("n_requests", F.greatest(F.lit(1), F.bround(F.col("cnt") / months).cast("int")))


def topic_sets(profile: DataFrame) -> DataFrame:
    """Per person the sorted topics and the map topic -> score."""
    return profile.groupBy("person").agg(F.array_sort(F.collect_set("topic")).alias("topics"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "score")))).alias("scores"))


def inferred_profile(neighbours: DataFrame, profile: DataFrame, k: int = 20) -> DataFrame:
    """A profile guessed from neighbours (person, neighbour): mean score weighted by coverage, scaled to a maximum of 0.5."""
    size = neighbours.groupBy("person").agg(F.countDistinct("neighbour").alias("n"))
    seen = neighbours.join(profile.select(F.col("person").alias("neighbour"), "topic", "score"), "neighbour").groupBy("person", "topic").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("cnt"))
    raw = seen.join(size, "person").withColumn("raw", F.bround(F.round(F.col("mean") * F.least(F.lit(1.0), 5 * F.col("cnt") / F.greatest("n", F.lit(1))), 9), 4))
    kept = top_k(raw, ["person"], [F.desc("raw"), F.asc("topic")], k)
    scaled = kept.withColumn("score", F.bround(F.round(F.try_divide(F.col("raw"), F.max("raw").over(Window.partitionBy("person"))) * 0.5, 9), 4))
    return scaled.select("person", "topic", F.greatest(F.lit(1), F.bround(F.round(200 * F.col("score"), 6)).cast("int")).alias("cnt"), "score")
