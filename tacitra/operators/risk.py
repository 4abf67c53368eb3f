"""Risk scores, quadrants and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitra.operators.dims import RISK_WEIGHTS
from tacitra.operators.expertise import min_max

QUADRANTS = ["Organizational Emergency", "Silent Threat", "Replaceable Executive", "Low Priority"]


def assemble(nodes: DataFrame, **metrics: DataFrame) -> DataFrame:
    """All persons of ``nodes`` with each metric (a table person, metric); missing values are 0."""
    out = nodes.select("person").distinct()
    for name, table in metrics.items():
        out = out.join(table.select("person", name), "person", "left")
    return out.fillna(0, subset=list(metrics))


def risk_score(metrics: DataFrame, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Weighted sum of the min-max values of the metrics named in ``weights``."""
    out = min_max(metrics, list(weights))
    total = sum((F.col(f"{c}_norm") * w for c, w in weights.items()), F.lit(0.0))
    return out.withColumn("risk", total).drop(*[f"{c}_norm" for c in weights])


def quadrant(risk: Column, impact: Column, risk_from: float = 0.12, impact_from: float = 0.65) -> Column:
    high, up = F.bround(risk, 4) >= risk_from, F.bround(impact, 4) >= impact_from
    return F.when(high & up, QUADRANTS[0]).when(high, QUADRANTS[1]).when(up, QUADRANTS[2]).otherwise(QUADRANTS[3])


def inferred_role(betweenness: Column, top_expert: Column, weighted_degree: Column) -> Column:
    """A role for persons without title, first match."""
    return (
        F.when(betweenness > 0.03, "Executive Leadership").when(betweenness > 0.015, "Senior Management").when(betweenness > 0.008, "Director")
        .when(top_expert > 3, "Domain Specialist").when(weighted_degree > 5000, "Senior Analyst").when(weighted_degree > 2000, "Analyst").when(weighted_degree > 500, "Associate")
        .otherwise("Junior Associate")
    )


def name_hash(name: Column, base: int = 31, modulus: int = 1_000_003) -> Column:
    """h = (base * h + code) mod modulus over the characters; a table-free hash that every engine can repeat."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * base + c) % modulus)


def jitter(value: Column, hashed: Column, bound: Column, width: float = 0.030) -> Column:
    """``value`` moved by a fixed small amount, kept on its side of ``bound``."""
    moved = value + (hashed % 1000) / 1000.0 * width - width / 2
    return F.when(value >= bound, F.greatest(moved, bound)).otherwise(F.least(moved, bound - 0.001))


def quadrant_counts(df: DataFrame, column: str = "quadrant") -> DataFrame:
    """Persons of every quadrant, those without any included."""
    names = df.sparkSession.createDataFrame([(q,) for q in QUADRANTS], f"{column} string")
    return names.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
