"""Small lookup tables: ladders of patterns, weights and parameters. All are fixed values in natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the risk score.
RISK_WEIGHTS = {"topic_monopoly": 0.35, "betweenness": 0.25, "weighted_degree": 0.20, "topics_top_expert": 0.15, "component_delta": 0.05}

# Positional impact by words of the title, first match.
IMPACT = [
    (0.15, ["executive assistant"]),
    (0.30, ["assistant director"]),
    (0.40, ["assistant vice president", "assistant vp"]),
    (0.40, ["senior analyst", "senior manager"]),
    (0.95, ["chairman", "& ceo", "ceo,", "ceo ", "president", "& coo", "coo,", "coo "]),
    (0.85, ["evp", "chief "]),
    (0.75, ["svp", "managing director"]),
    (0.65, [" vp"]),
    (0.50, ["director"]),
    (0.30, ["analyst", "manager", "specialist", "counsel"]),
    (0.20, ["associate"]),
    (0.15, ["junior associate", "coordinator", "assistant"]),
]
IMPACT_DEFAULT = 0.25

# Role category by words of the title, first match.
ROLE = [
    ("Legal", ["legal", "counsel", "attorney", "litigation"]),
    ("Trading", ["trading", "trader", "desk"]),
    ("Research", ["research", "quantitative", "analytics"]),
    ("Regulatory", ["regulatory", "government", "affairs"]),
    ("Operations", ["operations", "coordinator", "scheduling", "pipeline", "transportation"]),
    ("Communications", ["communications", " pr", "investor"]),
    ("Executive", ["ceo", "coo", "evp", "chairman", "president", " vp", "managing director"]),
]
ROLE_DEFAULT = "Administration"

# Department by whole words of the title, first match.
DEPARTMENT = [
    ("Executive", "ceo|president|coo|evp|chief|chairman|executive"),
    ("Executive", "vp"),
    ("Legal", "legal|counsel|attorney"),
    ("Trading", "trader|trading"),
    ("Operations", "analyst|associate|coordinator|specialist"),
    ("Administration", "assistant|secretary|administrative"),
]

# Learnability, automation and codification of topic categories, and the multiplier of a year.
AI_TOPICS = [
    ("Research & Quantitative Analysis", 72, 55, 80),
    ("California Energy Crisis", 30, 15, 12),
    ("Corporate Communications", 65, 40, 55),
    ("General Operations", 55, 65, 70),
    ("Executive Operations", 35, 30, 25),
    ("Legal — Transactional", 60, 45, 65),
    ("Document Mgmt & Admin", 80, 85, 90),
    ("Structured Finance & Derivatives", 68, 50, 60),
    ("Trading Operations", 58, 62, 55),
    ("Legal — Corporate Governance", 45, 25, 35),
    ("Government Relations", 20, 10, 8),
    ("HR & Personnel", 50, 55, 60),
    ("IT & Infrastructure", 70, 75, 85),
]
AI_YEARS = [(2024, 0.70), (2025, 0.85), (2026, 1.00), (2027, 1.15), (2028, 1.35), (2029, 1.50), (2030, 1.65), (2031, 1.75), (2032, 1.85)]
JUNIOR = ["associate", "junior", "assistant", "coordinator", "admin", "clerk", "analyst"]

# Recovery ramp of the twelve months after a departure.
RAMP = [0.40, 0.55, 0.65, 0.75, 0.82, 0.88, 0.93, 0.96, 0.98, 1.0, 1.0, 1.0]

# Alternatives of the local part of a system account.
SYSTEM_ACCOUNT = (
    r"(?i)(^[0-9]|bounce|newsletter|app-|noreply|no-reply|postmaster|mailer-daemon|listserv|autorespond|subscribe|unsubscribe|donotreply|notification|alert|daemon|system|support|service|info@|abuse@)"
)


def ladder(value: Column, steps: list[tuple], default, starts: dict | None = None) -> Column:
    """The first step one of whose words stands in ``value`` (already in lower case)."""
    out = F.lit(default)
    for result, words in reversed(steps):
        hit = F.lit(False)
        for w in words:
            hit = hit | value.contains(w)
        for prefix in (starts or {}).get(result, []):
            hit = hit | value.startswith(prefix)
        out = F.when(hit, F.lit(result)).otherwise(out)
    return out


def positional_impact(title: Column) -> Column:
    return F.when(title.isNull(), F.lit(IMPACT_DEFAULT)).otherwise(ladder(F.lower(title), IMPACT, IMPACT_DEFAULT, {0.65: ["vp"]}))


def role_category(title: Column, with_pr: bool = True) -> Column:
    steps = [(r, [w for w in words if with_pr or w != " pr"]) for r, words in ROLE]
    return F.when(title.isNull(), F.lit(ROLE_DEFAULT)).otherwise(ladder(F.lower(title), steps, ROLE_DEFAULT))


def department(title: Column, role: Column) -> Column:
    out = F.coalesce(role, F.lit("Administration"))
    for result, words in reversed(DEPARTMENT):
        out = F.when(F.lower(title).rlike(rf"\b({words})\b"), F.lit(result)).otherwise(out)
    return out


def ai_topics(spark: SparkSession, multiplier: float = 1.0) -> DataFrame:
    """category and automability = round half up of .40 L + .35 min(100, A * multiplier) + .25 C."""
    dim = spark.createDataFrame([(n, float(x), float(y), float(z)) for n, x, y, z in AI_TOPICS], "category string, l double, a double, c double")
    return dim.select("category", F.floor(0.40 * F.col("l") + 0.35 * F.least(F.lit(100.0), F.col("a") * multiplier) + 0.25 * F.col("c") + 0.5).cast("int").alias("automability"))
