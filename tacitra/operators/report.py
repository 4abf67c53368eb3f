"""Report forms: labels, buckets, first and last words, searches, coverage and projections as column expressions and small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitra.operators.expertise import top_k


def first_word(name: Column) -> Column:
    return F.get(F.split(F.trim(name), r"\s+"), F.lit(0))


def last_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def first_words(words: Column, k: int, sign: str = ", ") -> Column:
    return F.array_join(F.slice(words, 1, k), sign)


def shortened(text: Column, most: int = 30, kept: int = 28) -> Column:
    """Texts of more than ``most`` characters cut to ``kept`` and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def unbroken(text: Column) -> Column:
    """Hyphens that allow no line break."""
    return F.translate(text, "-", "‑")


def topic_label(category: Column, words: Column, topic: Column, k: int = 4) -> Column:
    """Category, else the first words, else 'Topic N', else a dash."""
    return F.coalesce(category, F.nullif(first_words(words, k), F.lit("")), F.concat(F.lit("Topic "), topic.cast("string")), F.lit("—"))


def topic_id(text: Column) -> Column:
    """The whole number that a topic was written as ('7', '7.0', ' 7 '), as text; null where it is none."""
    return F.trim(text).try_cast("double").try_cast("bigint").cast("string")


def bucket(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The first label whose bound ``value`` reaches."""
    out = F.lit(default)
    for least, label in reversed(steps):
        out = F.when(value >= least, F.lit(label)).otherwise(out)
    return out


def above(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The first label whose bound ``value`` exceeds."""
    out = F.lit(default)
    for bound, label in reversed(steps):
        out = F.when(value > bound, F.lit(label)).otherwise(out)
    return out


def percent(value: Column, places: int = 0) -> Column:
    return F.concat(F.format_number(F.round(value * 100, places), places), F.lit("%"))


def letter_sum(name: Column, modulus: int = 4) -> Column:
    """The sum of the character codes modulo ``modulus``: which variant of a text a person gets."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda s, c: s + c) % modulus


def matches(query: str, *columns: Column) -> Column:
    """Whether ``query`` stands in any of the columns, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return hit


def coverage(lost: Column, readiness: Column) -> Column:
    """State of a topic of a departed person: lost for good, or by the readiness of the best successor."""
    return F.when(F.coalesce(lost, F.lit(False)), "Lost").otherwise(bucket(F.coalesce(readiness, F.lit(0.0)), [(0.50, "Covered"), (0.25, "At Risk")], "Vulnerable"))


def projection(recovery: Column, losses: Column) -> tuple[Column, Column]:
    """(recovery, lasting losses) if something is done: 1.85 times the recovery, .92 at most; three tenths of the losses, one at least."""
    return F.least(recovery * 1.85, F.lit(0.92)), F.greatest(F.lit(1.0), F.floor(losses * 0.3 + 0.5).cast("double"))


def margins(df: DataFrame, group: str, value: str, share: float = 0.05, least: float = 0.02) -> DataFrame:
    """(group, low, high): the range of a value widened by a share of it, ``least`` at least on each side."""
    span = F.greatest((F.max(value) - F.min(value)) * share, F.lit(least))
    return df.groupBy(group).agg((F.min(value) - span).alias("low"), (F.max(value) + span).alias("high"))


def log_sizes(df: DataFrame, value: str, smallest: float = 3.0, largest: float = 21.0) -> DataFrame:
    """Adds ``size``: log(1 + value), values below 1 taken as 1, scaled to the range; the smallest where all are equal."""
    log = df.withColumn("_log", F.log1p(F.greatest(F.coalesce(F.col(value), F.lit(1.0)), F.lit(1.0)).cast("double")))
    ends = log.agg(F.min("_log").alias("_lo"), F.max("_log").alias("_hi"))
    part = F.coalesce(F.try_divide(F.col("_log") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0))
    return log.crossJoin(F.broadcast(ends)).withColumn("size", smallest + (largest - smallest) * part).drop("_log", "_lo", "_hi")


def prefixes(series: DataFrame, key: str, values: str) -> DataFrame:
    """(key, i, values): the first i values of a series for each i, as the frames of an animation."""
    return series.select(key, F.explode(F.sequence(F.lit(1), F.size(values))).alias("i"), F.col(values).alias("_v")).where("i > 0").select(key, "i", F.slice("_v", F.lit(1), F.col("i")).alias(values))


def first_categories(profile: DataFrame, k: int) -> DataFrame:
    """(person, category): the different categories among the ``k`` first topics of a person by score."""
    return top_k(profile, ["person"], [F.desc("score"), F.asc("topic")], k).select("person", "category").distinct()


def gap_categories(categories: DataFrame, people: DataFrame, k: int = 8, holders: int = 2) -> DataFrame:
    """(category, gap, holders, n_holders): the largest gap of those who hold a category and the riskiest holders, the ``k`` widest gaps.

    ``people`` (person, risk, gap). Holders are reduced to the riskiest before they are gathered.
    """
    held = categories.join(people, "person")
    gaps = held.groupBy("category").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n_holders")).where("gap > 0").orderBy(F.desc("gap"), F.asc("category")).limit(k)
    first = top_k(held, ["category"], [F.desc("risk"), F.asc("person")], holders)
    names = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "person"))), lambda x: x["person"]), ", ").alias("holders"))
    return gaps.join(names, "category")


def fallback_categories(people: DataFrame, overrides: DataFrame, domains: DataFrame, roles: dict[str, str], default: str) -> DataFrame:
    """(person, category) of people (person, role) without a profile: an override by local part, else their domain's, else their role's category."""
    low = F.lower(F.col("person"))
    keyed = people.select("person", "role", F.substring_index(low, "@", 1).alias("local"), F.when(low.contains("@"), F.substring_index(low, "@", -1)).alias("domain"))
    of_role = F.lit(default)
    for role, category in roles.items():
        of_role = F.when(F.col("role") == role, F.lit(category)).otherwise(of_role)
    out = keyed.join(overrides.select("local", F.col("category").alias("o")), "local", "left").join(domains.select("domain", F.col("category").alias("d")), "domain", "left")
    return out.select("person", F.coalesce("o", "d", of_role).alias("category"))
