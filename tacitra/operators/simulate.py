"""Twelve months after a departure: who takes the requests, what is recovered, what is lost for good.

A relational candidate table (one row per departed person, topic and candidate) is built with joins; the month loop,
whose capacity and learning state is sequential within one departure, runs per departed person in Arrow batches; all
results are plain aggregations of its long log.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacitra.operators.dims import RAMP
from tacitra.operators.expertise import bandwidth, inferred_profile, request_schedule, top_k
from tacitra.operators.graph import neighbour_tiers, symmetric

LOG = "departed string, month int, topic int, seq int, step int, quality string, agent string, base_ratio double, readiness double, ramp double, ratio double, upgraded boolean, n_requests int"
_PENALTY = {1: 1.0, 2: 0.7}


def departed_profile(departed: DataFrame, profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(person, topic, cnt, score) of the departed; who has no profile of the own gets the one inferred from the neighbours."""
    who = departed.select("person")
    own = profile.join(who, "person", "left_semi").select("person", "topic", "cnt", "score")
    near = symmetric(edges).join(who.join(own.select("person").distinct(), "person", "left_anti"), "person", "left_semi").select("person", F.col("partner").alias("neighbour"))
    return own.unionByName(inferred_profile(near, profile).where("score IS NOT NULL"))


def readiness(departed: DataFrame, profile: DataFrame, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(departed, topic, cand, score, readiness): .4 score + .3 shared topics + .3 closeness; other roles at most .15."""
    dep = departed.select(F.col("person").alias("departed"))
    own = departed_profile(departed, profile, edges).toDF("departed", "topic", "dep_cnt", "dep_score")
    pairs = own.join(profile.select(F.col("person").alias("cand"), "topic", "score"), "topic").where("cand != departed")
    overlap = pairs.groupBy("departed", "cand").agg(F.count(F.lit(1)).alias("shared"))
    size = own.groupBy("departed").agg(F.count(F.lit(1)).alias("n_topics"))
    near = symmetric(edges).select(F.col("person").alias("departed"), F.col("partner").alias("cand"), "weight").join(dep, "departed", "left_semi")
    most = near.groupBy("departed").agg(F.max("weight").alias("most"))
    role = roles.select("person", "role")
    out = (
        pairs.join(overlap, ["departed", "cand"]).join(size, "departed").join(near, ["departed", "cand"], "left").join(most, "departed", "left")
        .join(role.toDF("departed", "dep_role"), "departed", "left").join(role.toDF("cand", "cand_role"), "cand", "left")
    )
    raw = 0.4 * F.col("score") + 0.3 * F.col("shared") / F.col("n_topics") + 0.3 * F.coalesce(F.try_divide("weight", "most"), F.lit(0.0))
    same = F.coalesce(F.col("dep_role"), F.lit("Administration")) == F.coalesce(F.col("cand_role"), F.lit("Administration"))
    return out.select("departed", "topic", "dep_score", "dep_cnt", "cand", "score", same.alias("same_role"), F.bround(F.round(F.when(same, raw).otherwise(F.least(raw, F.lit(0.15))), 9), 4).alias("readiness"))


def candidates(ready: DataFrame, profile: DataFrame, edges: DataFrame, near: float = 5, far: float = 3) -> DataFrame:
    """What the month loop needs. Candidates whose penalised first score is 0.4 or less can never take a request."""
    tiers = neighbour_tiers(edges, near, far).select(F.col("person").alias("departed"), F.col("neighbour").alias("cand"), "tier")
    can = ready.join(tiers, ["departed", "cand"]).join(bandwidth(profile).select(F.col("person").alias("cand"), "bandwidth"), "cand")
    can = can.where(F.col("score") * F.when(F.col("tier") == 1, 1.0).otherwise(0.7) > 0.4)
    topics = request_schedule(ready.select("departed", "topic", "dep_score", F.col("dep_cnt").alias("cnt")).distinct()).select("departed", "topic", "dep_score", "n_requests")
    return topics.join(can.select("departed", "topic", "cand", "score", "tier", "bandwidth", "readiness"), ["departed", "topic"], "left")


def _months(pdf: pd.DataFrame) -> pd.DataFrame:
    departed = pdf.departed.iloc[0]
    topics = pdf.drop_duplicates("topic").sort_values("topic")
    can = pdf[pdf.cand.notna()]
    room = can.drop_duplicates("cand").set_index("cand").bandwidth.to_dict()
    lists, know, ready, memory = {}, {}, {}, {}
    for topic, part in can.groupby("topic"):
        part = part.sort_values(["score", "cand"], ascending=[False, True])
        lists[topic] = [(c, int(t)) for c, t in zip(part.cand, part.tier)]
        for c, s, r in zip(part.cand, part.score, part.readiness):
            know[c, topic], ready[c, topic], memory[c, topic] = s, r, 0.0
    log, seq = [], 0
    for month in range(1, 13):
        used = dict.fromkeys(room, 0)
        for topic, dep_score, n in zip(topics.topic, topics.dep_score, topics.n_requests):
            for _ in range(int(n)):
                best: dict[int, tuple[float, str]] = {}
                for c, tier in lists.get(topic, ()):
                    if used[c] >= room[c]:
                        continue
                    eff = min(1.0, know[c, topic] + memory[c, topic]) * _PENALTY[tier]
                    if eff > 0.4 and (tier not in best or eff > best[tier][0]):
                        best[tier] = (eff, c)
                seq += 1
                if not best:
                    log.append((departed, month, topic, seq, 4, "none", None, 0.0, 0.0, RAMP[month - 1], 0.0, False, n))
                    continue
                tier = min(best)
                eff, c = best[tier]
                base = min(1.0, min(1.0, know[c, topic] + memory[c, topic]) / dep_score) if dep_score else 0.0
                full = eff > 0.7
                used[c] += 1
                memory[c, topic] = min(1.0, memory[c, topic] + (0.03 if full else 0.015))
                up = memory[c, topic] >= 0.30 and memory[c, topic] > know[c, topic]
                if up:
                    know[c, topic] = memory[c, topic]
                    lists[topic].sort(key=lambda x: -know[x[0], topic])
                log.append((departed, month, topic, seq, tier, "full" if full else "partial", c, base, ready[c, topic], RAMP[month - 1], base * ready[c, topic] * RAMP[month - 1], up, n))
    return pd.DataFrame(log, columns=[x.split()[0] for x in LOG.split(", ")])


def simulate(candidate_table: DataFrame) -> DataFrame:
    """The routing log of all departures; each departure starts from the same state, so they run apart."""
    return candidate_table.groupBy("departed").applyInPandas(_months, LOG)


def timeline(log: DataFrame) -> DataFrame:
    """Per departed person and month: requests, recovered, lost, rates, upgrades."""
    return log.groupBy("departed", "month").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("step") < 4).alias("n_recovered"), F.count_if(F.col("step") == 4).alias("n_lost"),
        F.bround(F.sum("ratio") / F.count(F.lit(1)), 4).alias("recovery_rate"), F.bround(F.avg((F.col("step") == 4).cast("double")), 4).alias("loss_rate"), F.count_if("upgraded").alias("upgrades"),
    )


def topic_quality(log: DataFrame) -> DataFrame:
    """(person, topic, month, q): the mean ratio of a topic's requests in a month."""
    return log.groupBy(F.col("departed").alias("person"), "topic", "month").agg((F.sum("ratio") / F.max("n_requests")).alias("q"))


def successors(ready: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` readiest candidates of each departed person's topics."""
    return top_k(ready, ["departed", "topic"], [F.desc("readiness"), F.asc("cand")], k)


def hire_gap(ready: DataFrame, topics: int = 5, qualified: float = 0.30) -> DataFrame:
    """Share of a departed person's first topics (by number) for which nobody of the same role is ready."""
    first = ready.select("departed", "topic").distinct().withColumn("i", F.row_number().over(Window.partitionBy("departed").orderBy("topic"))).where(F.col("i") <= topics)
    good = ready.groupBy("departed", "topic").agg(F.max(F.when(F.col("same_role"), F.col("readiness"))).alias("best"))
    return first.join(good, ["departed", "topic"]).groupBy("departed").agg(F.bround(F.avg((F.coalesce("best", F.lit(0.0)) <= qualified).cast("double")), 4).alias("external_hire_gap"))


def capped_log(log: DataFrame, per_month: int = 20, whole: int = 5000) -> DataFrame:
    """The report form of the log: the first entries of each month, within the first entries of a departure."""
    w = Window.partitionBy("departed", "month").orderBy("seq")
    return log.where(F.col("seq") <= whole).withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_month)


def loss_categories(departed: DataFrame, top: DataFrame, losses: DataFrame, default: str = "General Operations") -> DataFrame:
    """(departed, n_perm_loss_categories, total_categories): lasting losses within the categories of the person's first topics.

    ``top`` (person, category) are those topics, ``losses`` (person, category) the lost ones; who has no topic counts with ``default``.
    """
    dep = departed.select("person")
    mine = dep.join(top.select("person", "category").distinct(), "person", "left").select("person", F.coalesce("category", F.lit(default)).alias("category"))
    lost = mine.join(losses.select("person", "category").distinct().withColumn("lost", F.lit(1)), ["person", "category"], "left")
    return lost.groupBy(F.col("person").alias("departed")).agg(F.count("lost").alias("n_perm_loss_categories"), F.count(F.lit(1)).alias("total_categories"))


def combined_metrics(removed: DataFrame, gaps: DataFrame, months: DataFrame, losses: DataFrame, fewest: int = 2, most: int = 5) -> DataFrame:
    """One row of a queue of departures: mean hire gap (whole percent each), 0.7 of the mean last recovery in percent, lasting-loss categories.

    A departure without a value counts 0; a queue of fewer than ``fewest`` or more than ``most`` persons is refused.
    """
    last = months.where("month = 12").select("departed", "recovery_rate")
    j = removed.select(F.col("person").alias("departed")).join(gaps, "departed", "left").join(last, "departed", "left").join(losses, "departed", "left")
    out = j.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.floor(F.coalesce("external_hire_gap", F.lit(0.0)) * 100 + 0.5)).alias("avg_hire_gap"),
        (F.avg(F.coalesce("recovery_rate", F.lit(0.0)) * 100) * 0.7).alias("avg_recovery_12"), F.sum(F.coalesce("n_perm_loss_categories", F.lit(0))).alias("total_perm_loss_categories"),
    )
    refused = F.raise_error(F.concat(F.lit("combined_metrics: a queue has 2 to 5 persons, not "), F.col("n").cast("string")))
    return out.select(F.when(F.col("n").between(fewest, most), F.col("n")).otherwise(refused.cast("bigint")).alias("n"), "avg_hire_gap", "avg_recovery_12", "total_perm_loss_categories")
