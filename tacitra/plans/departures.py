"""Queries on departures, monthly series and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tacitra.operators import curves as V
from tacitra.operators import dims as D
from tacitra.operators import expertise as X
from tacitra.operators import graph as G
from tacitra.operators import simulate as S
from tacitra.plans.knowledge import _EP, profile
from tacitra.plans.network import _B, edges
from tacitra.plans.risks import _ROLE, _T, removed, titles, with_category
from tacitra.session import checkpointed
from tacitra.sources.tables import table

QUERIES, SQL = {}, {}
_LEAVE = "l AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 200)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def leaving(spark: SparkSession, sf: str, k: int = 200) -> DataFrame:
    """The departures to simulate: the ``k`` persons of highest risk (200 in the published study)."""
    return table(spark, sf, "risk_scores").orderBy(F.desc("risk_score"), F.asc("person")).limit(k).select("person")


def roles(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("person", D.role_category(F.col("title"), with_pr=False).alias("role"))


def ready(spark: SparkSession, sf: str, departed: DataFrame | None = None) -> DataFrame:
    return S.readiness(leaving(spark, sf) if departed is None else departed, profile(spark, sf), edges(spark, sf), roles(spark, sf))


_ROLE_S = _ROLE.replace(" OR contains(lower(title), ' pr')", "")
_READY = f"""WITH {_EP}, {_B}, {_T}, {_LEAVE}, ro AS (SELECT person, {_ROLE_S} AS role FROM t),
    o AS (SELECT ep.person AS departed, topic, score AS dep_score, cnt AS dep_cnt FROM ep JOIN l USING (person)),
    p AS (SELECT departed, o.topic, dep_score, dep_cnt, ep.person AS cand, ep.score FROM o JOIN ep ON ep.topic = o.topic AND ep.person <> departed),
    s AS (SELECT departed, cand, count(*) AS shared FROM p GROUP BY 1, 2), z AS (SELECT departed, count(*) AS n FROM o GROUP BY 1),
    w AS (SELECT person AS departed, partner AS cand, weight FROM b JOIN l USING (person)), mw AS (SELECT departed, max(weight) AS most FROM w GROUP BY 1),
    q AS (SELECT p.*, 0.4 * p.score + 0.3 * shared / n + 0.3 * coalesce(weight / most, 0) AS raw, coalesce(a.role, 'Administration') = coalesce(c.role, 'Administration') AS same_role
      FROM p JOIN s USING (departed, cand) JOIN z USING (departed) LEFT JOIN w USING (departed, cand) LEFT JOIN mw USING (departed) LEFT JOIN ro a ON a.person = departed LEFT JOIN ro c ON c.person = cand),
    rd AS (SELECT departed, topic, cand, score, same_role, round_even(round(CASE WHEN same_role THEN raw ELSE least(raw, 0.15) END, 9), 4) AS readiness FROM q)"""


@query(_READY + " SELECT departed, topic, cand, same_role, readiness FROM rd")
def successor_readiness(spark, sf):
    return ready(spark, sf).select("departed", "topic", "cand", "same_role", "readiness")


@query(_READY + " SELECT departed, topic, CAST(rk AS INT) AS rk, cand, readiness FROM (SELECT departed, topic, cand, readiness, row_number() OVER (PARTITION BY departed, topic ORDER BY readiness DESC, cand) AS rk FROM rd) WHERE rk <= 10")
def successors(spark, sf):
    """The ten readiest successors of each topic."""
    return S.successors(ready(spark, sf)).select("departed", "topic", "rk", "cand", "readiness")


@query(
    _READY + """, f AS (SELECT departed, topic FROM (SELECT departed, topic, row_number() OVER (PARTITION BY departed ORDER BY topic) AS i FROM (SELECT DISTINCT departed, topic FROM rd)) WHERE i <= 5),
    b5 AS (SELECT departed, topic, max(readiness) FILTER (same_role) AS best FROM rd GROUP BY 1, 2)
    SELECT departed, round_even(avg(CASE WHEN coalesce(best, 0) <= 0.30 THEN 1.0 ELSE 0.0 END), 4) AS external_hire_gap FROM f JOIN b5 USING (departed, topic) GROUP BY departed"""
)
def external_hire_gap(spark, sf):
    return S.hire_gap(ready(spark, sf))


def routing(spark: SparkSession, sf: str) -> DataFrame:
    return S.simulate(S.candidates(ready(spark, sf), profile(spark, sf), edges(spark, sf)))


@query(None)
def simulation_timeline(spark, sf):
    return S.timeline(routing(spark, sf))


@query(None)
def simulation_losses(spark, sf):
    return V.permanent_loss(S.topic_quality(routing(spark, sf)))


@query(None)
def simulation_log(spark, sf):
    """The routing log as reported: twenty entries a month, five thousand a departure, with the class of each."""
    log = S.capped_log(routing(spark, sf))
    return log.select("departed", "month", "topic", "seq", "step", "agent", F.round("ratio", 6).alias("ratio"), V.log_class(F.col("ratio"), F.col("step")).alias("kind"))


@query(None)
def simulation_summary(spark, sf):
    """Final recovery, plateau and lasting losses of each departure."""
    log = checkpointed(routing(spark, sf))
    months = S.timeline(log)
    final = months.groupBy("departed").agg(F.bround(F.sum("recovery_rate") / 12, 4).alias("final_recovery"))
    flat = V.plateau_month(months.select(F.col("departed").alias("person"), "month", F.col("recovery_rate").alias("rate"))).withColumnRenamed("person", "departed")
    lost = V.permanent_loss(S.topic_quality(log)).groupBy(F.col("person").alias("departed")).agg(F.count(F.lit(1)).alias("n_lost"))
    return final.join(flat, "departed").join(lost, "departed", "left").fillna(0, subset=["n_lost"])


def lost_categories(spark: SparkSession, sf: str, departed: DataFrame, log: DataFrame) -> DataFrame:
    top = X.top_k(profile(spark, sf).join(departed.select("person"), "person", "left_semi"), ["person"], [F.desc("score"), F.asc("topic")], 10)
    return S.loss_categories(departed, with_category(top), with_category(V.permanent_loss(S.topic_quality(log))))


@query(None)
def loss_categories(spark, sf):
    """Lasting-loss categories of each departure within its ten first topics."""
    return lost_categories(spark, sf, leaving(spark, sf), routing(spark, sf))


@query(None)
def loss_integrity(spark, sf):
    """One row: departures checked, and those with fewer than 0 or more lost categories than all, or none at all."""
    n, total = F.col("n_perm_loss_categories"), F.col("total_categories")
    return loss_categories(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if((n < 0) | (n > total) | (total < 1)).alias("n_broken"))


@query(None)
def cascade_metrics(spark, sf):
    """Hire gap, recovery and lasting losses of the queue of departures together."""
    gone = removed(spark, sf)
    able = checkpointed(ready(spark, sf, gone))
    log = checkpointed(S.simulate(S.candidates(able, profile(spark, sf), edges(spark, sf))))
    return S.combined_metrics(gone, S.hire_gap(able), S.timeline(log), lost_categories(spark, sf, gone, log))


# Monthly series of the orders: twelve months of a customer, the rate being the share of the largest month.
_CURVE = """o AS (SELECT o_custkey AS person, CAST(month(o_orderdate) AS INT) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), cu AS (SELECT person, month, round(v / max(v) OVER (PARTITION BY person), 4) AS rate FROM o)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return o.select("person", "month", F.round(F.col("v") / F.max("v").over(Window.partitionBy("person")), 4).alias("rate"))


@query(
    f"""WITH {_CURVE}, s AS (SELECT person, row_number() OVER w AS i, abs(rate - lag(rate) OVER w) AS d FROM cu WINDOW w AS (PARTITION BY person ORDER BY month)),
    l AS (SELECT person, max(i) AS n, coalesce(max(CASE WHEN d >= 0.1 THEN i - 1 END), 0) AS j FROM s GROUP BY person)
    SELECT person, CAST(CASE WHEN j <= n - 2 THEN j + 1 END AS INT) AS plateau_month FROM l"""
)
def plateau_month(spark, sf):
    return V.plateau_month(curves(spark, sf), step=0.1)


@query(f"WITH {_CURVE}, s AS (SELECT person, month, abs(rate - lag(rate) OVER (PARTITION BY person ORDER BY month)) AS d FROM cu) SELECT person, coalesce(min(month) FILTER (d < 0.05), 12) AS flat_month FROM s GROUP BY person")
def plateau_first(spark, sf):
    return V.first_flat_month(curves(spark, sf), step=0.05)


@query(
    f"""WITH {_CURVE}, m AS (SELECT person, 1 AS topic, month, rate AS q FROM cu), f AS (SELECT person, topic, month, max(q) OVER w AS most, count(*) OVER w AS n FROM m
    WINDOW w AS (PARTITION BY person, topic ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT person, topic, min(month) AS month FROM f WHERE most < 0.3 AND n = 2 GROUP BY 1, 2"""
)
def permanent_loss(spark, sf):
    q = curves(spark, sf).select("person", F.lit(1).alias("topic"), "month", F.col("rate").alias("q"))
    return V.permanent_loss(q, below=0.3, frame=2)


@query(f"WITH {_CURVE}, a AS (SELECT person, list(rate ORDER BY month) AS r FROM cu GROUP BY person) SELECT person, array_to_string(list_transform(list_slice(list_concat(r, list_transform(range(12), lambda x: r[-1])), 1, 12), lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS series FROM a")
def curve_padding(spark, sf):
    """The series filled to twelve values with the last one (as whole ten-thousandths)."""
    a = curves(spark, sf).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "rate"))), lambda x: x["rate"]).alias("r"))
    return a.select("person", F.array_join(F.transform(V.padded(F.col("r")), lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",").alias("series"))


@query(f"WITH {_CURVE} SELECT person, 1 AS topic, month, round(max(rate) OVER (PARTITION BY person ORDER BY month), 4) AS best FROM cu")
def running_best(spark, sf):
    q = curves(spark, sf).select("person", F.lit(1).alias("topic"), "month", F.col("rate").alias("q"))
    return V.running_best(q).select("person", "topic", "month", F.round("best", 4).alias("best"))


@query(
    f"""WITH {_CURVE}, l AS (SELECT person, month FROM cu WHERE rate < 0.1), p AS (SELECT DISTINCT person FROM l)
    SELECT p.person, CAST(m AS INT) AS month, (SELECT count(*) FROM l WHERE l.person = p.person AND l.month <= m) AS n FROM p, range(1, 13) r(m)"""
)
def cumulative_losses(spark, sf):
    return V.cumulative_losses(curves(spark, sf).where("rate < 0.1").select("person", "month"))


@query(f"WITH {_CURVE}, s AS (SELECT person, month, CASE WHEN rate >= 0.35 THEN 'recovered' WHEN rate >= 0.10 THEN 'partial' ELSE 'lost' END AS status FROM cu) SELECT month, count(*) FILTER (status = 'recovered') AS n_recovered, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'lost') AS n_lost FROM s WHERE month IN (1, 6, 12) GROUP BY month")
def milestone_status(spark, sf):
    s = curves(spark, sf).where(F.col("month").isin(1, 6, 12)).select("month", V.status(F.col("rate"), F.lit(1)).alias("status"))
    return s.groupBy("month").agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("recovered", "partial", "lost")])


@query(
    _READY + """, good AS (SELECT departed, cand AS best_cand, max(readiness) AS best FROM rd GROUP BY 1, 2), k AS (SELECT departed, partner, weight FROM b JOIN l ON b.person = l.person, (SELECT 1) , LATERAL (SELECT l.person AS departed))
    SELECT departed, CAST(rk AS INT) AS rk, partner, weight FROM (SELECT k.*, row_number() OVER (PARTITION BY departed ORDER BY weight DESC, partner) AS rk FROM k
      WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.departed = k.departed AND best_cand = k.partner AND best > 0.30)) WHERE rk <= 3"""
)
def cross_training(spark, sf):
    """The three closest partners of a departing person who are no ready successors yet."""
    have = ready(spark, sf).groupBy("departed", F.col("cand").alias("partner")).agg(F.max("readiness").alias("best")).where("best > 0.30").select("departed", "partner")
    near = G.symmetric(edges(spark, sf)).withColumnRenamed("person", "departed").join(leaving(spark, sf).withColumnRenamed("person", "departed"), "departed", "left_semi")
    return X.top_k(near.join(have, ["departed", "partner"], "left_anti"), ["departed"], [F.desc("weight"), F.asc("partner")], 3).select("departed", "rk", "partner", "weight")


@query(None)
def person_records(spark, sf):
    """One nested record a person: role, partners, topics, successors."""
    p = profile(spark, sf)
    topics = X.top_k(p, ["person"], [F.desc("score"), F.asc("topic")], 10).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rk", "topic", "score"))).alias("topics"))
    partners = G.top_partners(edges(spark, sf), 6).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("rk", "partner", "weight"))).alias("partners"))
    next_ones = S.successors(ready(spark, sf), 3).groupBy(F.col("departed").alias("person")).agg(F.array_sort(F.collect_list(F.struct("topic", "rk", "cand", "readiness"))).alias("successors"))
    base = table(spark, sf, "risk_scores").select("person", F.round("risk_score", 6).alias("risk_score"), "simulated")
    role = titles(spark, sf).select("person", "title", D.role_category(F.col("title")).alias("role"))
    out = base.join(role, "person", "left").join(topics, "person", "left").join(partners, "person", "left").join(next_ones, "person", "left")
    return out.select("person", "risk_score", "simulated", "title", F.coalesce("role", F.lit("Administration")).alias("role"), F.to_json("topics").alias("topics"), F.to_json("partners").alias("partners"), F.to_json("successors").alias("successors"))
