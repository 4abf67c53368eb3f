"""Queries of the report, the person pages and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitra.operators import cascade as C
from tacitra.operators import curves as V
from tacitra.operators import dims as D
from tacitra.operators import expertise as X
from tacitra.operators import graph as G
from tacitra.operators import identity as I
from tacitra.operators import report as P
from tacitra.operators import risk as R
from tacitra.operators import simulate as S
from tacitra.plans import departures as L
from tacitra.plans import knowledge as N
from tacitra.plans import risks as K
from tacitra.plans.knowledge import _EP, profile
from tacitra.plans.network import _B, edges
from tacitra.plans.texts import _PEOPLE, addresses
from tacitra.session import checkpointed
from tacitra.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- the report ---------------------------------------------------------------------------------------------------------

_GAPS = """f5 AS (SELECT departed, topic FROM (SELECT departed, topic, row_number() OVER (PARTITION BY departed ORDER BY topic) AS i FROM (SELECT DISTINCT departed, topic FROM rd)) WHERE i <= 5),
    b5 AS (SELECT departed, topic, max(readiness) FILTER (same_role) AS best FROM rd GROUP BY 1, 2),
    hg AS (SELECT departed AS person, round_even(avg(CASE WHEN coalesce(best, 0) <= 0.30 THEN 1.0 ELSE 0.0 END), 4) AS gap FROM f5 JOIN b5 USING (departed, topic) GROUP BY departed)"""
_PEOPLE_Q = f"q0 AS (SELECT r.person, risk_score, weighted_degree, coalesce(t.impact, 0.25) AS impact FROM risk_scores r LEFT JOIN (SELECT person, {K._IMPACT} AS impact FROM t) t USING (person)), qq AS (SELECT *, {K._Q} AS quadrant FROM q0)"
_TOP4 = "c4 AS (SELECT DISTINCT person, category FROM (SELECT person, category, row_number() OVER (PARTITION BY person ORDER BY score DESC, topic) AS rk FROM c) WHERE rk <= 4)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """(person, risk_score, impact, quadrant, gap): everyone with the hire gap of the simulated departures."""
    return K.quadrants(spark, sf).join(S.hire_gap(L.ready(spark, sf)).toDF("person", "gap"), "person", "left")


@query(
    f"""{L._READY}, {_GAPS}, {_PEOPLE_Q} SELECT person, quadrant, format('{{:.1f}}%', round(risk_score * 100, 1)) AS risk, CASE WHEN risk_score > 0.3 THEN 'high' WHEN risk_score > 0.15 THEN 'raised' ELSE 'normal' END AS risk_level,
    CASE WHEN gap > 0.6 THEN 'Critical' WHEN gap > 0.3 THEN 'High' ELSE 'Moderate' END AS gap_level FROM qq LEFT JOIN hg USING (person) WHERE quadrant IN ('Organizational Emergency', 'Silent Threat') ORDER BY risk_score DESC, person LIMIT 12"""
)
def critical_people(spark, sf):
    """The twelve riskiest of the two critical quadrants, with the labels of the report."""
    q = people(spark, sf).where(F.col("quadrant").isin(*R.QUADRANTS[:2])).orderBy(F.desc("risk_score"), F.asc("person")).limit(12)
    levels = P.above(F.col("risk_score"), [(0.3, "high"), (0.15, "raised")], "normal"), P.above(F.col("gap"), [(0.6, "Critical"), (0.3, "High")], "Moderate")
    return q.select("person", "quadrant", P.percent(F.col("risk_score"), 1).alias("risk"), levels[0].alias("risk_level"), levels[1].alias("gap_level"))


@query(f"{L._READY}, {_GAPS}, {_PEOPLE_Q} SELECT count(*) AS n_critical, round(avg(coalesce(gap, 0)), 6) AS avg_gap, count(*) FILTER (coalesce(gap, 0) > 0.6) AS n_wide FROM qq LEFT JOIN hg USING (person) WHERE quadrant IN ('Organizational Emergency', 'Silent Threat')")
def critical_summary(spark, sf):
    q, gap = people(spark, sf).where(F.col("quadrant").isin(*R.QUADRANTS[:2])), F.coalesce("gap", F.lit(0.0))
    return q.agg(F.count(F.lit(1)).alias("n_critical"), F.round(F.avg(gap), 6).alias("avg_gap"), F.count_if(gap > 0.6).alias("n_wide"))


@query(
    f"""{L._READY}, {_GAPS}, {K._CAT}, {_TOP4}, h AS (SELECT category, c4.person, risk_score, coalesce(gap, 0) AS gap FROM c4 JOIN risk_scores r ON r.person = c4.person LEFT JOIN hg ON hg.person = c4.person),
    g AS (SELECT category, max(gap) AS gap, count(*) AS n_holders FROM h GROUP BY category HAVING max(gap) > 0 ORDER BY 2 DESC, 1 LIMIT 8),
    n AS (SELECT category, string_agg(person, ', ' ORDER BY rk) AS holders FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY risk_score DESC, person) AS rk FROM h) WHERE rk <= 2 GROUP BY category)
    SELECT category, round(gap, 6) AS gap, n_holders, holders, CASE WHEN round(gap * 100) > 60 THEN 'Critical' WHEN round(gap * 100) > 30 THEN 'High' ELSE 'Moderate' END AS status FROM g JOIN n USING (category)"""
)
def gap_categories(spark, sf):
    """The eight categories with the widest hire gaps and their two riskiest holders."""
    who = people(spark, sf).select("person", F.col("risk_score").alias("risk"), F.coalesce("gap", F.lit(0.0)).alias("gap"))
    out = P.gap_categories(P.first_categories(K.with_category(profile(spark, sf)), 4), who)
    return out.select("category", F.round("gap", 6).alias("gap"), "n_holders", "holders", P.above(F.round(F.col("gap") * 100), [(60, "Critical"), (30, "High")], "Moderate").alias("status"))


@query(
    f"""WITH {K._T}, {_PEOPLE_Q} SELECT arg_min(person, row(-risk_score, person)) AS highest_risk, arg_min(person, row(-risk_score, person)) FILTER (quadrant = 'Silent Threat') AS top_silent,
    arg_min(person, row(-coalesce(weighted_degree, 0), person)) FILTER (impact >= 0.65) AS best_connected FROM qq"""
)
def champions(spark, sf):
    """The person of highest risk, the top silent threat and the best connected executive."""
    q = K.quadrants(spark, sf).join(table(spark, sf, "risk_scores").select("person", "weighted_degree"), "person")
    by_risk, by_links = F.struct(-F.col("risk_score"), F.col("person")), F.struct(-F.coalesce("weighted_degree", F.lit(0.0)), F.col("person"))
    return q.agg(
        F.min_by("person", by_risk).alias("highest_risk"), F.min_by(F.when(F.col("quadrant") == "Silent Threat", F.col("person")), F.when(F.col("quadrant") == "Silent Threat", by_risk)).alias("top_silent"),
        F.min_by("person", F.when(F.col("impact") >= 0.65, by_links)).alias("best_connected"),
    )


@query(
    f"""WITH {_EP}, {K._CAT}, {K._GONE}, k AS (SELECT DISTINCT person, category FROM c), b AS (SELECT k.category, 0.015 + 0.008 * i AS boost FROM k JOIN g USING (person)),
    s AS (SELECT person, sum(boost) AS boost FROM k JOIN b USING (category) GROUP BY person),
    v AS (SELECT r.person, risk_score, least(0.95, risk_score + coalesce(boost, 0)) AS live FROM risk_scores r LEFT JOIN s USING (person) WHERE r.person NOT IN (SELECT person FROM g))
    SELECT person, round((live - risk_score) * 100, 6) AS increase FROM v WHERE round((live - risk_score) * 100, 9) > 0.05 ORDER BY round((live - risk_score) * 100, 9) DESC, person LIMIT 5"""
)
def most_affected(spark, sf):
    """The five persons whose risk rises most once the queue of departures is gone (by more than .05 points)."""
    who = table(spark, sf, "risk_scores").select("person", F.col("risk_score").alias("risk"))
    live = C.live_risk(who, K.with_category(profile(spark, sf)), K.removed(spark, sf)).join(who, "person")
    rise = live.select("person", F.round((F.col("live_risk") - F.col("risk")) * 100, 9).alias("increase")).where("increase > 0.05")
    return rise.orderBy(F.desc("increase"), F.asc("person")).limit(5).select("person", F.round("increase", 6).alias("increase"))


@query(f"WITH {L._CURVE} SELECT round(avg(rate), 6) AS recovery, count(*) FILTER (rate < 0.3) AS losses, round(least(avg(rate) * 1.85, 0.92), 6) AS good_recovery, greatest(1.0, floor(count(*) FILTER (rate < 0.3) * 0.3 + 0.5))::DOUBLE AS good_losses FROM cu WHERE month = 12")
def scenario_projection(spark, sf):
    """What the last month's recovery and losses would be if something were done (over the monthly series of the orders)."""
    now = L.curves(spark, sf).where("month = 12").agg(F.avg("rate").alias("r"), F.count_if(F.col("rate") < 0.3).alias("losses"))
    recovery, losses = P.projection(F.col("r"), F.col("losses"))
    return now.select(F.round("r", 6).alias("recovery"), "losses", F.round(recovery, 6).alias("good_recovery"), losses.alias("good_losses"))


# -- automation ---------------------------------------------------------------------------------------------------------

_EXPOSED = K.SQL["ai_exposure"]


@query(f"SELECT round(avg(exposure), 6) AS exposure, round(avg(residual), 6) AS residual, count(*) FILTER (ai_quadrant = 'Critical Human Capital') AS n_critical, count(*) FILTER (ai_quadrant = 'Automation Candidate') AS n_automation, count(*) FILTER (ai_quadrant = 'Transition Risk') AS n_transition, count(*) FILTER (ai_quadrant = 'Stable') AS n_stable FROM ({_EXPOSED})")
def ai_summary(spark, sf):
    kinds = {"n_critical": "Critical Human Capital", "n_automation": "Automation Candidate", "n_transition": "Transition Risk", "n_stable": "Stable"}
    return K.ai_exposure(spark, sf).agg(F.round(F.avg("exposure"), 6).alias("exposure"), F.round(F.avg("residual"), 6).alias("residual"), *[F.count_if(F.col("ai_quadrant") == k).alias(n) for n, k in kinds.items()])


@query(f"SELECT person, residual, ai_quadrant FROM ({_EXPOSED}) ORDER BY residual DESC, person LIMIT 20")
def ai_ranking(spark, sf):
    """The twenty persons whose work automation covers least."""
    return K.ai_exposure(spark, sf).orderBy(F.desc("residual"), F.asc("person")).limit(20).select("person", "residual", "ai_quadrant")


@query(
    f"""WITH {_EP}, {K._CAT}, {K._AI}, d AS (SELECT category, floor(0.40 * l + 0.35 * least(100.0, a) + 0.25 * c + 0.5) AS au FROM a), w AS (SELECT person, category, sum(score) AS w FROM c GROUP BY 1, 2),
    r AS (SELECT person, category, round(w * (1 - au / 100), 9) AS residual FROM w JOIN d USING (category))
    SELECT person, CAST(rk AS INT) AS rk, category FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY residual DESC, category) AS rk FROM r) WHERE rk <= 3"""
)
def ai_residual_topics(spark, sf):
    """The three categories of a person in which most stays with the person."""
    weighed = K.with_category(profile(spark, sf)).groupBy("person", "category").agg(F.sum("score").alias("w")).join(F.broadcast(D.ai_topics(spark)), "category")
    left = weighed.select("person", "category", F.round(F.col("w") * (1 - F.col("automability") / 100), 9).alias("residual"))
    return X.top_k(left, ["person"], [F.desc("residual"), F.asc("category")], 3).select("person", "rk", "category")


@query(f"SELECT year, category, CAST(row_number() OVER (PARTITION BY year ORDER BY automability DESC, category) AS INT) AS rk FROM ({K.SQL['automability']})")
def automability_ranking(spark, sf):
    return X.ranked(K.automability(spark, sf), ["year"], [F.desc("automability"), F.asc("category")], "rk").select("year", "category", F.col("rk").cast("int").alias("rk"))


# -- departures ---------------------------------------------------------------------------------------------------------


@query(f"{L._READY}, o2 AS (SELECT DISTINCT departed FROM o) SELECT departed, round(coalesce(max(readiness), 0) * 100) < 30 AS none_ready FROM o2 LEFT JOIN rd USING (departed) GROUP BY departed")
def ready_flag(spark, sf):
    """Whether nobody is ready for any topic of a departing person."""
    best = L.ready(spark, sf).groupBy("departed").agg(F.max("readiness").alias("best"))
    own = S.departed_profile(L.leaving(spark, sf), profile(spark, sf), edges(spark, sf)).select(F.col("person").alias("departed")).distinct()
    return own.join(best, "departed", "left").select("departed", (F.round(F.coalesce("best", F.lit(0.0)) * 100) < 30).alias("none_ready"))


@query(f"{L._READY}, s3 AS (SELECT departed, topic, cand, readiness, row_number() OVER (PARTITION BY departed, topic ORDER BY readiness DESC, cand) AS rk FROM rd) SELECT departed, topic, CAST(rk AS INT) AS rk, cand, readiness FROM s3 WHERE rk <= 3")
def first_successors(spark, sf):
    """The three readiest successors of each topic."""
    return S.successors(L.ready(spark, sf), 3).select("departed", "topic", "rk", "cand", "readiness")


@query(None)
def topic_coverage(spark, sf):
    """Every topic of a departing person: lost for good, covered, at risk or vulnerable."""
    able = checkpointed(L.ready(spark, sf))
    log = S.simulate(S.candidates(able, profile(spark, sf), edges(spark, sf)))
    lost = V.permanent_loss(S.topic_quality(log)).select(F.col("person").alias("departed"), "topic", F.lit(True).alias("lost")).distinct()
    own = S.departed_profile(L.leaving(spark, sf), profile(spark, sf), edges(spark, sf)).select(F.col("person").alias("departed"), "topic")
    best = able.groupBy("departed", "topic").agg(F.max("readiness").alias("best"))
    out = own.join(best, ["departed", "topic"], "left").join(lost, ["departed", "topic"], "left")
    return out.select("departed", "topic", F.round("best", 3).alias("best"), P.coverage(F.col("lost"), F.col("best")).alias("status"))


@query(None)
def first_month_method(spark, sf):
    """How the requests of the first month are answered: directly (by a partner or a partner's partner), by everyone, or not at all."""
    first = L.routing(spark, sf).where("month = 1").groupBy("departed").agg(F.bool_or(F.col("step") <= 2).alias("near"), F.bool_or(F.col("step") == 3).alias("far"))
    return first.select("departed", F.when(F.col("near"), "direct").when(F.col("far"), "broadcast").otherwise("none").alias("method"))


@query(None)
def monthly_log(spark, sf):
    """The months of each departure with the topics lost in them and so far."""
    log = checkpointed(L.routing(spark, sf))
    lost = V.permanent_loss(S.topic_quality(log)).withColumnRenamed("person", "departed")
    in_month = lost.groupBy("departed", "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list("topic")), lambda t: t.cast("string")), ", ").alias("topics_lost"))
    total = V.cumulative_losses(lost.select(F.col("departed").alias("person"), "month")).withColumnsRenamed({"person": "departed", "n": "n_lost_so_far"})
    out = S.timeline(log).join(in_month, ["departed", "month"], "left").join(total, ["departed", "month"], "left")
    return out.select("departed", "month", "recovery_rate", "n_requests", "n_recovered", "n_lost", F.coalesce("topics_lost", F.lit("—")).alias("topics_lost"), F.coalesce("n_lost_so_far", F.lit(0)).cast("bigint").alias("n_lost_so_far"))


@query(None)
def riskiest_table(spark, sf):
    """The fifty riskiest persons with recovery, lasting losses and plateau of their departure, dashes where it was not simulated."""
    top = table(spark, sf, "risk_scores").orderBy(F.desc("risk_score"), F.asc("person")).limit(50)
    done = L.simulation_summary(spark, sf).withColumnRenamed("departed", "person")
    plateau = F.when(F.col("final_recovery").isNull(), "—").otherwise(F.coalesce(F.concat(F.lit("M"), F.col("plateau_month").cast("string")), F.lit("none")))
    return top.join(done, "person", "left").select(
        "person", F.round("risk_score", 4).alias("risk_score"), F.round("betweenness", 5).alias("betweenness"), F.coalesce(F.col("weighted_degree").cast("bigint"), F.lit(0)).alias("weighted_degree"),
        F.coalesce(P.percent(F.col("final_recovery"), 1), F.lit("—")).alias("recovery"), F.coalesce(F.col("n_lost").cast("string"), F.lit("—")).alias("losses"), plateau.alias("plateau"),
    )


# -- topics -------------------------------------------------------------------------------------------------------------

_VULNERABLE = N.SQL["topic_vulnerability"]


@query(f"SELECT topic, n_experts, hhi, vulnerability FROM ({_VULNERABLE}) ORDER BY vulnerability DESC, topic LIMIT 50")
def topics_top50(spark, sf):
    """The fifty most vulnerable topics."""
    return N.topic_vulnerability(spark, sf).orderBy(F.desc("vulnerability"), F.asc("topic")).limit(50).select("topic", "n_experts", "hhi", "vulnerability")


@query(
    f"""WITH {_EP}, n AS (SELECT DISTINCT topic FROM ep), w AS (SELECT topic, CASE WHEN topic % 3 = 0 THEN NULL ELSE 'gas-' || topic || ', flow-through of the line ' || topic END AS words FROM n), l AS (SELECT topic, coalesce(words, 'Topic ' || topic) AS label FROM w)
    SELECT topic, replace(label, '-', '‑') AS label, CASE WHEN length(label) > 30 THEN label[1:28] || '…' ELSE label END AS short FROM l"""
)
def topic_labels(spark, sf):
    """Labels of topics by their words, 'Topic N' where they have none; shortened, and with hyphens that do not break."""
    t = profile(spark, sf).select("topic").distinct()
    words = F.when(F.col("topic") % 3 != 0, F.array(F.concat(F.lit("gas-"), F.col("topic").cast("string")), F.concat(F.lit("flow-through of the line "), F.col("topic").cast("string"))))
    label = P.topic_label(F.lit(None).cast("string"), words, F.col("topic"))
    return t.select("topic", P.unbroken(label).alias("label"), P.shortened(label).alias("short"))


@query("SELECT event_id, CAST(CAST(trunc(try_cast(trim(CAST(value AS VARCHAR)) AS DOUBLE)) AS BIGINT) AS VARCHAR) AS topic FROM events")
def topic_ids(spark, sf):
    """Numbers as they were written, made topic ids."""
    return table(spark, sf, "events").select("event_id", P.topic_id(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("topic"))


@query(f"WITH {_EP} SELECT person, string_agg(topic || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY topic) AS topics FROM (SELECT person, topic, max(score) AS score FROM ep GROUP BY 1, 2) GROUP BY person")
def topic_maps(spark, sf):
    """The map topic -> score of each person, written out in the order of topics (scores in ten-thousandths)."""
    best = profile(spark, sf).groupBy("person", "topic").agg(F.max("score").alias("score"))
    mapped = best.groupBy("person").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "score")))).alias("m"))
    return mapped.select("person", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.round(e["value"] * 10000).cast("bigint").cast("string"))), ",").alias("topics"))


# The category of persons without a profile by their role.
ROLE_CATEGORIES = {
    "Legal": "Legal — Transactional", "Trading": "Trading Operations", "Research": "Research & Quantitative Analysis", "Regulatory": "Regulatory & Government Affairs", "Operations": "Pipeline & Transportation",
    "Communications": "Corporate Communications", "Executive": "Executive Operations", "Administration": "Document Management & Administration",
}
_OVERRIDES = [("info", "Corporate Communications"), ("billing", "Document Management & Administration")]
_DOMAINS = [("postbox.example", "General Operations"), ("mailhive.example", "General Operations")]
_VALUES = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)


@query(
    f"""WITH {_PEOPLE}, {K._T}, o(local, oc) AS (VALUES {_VALUES(_OVERRIDES)}), d(domain, dc) AS (VALUES {_VALUES(_DOMAINS)}), r(role, rc) AS (VALUES {_VALUES(ROLE_CATEGORIES.items())}), {_EP},
    w AS (SELECT email AS person, {K._ROLE_N} AS role FROM p LEFT JOIN t ON t.person = email WHERE email NOT IN (SELECT person FROM ep))
    SELECT person, coalesce(oc, dc, rc, 'General Operations') AS category FROM w LEFT JOIN o ON local = split_part(person, '@', 1) LEFT JOIN d ON contains(person, '@') AND domain = regexp_extract(person, '@([^@]*)$', 1) LEFT JOIN r USING (role)"""
)
def fallback_categories(spark, sf):
    """The category of everyone without a profile: an override by local part, the domain's, the role's, or the general one."""
    t = K.titles(spark, sf).select("person", D.role_category(F.col("title")).alias("role"))
    bare = addresses(spark, sf).withColumnRenamed("email", "person").join(profile(spark, sf).select("person"), "person", "left_anti").join(t, "person", "left")
    return P.fallback_categories(bare, spark.createDataFrame(_OVERRIDES, "local string, category string"), spark.createDataFrame(_DOMAINS, "domain string, category string"), ROLE_CATEGORIES, "General Operations")


# -- people -------------------------------------------------------------------------------------------------------------


@query(f"WITH {K._T}, {_PEOPLE_Q}, s AS (SELECT qq.person, quadrant, title FROM qq LEFT JOIN t USING (person)) SELECT person, quadrant FROM s WHERE quadrant = 'Low Priority' AND (contains(lower(person), 'ber') OR contains(lower(title), 'ber'))")
def people_search(spark, sf):
    """Everyone of a quadrant in whose address or title a word stands, letter case aside."""
    t = K.titles(spark, sf).select("person", "title")
    return K.quadrants(spark, sf).join(t, "person", "left").where((F.col("quadrant") == "Low Priority") & P.matches("BER", F.col("person"), F.col("title"))).select("person", "quadrant")


@query(f"WITH {K._REMOVED} SELECT count(*) FILTER ({K._SYSTEM} OR lower(trim(person)) IN (SELECT person FROM rm WHERE person IS NOT NULL)) AS n_removed, count(*) AS n FROM (SELECT * FROM risk_scores ORDER BY risk_score DESC, person LIMIT 300)")
def removed_count(spark, sf):
    """How many of the first 300 by risk are removed or system accounts."""
    top = table(spark, sf, "risk_scores").orderBy(F.desc("risk_score"), F.asc("person")).limit(300).withColumn("key", F.lower(F.trim("person")))
    out = top.join(K.removed_list(spark, sf).select(F.col("person").alias("key"), F.lit(True).alias("listed")), "key", "left")
    return out.agg(F.count_if(I.is_system_account(F.col("person")) | F.coalesce("listed", F.lit(False))).alias("n_removed"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PEOPLE}, {K._REMOVED}, a AS (SELECT email AS person FROM p) SELECT person FROM a WHERE {K._SYSTEM} AND person NOT IN (SELECT person FROM rm WHERE person IS NOT NULL)")
def detected_accounts(spark, sf):
    """System accounts that only the rule finds, no list."""
    a = addresses(spark, sf).withColumnRenamed("email", "person")
    return a.where(I.is_system_account(F.col("person"))).join(K.removed_list(spark, sf), "person", "left_anti")


@query(f"WITH {_PEOPLE} SELECT email FROM p WHERE split_part(email, '@', 1) IN ('info', 'desk', 'billing') OR CASE WHEN contains(email, '@') THEN regexp_extract(email, '@([^@]*)$', 1) ELSE '' END IN ('mailhive.example', 'postbox.example')")
def listed_accounts(spark, sf):
    """Addresses whose local part or domain stands in a list, exactly."""
    return I.in_lists(addresses(spark, sf), "email", ["info", "desk", "billing"], ["mailhive.example", "postbox.example"])


@query(r"""WITH n AS (SELECT DISTINCT lower(trim(e.key)) AS email, trim(e.value) AS name FROM (SELECT unnest(map_entries(display_names)) AS e FROM clean_names) WHERE e.value IS NOT NULL AND trim(e.value) <> '' AND trim(e.key) <> '')
    SELECT email, name, len(list_filter(regexp_split_to_array(name, '\s+'), lambda x: x <> '')) >= 2 AND NOT regexp_matches(name, '[0-9@#$%^&*_+=\[\]{}|<>]') AS valid, regexp_split_to_array(name, '\s+')[1] AS first_word, regexp_split_to_array(name, '\s+')[-1] AS last_word FROM n""")
def name_validity(spark, sf):
    """Whether a typed name can be a successor's (two words, no digits or signs), with its first and last word."""
    n = table(spark, sf, "clean_names").select(F.explode("display_names").alias("k", "v")).select(F.lower(F.trim("k")).alias("email"), F.trim("v").alias("name")).where("name != '' and email != ''").distinct()
    return n.select("email", "name", I.valid_successor(F.col("name")).alias("valid"), P.first_word(F.col("name")).alias("first_word"), P.last_word(F.col("name")).alias("last_word"))


@query(
    """WITH d AS (SELECT lower(trim(e.key)) AS person, min(lower(trim(e.value))) AS canonical FROM (SELECT unnest(map_entries(duplicates)) AS e FROM clean_names) GROUP BY 1)
    SELECT r.person, canonical IS NOT NULL AS is_duplicate, canonical FROM risk_scores r LEFT JOIN d ON d.person = lower(trim(r.person))"""
)
def canonical_people(spark, sf):
    """Everyone with the main address it is an alias of; scores are not merged."""
    d = table(spark, sf, "clean_names").select(F.explode("duplicates").alias("k", "v")).groupBy(F.lower(F.trim("k")).alias("key")).agg(F.min(F.lower(F.trim("v"))).alias("canonical"))
    r = table(spark, sf, "risk_scores").select("person", F.lower(F.trim("person")).alias("key"))
    return r.join(d, "key", "left").select("person", F.col("canonical").isNotNull().alias("is_duplicate"), "canonical")


@query("SELECT row_id, lower(trim(regexp_replace(\"from\", '^[^<]+<([^>]+)>$', '\\1'))) AS sender FROM enron_emails")
def bare_senders(spark, sf):
    """Every sender without the wrapper 'name <address>'."""
    return table(spark, sf, "enron_emails").select("row_id", F.lower(F.trim(F.regexp_replace("from", r"^[^<]+<([^>]+)>$", "$1"))).alias("sender"))


@query(
    f"""WITH {K._T}, {_PEOPLE_Q}, h AS (SELECT * FROM ({K.SQL['name_hash']})), m AS (SELECT person, risk_score, risk_score + (name_hash % 1000) / 1000.0 * 0.030 - 0.015 AS moved FROM qq JOIN h USING (person))
    SELECT person, round(CASE WHEN risk_score >= 0.12 THEN greatest(moved, 0.12) ELSE least(moved, 0.119) END, 6) AS shown, list_sum(list_transform(string_split(split_part(person, '@', 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE ascii(x) END)) % 4 AS variant FROM m"""
)
def shown_risk(spark, sf):
    """Where a person is drawn: the risk moved by a fixed small amount on its side of the threshold; and the variant of its text."""
    local = F.substring_index("person", "@", 1)
    r = table(spark, sf, "risk_scores")
    return r.select("person", F.round(R.jitter(F.col("risk_score"), R.name_hash(local), F.lit(0.12)), 6).alias("shown"), P.letter_sum(local).cast("bigint").alias("variant"))


# What is said of a person of each quadrant.
DESCRIPTIONS = {
    "Organizational Emergency": "holds rare knowledge in a leading position", "Silent Threat": "holds rare knowledge that the position does not show",
    "Replaceable Executive": "leads, with knowledge that others share", "Low Priority": "holds knowledge that others share",
}


@query(f"WITH {K._T}, {_PEOPLE_Q} SELECT person, printf('%s %s (risk %d%%).', person, CASE quadrant " + " ".join(f"WHEN '{q}' THEN '{t}'" for q, t in DESCRIPTIONS.items()) + " END, CAST(round(risk_score * 100) AS BIGINT)) AS text FROM qq")
def descriptions(spark, sf):
    """One sentence a person by its quadrant."""
    said = F.lit(None).cast("string")
    for quadrant, text in DESCRIPTIONS.items():
        said = F.when(F.col("quadrant") == quadrant, F.lit(text)).otherwise(said)
    return K.quadrants(spark, sf).select("person", F.format_string("%s %s (risk %d%%).", F.col("person"), said, F.round(F.col("risk_score") * 100).cast("bigint")).alias("text"))


@query(
    f"""WITH {K._T}, {_PEOPLE_Q}, n AS (SELECT person, risk AS own FROM ({K.SQL['risk_score']})), v AS (SELECT qq.person, risk_score >= 0.12 AS kept, own >= 0.12 AS told FROM qq JOIN n USING (person)),
    g AS (SELECT CASE WHEN kept AND told THEN 'Hit' WHEN kept THEN 'Miss' WHEN told THEN 'Partial' ELSE 'Hit' END AS verdict FROM v)
    SELECT count(*) FILTER (verdict = 'Hit') AS hits, count(*) FILTER (verdict = 'Partial') AS partial, count(*) FILTER (verdict = 'Miss') AS misses, round(count(*) FILTER (verdict = 'Hit') / count(*), 6) AS concordance FROM g"""
)
def concordance(spark, sf):
    """How often the score of the tables and the one recomputed tell the same side of the threshold."""
    own = R.risk_score(table(spark, sf, "risk_scores")).select("person", F.round("risk", 6).alias("own"))
    v = table(spark, sf, "risk_scores").select("person", "risk_score").join(own, "person").select((F.col("risk_score") >= 0.12).alias("kept"), (F.col("own") >= 0.12).alias("told"))
    verdict = F.when(F.col("kept") == F.col("told"), "Hit").when(F.col("kept"), "Miss").otherwise("Partial")
    counts = v.select(verdict.alias("v")).agg(*[F.count_if(F.col("v") == k).alias(n) for k, n in (("Hit", "hits"), ("Partial", "partial"), ("Miss", "misses"))], F.count(F.lit(1)).alias("n"))
    return counts.select("hits", "partial", "misses", F.round(F.col("hits") / F.col("n"), 6).alias("concordance"))


# -- drawing ------------------------------------------------------------------------------------------------------------


@query(f"WITH {K._T}, {_PEOPLE_Q} SELECT quadrant, round(min(risk_score) - greatest((max(risk_score) - min(risk_score)) * 0.05, 0.02), 6) AS low, round(max(risk_score) + greatest((max(risk_score) - min(risk_score)) * 0.05, 0.02), 6) AS high FROM qq GROUP BY quadrant")
def zoom_ranges(spark, sf):
    return P.margins(K.quadrants(spark, sf), "quadrant", "risk_score").select("quadrant", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("WITH l AS (SELECT person, ln(1 + greatest(coalesce(weighted_degree, 1), 1)) AS v FROM risk_scores) SELECT person, round(3 + 18 * coalesce((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), 0), 6) AS size FROM l")
def node_sizes(spark, sf):
    return P.log_sizes(table(spark, sf, "risk_scores").select("person", "weighted_degree"), "weighted_degree").select("person", F.round("size", 6).alias("size"))


@query(f"WITH {L._CURVE}, a AS (SELECT person, list(CAST(round(rate * 10000) AS BIGINT) ORDER BY month) AS r FROM cu GROUP BY person), f AS (SELECT person, r, unnest(range(1, len(r) + 1)) AS i FROM a) SELECT person, CAST(i AS INT) AS i, array_to_string(r[1:i], ',') AS frame FROM f")
def frames(spark, sf):
    """The first values of each monthly series, one row a frame."""
    a = L.curves(spark, sf).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "rate"))), lambda x: F.round(x["rate"] * 10000).cast("bigint")).alias("r"))
    return P.prefixes(a, "person", "r").select("person", "i", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("frame"))


@query(
    f"""WITH {_B}, d AS (SELECT person, count(*) AS degree FROM b GROUP BY person), a AS (SELECT person FROM d ORDER BY degree DESC, person LIMIT 100), t AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 10),
    u AS (SELECT person FROM a UNION SELECT person FROM t UNION SELECT min(person) FROM risk_scores) SELECT u.person, round(coalesce(r.risk_score, 0.0), 6) AS risk_score FROM u LEFT JOIN risk_scores r USING (person)"""
)
def merged_nodes(spark, sf):
    """The hundred best connected, the ten riskiest and one person asked for, with their risk."""
    risk = table(spark, sf, "risk_scores").select("person", "risk_score")
    well = G.degrees(edges(spark, sf)).orderBy(F.desc("degree"), F.asc("person")).limit(100).select("person")
    both = well.union(risk.orderBy(F.desc("risk_score"), F.asc("person")).limit(10).select("person")).union(risk.agg(F.min("person").alias("person"))).distinct()
    return both.join(risk, "person", "left").select("person", F.round(F.coalesce("risk_score", F.lit(0.0)), 6).alias("risk_score"))


@query(
    f"""WITH {_EP}, {K._CAT}, {_B}, {K._REMOVED} SELECT (SELECT count(*) FROM risk_scores WHERE simulated) AS n_simulated, (SELECT count(DISTINCT topic) FROM ep) AS n_topics, (SELECT count(DISTINCT category) FROM c) AS n_categories,
    (SELECT count(DISTINCT person) FROM b) AS n_nodes, (SELECT count(*) // 2 FROM b) AS n_edges, (SELECT count(*) FROM rm) AS n_removed, (SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) FROM documents) AS n_chunks"""
)
def pipeline_stats(spark, sf):
    """One row of counts: persons, topics, categories, graph, removed accounts, chunks of ten thousand documents."""
    p, e = K.with_category(profile(spark, sf)), edges(spark, sf)
    parts = [
        table(spark, sf, "risk_scores").agg(F.count_if("simulated").alias("n_simulated")), p.agg(F.countDistinct("topic").alias("n_topics"), F.countDistinct("category").alias("n_categories")),
        G.symmetric(e).agg(F.countDistinct("person").alias("n_nodes")), e.agg(F.count(F.lit(1)).alias("n_edges")), K.removed_list(spark, sf).agg(F.count(F.lit(1)).alias("n_removed")),
        table(spark, sf, "documents").agg(F.ceil(F.count(F.lit(1)) / 10000).cast("bigint").alias("n_chunks")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(part)
    return out
