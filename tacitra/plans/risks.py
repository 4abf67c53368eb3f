"""Queries on risk scores, titles, quadrants, cascades and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tacitra.operators import cascade as C
from tacitra.operators import dims as D
from tacitra.operators import expertise as X
from tacitra.operators import graph as G
from tacitra.operators import identity as I
from tacitra.operators import risk as R
from tacitra.plans.knowledge import _EP, profile
from tacitra.plans.network import _B, edges
from tacitra.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sql_ladder(value: str, steps, default, starts=None) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)

    parts = []
    for result, words in steps:
        tests = [f"contains({value}, '{w}')" for w in words] + [f"starts_with({value}, '{p}')" for p in (starts or {}).get(result, [])]
        parts.append(f"WHEN {' OR '.join(tests)} THEN {lit(result)}")
    return f"CASE {' '.join(parts)} ELSE {lit(default)} END"


_IMPACT = _sql_ladder("lower(title)", D.IMPACT, D.IMPACT_DEFAULT, {0.65: ["vp"]})
_ROLE = _sql_ladder("lower(title)", D.ROLE, D.ROLE_DEFAULT)
_ROLE_N = f"CASE WHEN title IS NULL THEN NULL ELSE {_ROLE} END"
_T = "t AS (SELECT lower(trim(email)) AS person, min(trim(title)) AS title FROM titles WHERE title IS NOT NULL GROUP BY 1)"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """One title a person (the first by alphabet of several)."""
    return table(spark, sf, "titles").where("title IS NOT NULL").groupBy(F.lower(F.trim("email")).alias("person")).agg(F.min(F.trim("title")).alias("title"))


@query(f"WITH {_T} SELECT person, title, ({_IMPACT})::DOUBLE AS impact, {_ROLE} AS role FROM t")
def positional_impact(spark, sf):
    return titles(spark, sf).select("person", "title", D.positional_impact(F.col("title")).alias("impact"), D.role_category(F.col("title")).alias("role"))


_DEPT = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '\\b({w})\\b') THEN '{r}'" for r, w in D.DEPARTMENT) + f" ELSE {_ROLE} END"


@query(f"WITH {_T} SELECT person, {_DEPT} AS department FROM t")
def title_department(spark, sf):
    return titles(spark, sf).select("person", D.department(F.col("title"), D.role_category(F.col("title"))).alias("department"))


_NORM = ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE ELSE 0.0 END AS {c}_n" for c in D.RISK_WEIGHTS)
_RISK = " + ".join(f"{w} * {c}_n" for c, w in D.RISK_WEIGHTS.items())


@query(f"WITH n AS (SELECT person, {_NORM} FROM risk_scores) SELECT person, round({_RISK}, 6) AS risk FROM n")
def risk_score(spark, sf):
    return R.risk_score(table(spark, sf, "risk_scores")).select("person", F.round("risk", 6).alias("risk"))


@query(None)
def risk_from_tables(spark, sf):
    """The score computed from profile and graph alone, every metric by its own operator."""
    p, e = profile(spark, sf), edges(spark, sf)
    d = G.degrees(e)
    nodes = d.select("person").union(p.select("person"))
    metrics = R.assemble(nodes, topic_monopoly=X.topic_monopoly(p), topics_top_expert=X.topics_top_expert(p), weighted_degree=d, betweenness=G.betweenness(e), component_delta=G.component_delta(e))
    return R.risk_score(metrics).select("person", F.round("risk", 6).alias("risk"))


_Q = """CASE WHEN round_even(risk_score, 4) >= 0.12 AND impact >= 0.65 THEN 'Organizational Emergency' WHEN round_even(risk_score, 4) >= 0.12 THEN 'Silent Threat'
    WHEN impact >= 0.65 THEN 'Replaceable Executive' ELSE 'Low Priority' END"""
_QUAD = f"q AS (SELECT r.person, risk_score, coalesce(t.impact, 0.25) AS impact FROM risk_scores r LEFT JOIN (SELECT person, {_IMPACT} AS impact FROM t) t USING (person))"


def quadrants(spark: SparkSession, sf: str) -> DataFrame:
    t = titles(spark, sf).select("person", D.positional_impact(F.col("title")).alias("impact"))
    q = table(spark, sf, "risk_scores").select("person", "risk_score").join(t, "person", "left").withColumn("impact", F.coalesce("impact", F.lit(D.IMPACT_DEFAULT)))
    return q.withColumn("quadrant", R.quadrant(F.col("risk_score"), F.col("impact")))


@query(f"WITH {_T}, {_QUAD} SELECT person, {_Q} AS quadrant FROM q")
def quadrant(spark, sf):
    return quadrants(spark, sf).select("person", "quadrant")


@query(
    f"""WITH {_T}, {_QUAD}, c AS (SELECT {_Q} AS quadrant, count(*) AS n FROM q GROUP BY 1)
    SELECT d.quadrant, coalesce(n, 0) AS n FROM (VALUES ('Organizational Emergency'), ('Silent Threat'), ('Replaceable Executive'), ('Low Priority')) d(quadrant) LEFT JOIN c USING (quadrant)"""
)
def quadrant_distribution(spark, sf):
    return R.quadrant_counts(quadrants(spark, sf))


@query(
    """SELECT person, CASE WHEN betweenness > 0.03 THEN 'Executive Leadership' WHEN betweenness > 0.015 THEN 'Senior Management' WHEN betweenness > 0.008 THEN 'Director'
    WHEN topics_top_expert > 3 THEN 'Domain Specialist' WHEN weighted_degree > 5000 THEN 'Senior Analyst' WHEN weighted_degree > 2000 THEN 'Analyst' WHEN weighted_degree > 500 THEN 'Associate' ELSE 'Junior Associate' END AS role FROM risk_scores"""
)
def inferred_role(spark, sf):
    r = table(spark, sf, "risk_scores")
    return r.select("person", R.inferred_role(F.col("betweenness"), F.col("topics_top_expert"), F.col("weighted_degree")).alias("role"))


_REMOVED = "rm AS (SELECT DISTINCT lower(trim(x)) AS person FROM (SELECT unnest(removed) AS x FROM clean_names))"
_SYSTEM = f"(regexp_matches(split_part(lower(person), '@', 1), '{D.SYSTEM_ACCOUNT}') OR regexp_full_match(split_part(person, '@', 1), '[0-9]+') OR length(split_part(person, '@', 1)) <= 6 AND regexp_matches(split_part(person, '@', 1), '[0-9]'))"


def removed_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clean_names").select(F.explode("removed").alias("x")).select(F.lower(F.trim("x")).alias("person")).distinct()


@query(f"WITH {_REMOVED} SELECT person, round(risk_score, 6) AS risk_score FROM (SELECT * FROM risk_scores ORDER BY risk_score DESC, person LIMIT 300) WHERE NOT {_SYSTEM} AND lower(trim(person)) NOT IN (SELECT person FROM rm WHERE person IS NOT NULL) ORDER BY risk_score DESC, person LIMIT 200")
def exported_people(spark, sf):
    """The first 300 by risk, then without removed and system accounts, then the first 200: in this order."""
    order = [F.desc("risk_score"), F.asc("person")]
    top = table(spark, sf, "risk_scores").orderBy(*order).limit(300)
    kept = top.where(~I.is_system_account(F.col("person"))).withColumn("key", F.lower(F.trim("person"))).join(removed_list(spark, sf).withColumnRenamed("person", "key"), "key", "left_anti")
    return kept.orderBy(*order).limit(200).select("person", F.round("risk_score", 6).alias("risk_score"))


@query("WITH RECURSIVE c AS (SELECT person, split_part(person, '@', 1) AS s FROM risk_scores), r(person, s, i, h) AS (SELECT person, s, 1, 0::BIGINT FROM c UNION ALL SELECT person, s, i + 1, (h * 31 + ascii(s[i])) % 1000003 FROM r WHERE i <= length(s)) SELECT person, h AS name_hash FROM r WHERE i = length(s) + 1")
def name_hash(spark, sf):
    return table(spark, sf, "risk_scores").select("person", R.name_hash(F.substring_index("person", "@", 1)).alias("name_hash"))


@query("SELECT count(*) AS n, count(*) FILTER (risk_score > 0.3) AS n_high, round(max(risk_score), 6) AS most, round(avg(risk_score), 6) AS mean, count(*) FILTER (simulated) AS n_simulated, count(*) FILTER (CASE WHEN risk_score >= 0.40 THEN 'Critical' WHEN risk_score >= 0.15 THEN 'Moderate' ELSE 'Low' END = 'Moderate') AS n_moderate FROM risk_scores")
def risk_summary(spark, sf):
    s = F.col("risk_score")
    label = F.when(s >= 0.40, "Critical").when(s >= 0.15, "Moderate").otherwise("Low")
    return table(spark, sf, "risk_scores").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s > 0.3).alias("n_high"), F.round(F.max(s), 6).alias("most"), F.round(F.avg(s), 6).alias("mean"), F.count_if("simulated").alias("n_simulated"), F.count_if(label == "Moderate").alias("n_moderate")
    )


# categories stand in for the topic model's: topic modulo the thirteen names, in the order of the fixed table
_NAMES = [n for n, *_ in D.AI_TOPICS]
_CAT = "c AS (SELECT ep.person, topic, cnt, score, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][topic % {len(_NAMES)} + 1] AS category FROM ep)"


def with_category(p: DataFrame) -> DataFrame:
    return p.withColumn("category", F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("topic") % len(_NAMES)))


def removed(spark: SparkSession, sf: str) -> DataFrame:
    """The five persons of highest risk, as a queue of departures."""
    five = table(spark, sf, "risk_scores").select("person", F.col("risk_score").alias("risk")).orderBy(F.desc("risk"), F.asc("person")).limit(5)
    return C.ranked_removed(five)


_GONE = "g AS (SELECT person, risk_score AS risk, CAST(row_number() OVER (ORDER BY risk_score DESC, person) AS INT) - 1 AS i FROM (SELECT * FROM risk_scores ORDER BY risk_score DESC, person LIMIT 5))"
_TAU = f"""WITH {_EP}, {_CAT}, {_GONE}, v AS (SELECT c.person, category, min(score) AS s FROM c JOIN g USING (person) GROUP BY 1, 2),
    m AS (SELECT g.person, i, coalesce(sqrt(sum(s * s)), 0) AS n FROM g LEFT JOIN v USING (person) GROUP BY 1, 2),
    d AS (SELECT a.person AS pa, b.person AS pb, sum(a.s * b.s) AS dot FROM v a JOIN v b USING (category) GROUP BY 1, 2),
    u AS (SELECT least(0.5, coalesce(avg(coalesce(dot / nullif(x.n * y.n, 0), 0)), 0)) AS tau FROM m x JOIN m y ON x.i < y.i LEFT JOIN d ON pa = x.person AND pb = y.person)"""


@query(_TAU + " SELECT round(tau, 6) AS tau FROM u")
def cascade_tau(spark, sf):
    return C.overlap_factor(C.category_vectors(with_category(profile(spark, sf))), removed(spark, sf)).select(F.round("tau", 6).alias("tau"))


@query(
    _TAU + """, t AS (SELECT sum(risk) AS plain, sum(risk + 0.032 * i) AS st FROM g), w AS (SELECT plain, least(1.0, st * (1 + tau)) AS total FROM t, u)
    SELECT round(plain, 6) AS plain, round(total, 6) AS total, CAST(floor(100 * (total - plain) / plain + 0.5) AS BIGINT) AS amplification FROM w"""
)
def cascade_total(spark, sf):
    gone = removed(spark, sf)
    total = C.cascade_total(gone, C.overlap_factor(C.category_vectors(with_category(profile(spark, sf))), gone))
    return total.select(F.round("plain", 6).alias("plain"), F.round("total", 6).alias("total"), F.col("amplification").cast("bigint").alias("amplification"))


@query(
    f"""WITH {_EP}, {_CAT}, {_GONE}, k AS (SELECT DISTINCT person, category FROM c), b AS (SELECT k.category, 0.015 + 0.008 * i AS boost FROM k JOIN g USING (person)),
    s AS (SELECT person, sum(boost) AS boost FROM k JOIN b USING (category) GROUP BY person)
    SELECT r.person, round(least(0.95, risk_score + coalesce(boost, 0)), 6) AS live_risk FROM risk_scores r LEFT JOIN s USING (person) WHERE r.person NOT IN (SELECT person FROM g)"""
)
def live_risk(spark, sf):
    people = table(spark, sf, "risk_scores").select("person", F.col("risk_score").alias("risk"))
    return C.live_risk(people, with_category(profile(spark, sf)), removed(spark, sf)).select("person", F.round("live_risk", 6).alias("live_risk"))


@query(None)
def live_quadrant(spark, sf):
    """The quadrant of those who stay, under the risk that the queue of departures leaves them with."""
    people = quadrants(spark, sf).select("person", F.col("risk_score").alias("risk"), "impact")
    live = C.live_risk(people, with_category(profile(spark, sf)), removed(spark, sf)).join(people.select("person", "impact"), "person")
    return live.select("person", R.quadrant(F.col("live_risk"), F.col("impact")).alias("quadrant"))


@query(f"WITH {_EP}, {_CAT}, {_GONE} SELECT category, count(DISTINCT person) AS hits, CASE WHEN count(DISTINCT person) >= 2 THEN 'LOST' ELSE 'PARTIAL' END AS state FROM c JOIN g USING (person) GROUP BY category")
def topic_hits(spark, sf):
    return C.topic_hits(with_category(profile(spark, sf)), removed(spark, sf))


_YEARS = " UNION ALL ".join(f"SELECT {y} AS year, {m}::DOUBLE AS mult" for y, m in D.AI_YEARS)
_AI = "a AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for n, x, y, z in D.AI_TOPICS) + ") v(category, l, a, c))"


@query(f"WITH {_AI}, y AS ({_YEARS}) SELECT year, category, CAST(floor(0.40 * l + 0.35 * least(100.0, a * mult) + 0.25 * c + 0.5) AS INT) AS automability FROM a, y")
def automability(spark, sf):
    out = [D.ai_topics(spark, m).withColumn("year", F.lit(y)) for y, m in D.AI_YEARS]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("year", "category", "automability")


_JUNIOR = " OR ".join(f"contains(lower(title), '{w}')" for w in D.JUNIOR)


@query(
    f"""WITH {_EP}, {_CAT}, {_T}, {_AI}, d AS (SELECT category, floor(0.40 * l + 0.35 * least(100.0, a) + 0.25 * c + 0.5) AS au FROM a),
    p AS (SELECT r.person, risk_score AS risk, coalesce({_IMPACT}, 0.25) AS impact, coalesce({_JUNIOR}, false) AS junior FROM risk_scores r LEFT JOIN t USING (person)),
    w AS (SELECT person, category, sum(score) AS w FROM c GROUP BY 1, 2), e AS (SELECT person, sum(w * au) / sum(w) AS raw, sum(w * (1 - au / 100)) AS residual FROM w JOIN d USING (category) GROUP BY person),
    x AS (SELECT p.*, residual, CASE WHEN junior THEN greatest(floor(round(coalesce(raw, 0), 9) + 0.5), 35) ELSE floor(round(coalesce(raw, 0), 9) + 0.5) END AS exposure, floor(impact * 100 + 0.5) AS pi FROM p LEFT JOIN e USING (person)),
    z AS (SELECT *, floor(round(greatest(risk * 100 * (1 - exposure / 100 * 0.5), CASE WHEN pi >= 80 THEN 25 WHEN pi >= 60 THEN 20 ELSE 0 END), 9) + 0.5) AS adjusted FROM x)
    SELECT person, exposure::DOUBLE AS exposure, adjusted::DOUBLE AS adjusted, round(coalesce(residual, 0), 6) AS residual,
      CASE WHEN pi >= 80 THEN 'Critical Human Capital' WHEN adjusted >= 20 AND exposure >= 65 THEN 'Transition Risk' WHEN adjusted >= 20 THEN 'Critical Human Capital' WHEN exposure >= 65 THEN 'Automation Candidate' ELSE 'Stable' END AS ai_quadrant FROM z"""
)
def ai_exposure(spark, sf):
    t = titles(spark, sf)
    junior = F.lit(False)
    for w in D.JUNIOR:
        junior = junior | F.lower("title").contains(w)
    people = table(spark, sf, "risk_scores").select("person", F.col("risk_score").alias("risk")).join(t, "person", "left")
    people = people.select("person", "risk", D.positional_impact(F.col("title")).alias("impact"), F.coalesce(junior, F.lit(False)).alias("junior"))
    out = C.exposure(people, with_category(profile(spark, sf)), D.ai_topics(spark))
    return out.withColumn("residual", F.round("residual", 6))


@query(
    f"""WITH {_EP}, {_CAT}, {_T}, r AS (SELECT person, {_ROLE} AS role FROM t), k AS (SELECT DISTINCT person, category FROM c)
    SELECT category, count(DISTINCT person) AS holders, count(DISTINCT coalesce(role, 'Administration')) AS n_roles, arg_min(person, row(-risk_score, person)) AS riskiest
    FROM k JOIN risk_scores USING (person) LEFT JOIN r USING (person) GROUP BY category"""
)
def category_holders(spark, sf):
    """Per category: holders, their roles, and the holder of highest risk."""
    k = with_category(profile(spark, sf)).select("person", "category").distinct()
    role = titles(spark, sf).select("person", D.role_category(F.col("title")).alias("role"))
    j = k.join(table(spark, sf, "risk_scores").select("person", "risk_score"), "person").join(role, "person", "left")
    return j.groupBy("category").agg(
        F.countDistinct("person").alias("holders"), F.countDistinct(F.coalesce("role", F.lit("Administration"))).alias("n_roles"), F.min_by("person", F.struct(-F.col("risk_score"), F.col("person"))).alias("riskiest")
    )


@query(
    f"""WITH {_EP}, {_CAT}, k AS (SELECT person, category, row_number() OVER (PARTITION BY person ORDER BY score DESC, topic) AS pos FROM c),
    f AS (SELECT person, category, min(pos) AS pos FROM k GROUP BY 1, 2)
    SELECT person, CAST(row_number() OVER (PARTITION BY person ORDER BY pos) AS INT) AS rk, category FROM f QUALIFY rk <= 3"""
)
def first_categories(spark, sf):
    """The first three different categories of a person in the order of its scores."""
    k = X.ranked(with_category(profile(spark, sf)), ["person"], [F.desc("score"), F.asc("topic")], "pos")
    f = k.groupBy("person", "category").agg(F.min("pos").alias("pos"))
    return X.top_k(f, ["person"], [F.asc("pos")], 3).select("person", "rk", "category")


@query(
    f"""WITH {_B}, {_T}, j AS (SELECT b.person, partner, weight, {_ROLE_N} AS role FROM b LEFT JOIN t ON t.person = b.partner)
    SELECT person, coalesce(role, 'Administration') AS role, count(DISTINCT partner) AS n_partners, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY person), 6) AS share FROM j GROUP BY 1, 2"""
)
def role_share(spark, sf):
    t = titles(spark, sf).select(F.col("person").alias("partner"), D.role_category(F.col("title")).alias("role"))
    j = G.symmetric(edges(spark, sf)).join(t, "partner", "left").groupBy("person", F.coalesce("role", F.lit("Administration")).alias("role")).agg(F.countDistinct("partner").alias("n_partners"), F.sum("weight").alias("w"))
    return j.select("person", "role", "n_partners", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("person")), 6).alias("share"))
