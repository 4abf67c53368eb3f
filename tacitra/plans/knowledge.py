"""Queries on the expertise table: profiles, experts, monopolies, vulnerability, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitra.operators import expertise as X
from tacitra.sources.tables import table

_EP = 'ep AS (SELECT DISTINCT "from" AS person, topic, "count" AS cnt, score FROM expertise WHERE topic <> -1 AND score IS NOT NULL)'


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct profile rows without outliers."""
    raw = table(spark, sf, "expertise").where("topic != -1 AND score IS NOT NULL")
    return raw.select(F.col("from").alias("person"), "topic", F.col("count").alias("cnt"), "score").distinct()


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {_EP} SELECT person, topic, cnt, round(cnt / max(cnt) OVER (PARTITION BY person), 6) AS score FROM ep")
def expertise_profile(spark, sf):
    return X.expertise_profile(profile(spark, sf).drop("score")).select("person", "topic", "cnt", F.round("score", 6).alias("score"))


@query("SELECT l_suppkey AS person, p_brand AS topic, count(*) AS cnt, round(count(*) / max(count(*)) OVER (PARTITION BY l_suppkey), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def expertise_from_events(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return X.expertise_profile(X.topic_counts(rows, F.col("l_suppkey"), F.col("p_brand"))).select("person", "topic", "cnt", F.round("score", 6).alias("score"))


@query(f"WITH {_EP} SELECT person, count(*) AS topics_top_expert FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, person) AS rk FROM ep) WHERE rk = 1 GROUP BY person")
def topics_top_expert(spark, sf):
    return X.topics_top_expert(profile(spark, sf))


@query(
    f"WITH {_EP} SELECT person, count(*) AS topic_monopoly FROM (SELECT topic, max(person) FILTER (score > 0.3) AS person FROM ep GROUP BY topic HAVING count(*) FILTER (score > 0.3) = 1 AND max(score) > 0.5) GROUP BY person"
)
def topic_monopoly(spark, sf):
    return X.topic_monopoly(profile(spark, sf))


@query(f"WITH {_EP} SELECT person, round(sum(score * score) / greatest(count(*), 1), 6) AS concentration FROM ep GROUP BY person")
def person_concentration(spark, sf):
    return X.concentration(profile(spark, sf)).select("person", F.round("concentration", 6).alias("concentration"))


@query(
    f"""WITH {_EP}, v AS (SELECT topic, count(*) FILTER (score > 0.3) AS n_experts,
      coalesce(sum(score * score) FILTER (score > 0.3) / nullif(sum(score) FILTER (score > 0.3) * sum(score) FILTER (score > 0.3), 0), 1) AS h FROM ep GROUP BY topic),
    w AS (SELECT topic, n_experts, h, (1.0 / greatest(n_experts, 1)) * (1 + h) AS vul FROM v)
    SELECT topic, n_experts, round(h, 4) AS hhi, round(vul, 6) AS vulnerability,
      round(CASE WHEN max(vul) OVER () > min(vul) OVER () THEN (vul - min(vul) OVER ()) / (max(vul) OVER () - min(vul) OVER ()) ELSE 0 END, 6) AS vulnerability_norm FROM w"""
)
def topic_vulnerability(spark, sf):
    v = X.topic_vulnerability(profile(spark, sf))
    return v.select("topic", "n_experts", F.round("hhi", 4).alias("hhi"), F.round("vulnerability", 6).alias("vulnerability"), F.round("vulnerability_norm", 6).alias("vulnerability_norm"))


@query(f"WITH {_EP} SELECT topic, rk, person, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, person) AS INT) AS rk FROM ep) WHERE rk <= 3")
def top3_experts(spark, sf):
    return X.top_k(profile(spark, sf), ["topic"], [F.desc("score"), F.asc("person")], 3).select("topic", "rk", "person", F.round("score", 6).alias("score"))


@query(f"WITH {_EP} SELECT person, topic, CAST(greatest(1, round_even(cnt / 12.0, 0)) AS INT) AS n_requests FROM ep")
def request_schedule(spark, sf):
    return X.request_schedule(profile(spark, sf)).select("person", "topic", "n_requests")


@query(f"WITH {_EP} SELECT person, round(greatest(1.0, 1.5 * sum(cnt) / 12), 6) AS bandwidth FROM ep GROUP BY person")
def bandwidth(spark, sf):
    return X.bandwidth(profile(spark, sf)).select("person", F.round("bandwidth", 6).alias("bandwidth"))


@query(f"WITH {_EP} SELECT person, len(list(DISTINCT topic)) AS n_topics, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics FROM ep GROUP BY person")
def topic_sets(spark, sf):
    return X.topic_sets(profile(spark, sf)).select("person", F.size("topics").cast("bigint").alias("n_topics"), F.array_join(F.transform("topics", lambda t: t.cast("string")), ",").alias("topics"))


@query(
    f"""WITH {_EP}, b AS (SELECT src AS person, dst AS partner FROM edges WHERE src <> dst AND weight >= 5 UNION SELECT dst, src FROM edges WHERE src <> dst AND weight >= 5),
    z AS (SELECT person, count(*) AS n FROM b GROUP BY person),
    r AS (SELECT b.person, topic, avg(score) AS mean, count(*) AS cnt FROM b JOIN ep ON ep.person = b.partner GROUP BY ALL),
    q AS (SELECT r.person, topic, round_even(mean * least(1.0, 5.0 * cnt / greatest(n, 1)), 4) AS raw FROM r JOIN z USING (person)),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY raw DESC, topic) AS rk FROM q) WHERE rk <= 20)
    SELECT person, topic, round(raw, 4) AS raw_score FROM t"""
)
def inferred_profile_raw(spark, sf):
    """The twenty best topics guessed from the neighbours, before scaling."""
    e = table(spark, sf, "edges").where("src != dst AND weight >= 5")
    near = e.select(F.col("src").alias("person"), F.col("dst").alias("neighbour")).union(e.select("dst", "src")).distinct()
    p = profile(spark, sf)
    size = near.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    seen = near.join(p.select(F.col("person").alias("neighbour"), "topic", "score"), "neighbour").groupBy("person", "topic").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("cnt"))
    raw = seen.join(size, "person").withColumn("raw", F.bround(F.col("mean") * F.least(F.lit(1.0), 5.0 * F.col("cnt") / F.greatest("n", F.lit(1))), 4))
    return X.top_k(raw, ["person"], [F.desc("raw"), F.asc("topic")], 20).select("person", "topic", F.round("raw", 4).alias("raw_score"))


@query(
    f"""WITH {_EP}, b AS (SELECT src AS person, dst AS partner FROM edges WHERE src <> dst AND weight >= 5 UNION SELECT dst, src FROM edges WHERE src <> dst AND weight >= 5),
    z AS (SELECT person, count(*) AS n FROM b GROUP BY person),
    r AS (SELECT b.person, topic, avg(score) AS mean, count(*) AS cnt FROM b JOIN ep ON ep.person = b.partner GROUP BY ALL),
    q AS (SELECT r.person, topic, round_even(round(mean * least(1.0, 5.0 * cnt / greatest(n, 1)) * 1e9) / 1e5, 0) / 1e4 AS raw FROM r JOIN z USING (person)),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY raw DESC, topic) AS rk FROM q) WHERE rk <= 20),
    s AS (SELECT person, topic, round_even(round(raw / nullif(max(raw) OVER (PARTITION BY person), 0) * 0.5 * 1e9) / 1e5, 0) / 1e4 AS score FROM t)
    SELECT person, topic, CAST(greatest(1, round_even(round(200 * score, 6), 0)) AS INT) AS cnt, score FROM s"""
)
def inferred_profile(spark, sf):
    """The profile guessed from the neighbours, scaled to a maximum of one half, with the counts that go with it."""
    e = table(spark, sf, "edges").where("src != dst AND weight >= 5")
    near = e.select(F.col("src").alias("person"), F.col("dst").alias("neighbour")).union(e.select("dst", "src")).distinct()
    return X.inferred_profile(near, profile(spark, sf))


@query(f"WITH {_EP} SELECT count(DISTINCT person) AS n_persons, count(DISTINCT topic) AS n_topics, CAST(sum(cnt) AS BIGINT) AS total, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, count(*) FILTER (score > 0.3) AS n_strong FROM ep")
def profile_summary(spark, sf):
    p = profile(spark, sf)
    return p.agg(
        F.countDistinct("person").alias("n_persons"), F.countDistinct("topic").alias("n_topics"), F.sum("cnt").alias("total"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"), F.count_if(F.col("score") > 0.3).alias("n_strong"),
    )


@query(f"WITH {_EP} SELECT topic, count(DISTINCT person) AS holders, count(DISTINCT person) - 1 AS others, CASE WHEN count(DISTINCT person) < 10 THEN 'RARE' WHEN count(DISTINCT person) < 50 THEN 'MODERATE' ELSE 'COMMON' END AS tier FROM ep GROUP BY topic")
def topic_holders(spark, sf):
    h = profile(spark, sf).groupBy("topic").agg(F.countDistinct("person").alias("holders"))
    return h.select("topic", "holders", (F.col("holders") - 1).alias("others"), F.when(F.col("holders") < 10, "RARE").when(F.col("holders") < 50, "MODERATE").otherwise("COMMON").alias("tier"))


@query(f"WITH {_EP}, h AS (SELECT topic, count(*) AS holders FROM ep GROUP BY topic) SELECT person, topic AS rarest_topic, holders FROM (SELECT person, topic, holders, row_number() OVER (PARTITION BY person ORDER BY holders, topic) AS rk FROM ep JOIN h USING (topic)) WHERE rk = 1")
def rarest_topic(spark, sf):
    p = profile(spark, sf)
    h = p.groupBy("topic").agg(F.count(F.lit(1)).alias("holders"))
    return p.join(h, "topic").groupBy("person").agg(F.min_by("topic", F.struct("holders", "topic")).alias("rarest_topic"), F.min("holders").alias("holders"))


@query(f"WITH {_EP} SELECT topic, n FROM (SELECT topic, count(*) AS n FROM ep GROUP BY topic) ORDER BY n DESC, topic LIMIT 10")
def most_frequent_topics(spark, sf):
    """A report: the ten topics with most persons."""
    return profile(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("topic")).limit(10)
