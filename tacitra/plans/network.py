"""Queries on the communication graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitra.operators import graph as G
from tacitra.operators.unpack import unpack_fields
from tacitra.plans.packed import SQL as _PACKED
from tacitra.sources.tables import table

_E = "e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(coalesce(weight, 1.0)) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2)"
_B = f"{_E}, b AS (SELECT src AS person, dst AS partner, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"

QUERIES, SQL = {}, {}
P1 = _PACKED["p1_found"]


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.fold_edges(table(spark, sf, "edges"))


@query(f"WITH {_E} SELECT src, dst, round(weight, 6) AS weight FROM e")
def comm_edges(spark, sf):
    return edges(spark, sf).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""WITH d AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(w)::DOUBLE AS weight FROM d GROUP BY 1, 2""")
def trade_edges(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    d = rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return G.fold_edges(d.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


@query(
    r"""WITH s AS (SELECT row_id, lower(trim(regexp_extract("from", '([^\s<>"]+@[^\s<>"]+)', 1))) AS f FROM enron_emails WHERE "from" IS NOT NULL),
    d AS (SELECT f, lower(trim(value)) AS v FROM s JOIN (P1) p USING (row_id) WHERE p.field = 'to'),
    e AS (SELECT least(f, v) AS src, greatest(f, v) AS dst FROM d WHERE f <> '' AND v <> '' AND f <> v) SELECT src, dst, count(*)::DOUBLE AS weight FROM e GROUP BY 1, 2""".replace("P1", P1)
)
def mail_edges(spark, sf):
    """Edges counted from the mail itself: senders with the recipients unpacked from ``to`` (never cc)."""
    mails = table(spark, sf, "enron_emails")
    to = unpack_fields(mails, "row_id", ["to"]).groupBy("row_id").agg(F.collect_list("value").alias("recipients"))
    return G.fold_edges(G.directed_edges(mails.select("row_id", F.col("from").alias("sender")).join(to, "row_id"), F.regexp_extract("sender", r"([^\s<>\"]+@[^\s<>\"]+)", 1), F.col("recipients")))


@query(f"WITH {_B}, n AS (SELECT count(DISTINCT person) AS n FROM b) SELECT person, count(*) AS degree, round(sum(weight), 6) AS weighted_degree, round(count(*) / (max(n) - 1), 6) AS degree_centrality FROM b, n GROUP BY person")
def degree(spark, sf):
    return G.degrees(edges(spark, sf)).select("person", "degree", F.round("weighted_degree", 6).alias("weighted_degree"), F.round("degree_centrality", 6).alias("degree_centrality"))


@query(f"WITH {_B} SELECT person, rk, partner, weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY person ORDER BY weight DESC, partner) AS INT) AS rk FROM b) WHERE rk <= 6")
def top_partners(spark, sf):
    return G.top_partners(edges(spark, sf), 6).select("person", "rk", "partner", "weight")


@query(
    f"""WITH {_B}, n1 AS (SELECT person, partner AS neighbour FROM b WHERE weight >= 5),
    n2 AS (SELECT DISTINCT n1.person, b.partner AS neighbour FROM n1 JOIN b ON b.person = n1.neighbour AND b.weight >= 3 WHERE b.partner <> n1.person)
    SELECT *, 1 AS tier FROM n1 UNION ALL SELECT *, 2 FROM n2 WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.person = n2.person AND n1.neighbour = n2.neighbour)"""
)
def neighbour_tiers(spark, sf):
    return G.neighbour_tiers(edges(spark, sf))


@query(
    f"""WITH RECURSIVE {_B}, s AS (SELECT person, partner FROM b),
    r(person, seen) AS (SELECT person, person FROM s UNION SELECT s.person, r.seen FROM s JOIN r ON s.partner = r.person)
    SELECT person, min(seen) AS component FROM r GROUP BY person"""
)
def components(spark, sf):
    """Components of the whole graph."""
    return G.components(edges(spark, sf))


@query(None)
def component_delta(spark, sf):
    return G.component_delta(edges(spark, sf))


@query(None)
def betweenness(spark, sf):
    return G.betweenness(edges(spark, sf)).select("person", F.round("betweenness", 9).alias("betweenness"))


@query(
    f"""WITH {_E}, t AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 50),
    g AS (SELECT * FROM e WHERE src IN (SELECT person FROM t) AND dst IN (SELECT person FROM t))
    SELECT src, dst, weight, round(weight / greatest(max(weight) OVER (), 1), 6) AS weight_norm FROM g"""
)
def top_risk_subgraph(spark, sf):
    """The graph among the fifty persons of highest risk, weights scaled by the largest."""
    top = table(spark, sf, "risk_scores").orderBy(F.desc("risk_score"), F.asc("person")).limit(50)
    g = G.subgraph(edges(spark, sf), top)
    most = g.agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("most"))
    return g.crossJoin(F.broadcast(most)).select("src", "dst", "weight", F.round(F.col("weight") / F.col("most"), 6).alias("weight_norm"))


@query(
    f"""WITH {_B}, t AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 20), d AS (SELECT person, count(*) AS degree FROM b GROUP BY person)
    SELECT person FROM d WHERE degree >= 3 UNION SELECT person FROM t"""
)
def shown_nodes(spark, sf):
    return G.shown_nodes(edges(spark, sf), table(spark, sf, "risk_scores"))


@query(
    f"""WITH {_B}, p AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY weight DESC, partner) AS rk FROM b)
    SELECT p.person, partner, weight, round(coalesce(r.risk_score, 0.05), 6) AS partner_risk FROM p LEFT JOIN risk_scores r ON r.person = p.partner WHERE rk <= 6"""
)
def ego_network(spark, sf):
    """Each person with its six closest partners and their risk (0.05 where unknown)."""
    risk = table(spark, sf, "risk_scores").select(F.col("person").alias("partner"), "risk_score")
    return G.top_partners(edges(spark, sf), 6).join(risk, "partner", "left").select("person", "partner", "weight", F.round(F.coalesce("risk_score", F.lit(0.05)), 6).alias("partner_risk"))


@query(
    f"""WITH {_B}, d AS (SELECT person, count(*) AS degree FROM b GROUP BY person), a AS (SELECT person FROM d ORDER BY degree DESC, person LIMIT 100),
    t AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 10), u AS (SELECT person FROM a UNION SELECT person FROM t)
    SELECT u.person, round(coalesce(r.risk_score, 0.0), 6) AS risk_score FROM u LEFT JOIN risk_scores r USING (person)"""
)
def exported_nodes(spark, sf):
    """The hundred best connected and the ten riskiest persons with their risk."""
    well = G.degrees(edges(spark, sf)).orderBy(F.desc("degree"), F.asc("person")).limit(100).select("person")
    risk = table(spark, sf, "risk_scores").select("person", "risk_score")
    both = well.union(risk.orderBy(F.desc("risk_score"), F.asc("person")).limit(10).select("person")).distinct()
    return both.join(risk, "person", "left").select("person", F.round(F.coalesce("risk_score", F.lit(0.0)), 6).alias("risk_score"))


@query(
    f"""WITH {_B}, t AS (SELECT lower(trim(email)) AS partner, min(title) AS title FROM titles WHERE title IS NOT NULL GROUP BY 1), j AS (SELECT b.person, coalesce(t.title, 'unknown') AS title, weight FROM b LEFT JOIN t USING (partner))
    SELECT person, title, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY person), 6) AS share FROM j GROUP BY person, title"""
)
def title_share(spark, sf):
    """The share of a person's communication by the partners' titles."""
    from pyspark.sql import Window

    t = table(spark, sf, "titles").where("title IS NOT NULL").groupBy(F.lower(F.trim("email")).alias("partner")).agg(F.min("title").alias("title"))
    j = G.symmetric(edges(spark, sf)).join(t, "partner", "left").groupBy("person", F.coalesce("title", F.lit("unknown")).alias("title")).agg(F.sum("weight").alias("w"))
    return j.select("person", "title", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("person")), 6).alias("share"))


@query(
    f"""WITH {_B}, t AS (SELECT person FROM risk_scores ORDER BY risk_score DESC, person LIMIT 5)
    SELECT t.person, count(DISTINCT partner) AS n_connected, round(sum(weight), 6) AS lost_weight FROM t JOIN b USING (person) GROUP BY t.person"""
)
def isolated_neighbours(spark, sf):
    """Who is directly connected with each of the five riskiest persons, and how much weight goes with them."""
    top = table(spark, sf, "risk_scores").orderBy(F.desc("risk_score"), F.asc("person")).limit(5).select("person")
    return G.symmetric(edges(spark, sf)).join(F.broadcast(top), "person").groupBy("person").agg(F.countDistinct("partner").alias("n_connected"), F.round(F.sum("weight"), 6).alias("lost_weight"))
