"""Queries on names, mail sources, words, vectors and event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitra.operators import identity as I
from tacitra.operators import topics as T
from tacitra.operators.dims import SYSTEM_ACCOUNT
from tacitra.operators.timestamps import normalise_timestamps
from tacitra.plans.packed import _P7
from tacitra.sources import mail as M
from tacitra.sources.tables import table
from tacitra.streaming.counts import session_counts, windowed_counts

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_PEOPLE = "p AS (SELECT DISTINCT lower(trim(k)) AS email FROM (SELECT unnest(map_keys(display_names)) AS k FROM clean_names) WHERE trim(k) <> '')"


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "clean_names").select(F.explode(F.map_keys("display_names")).alias("k"))
    return keys.select(F.lower(F.trim("k")).alias("email")).where("email != ''").distinct()


@query(f"WITH {_PEOPLE} SELECT email, regexp_matches(split_part(email, '@', 1), '{SYSTEM_ACCOUNT}') OR regexp_full_match(split_part(email, '@', 1), '[0-9]+') OR (length(split_part(email, '@', 1)) <= 6 AND regexp_matches(split_part(email, '@', 1), '[0-9]')) AS is_system FROM p")
def system_accounts(spark, sf):
    return addresses(spark, sf).select("email", I.is_system_account(F.col("email")).alias("is_system"))


@query(
    f"""WITH {_PEOPLE}, n AS (SELECT lower(trim(e.key)) AS email, min(trim(e.value)) AS name FROM (SELECT unnest(map_entries(display_names)) AS e FROM clean_names) WHERE e.value IS NOT NULL AND trim(e.value) <> '' GROUP BY 1),
    r AS (SELECT DISTINCT lower(trim(x)) AS email FROM (SELECT unnest(removed) AS x FROM clean_names)), d AS (SELECT lower(trim(e.key)) AS email, min(lower(trim(e.value))) AS canonical FROM (SELECT unnest(map_entries(duplicates)) AS e FROM clean_names) GROUP BY 1)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN r.email IS NOT NULL THEN 'removed' WHEN canonical IS NOT NULL THEN 'duplicate' WHEN name IS NOT NULL THEN 'discovered' ELSE 'unknown' END AS kind
      FROM (SELECT email FROM p UNION SELECT email FROM r) a LEFT JOIN r USING (email) LEFT JOIN d USING (email) LEFT JOIN n USING (email)) GROUP BY kind"""
)
def address_kinds(spark, sf):
    """How many addresses are removed, duplicates, named or unknown."""
    e = table(spark, sf, "clean_names")
    low = lambda c: F.lower(F.trim(c))
    removed = e.select(F.explode("removed").alias("x")).select(low("x").alias("email")).distinct()
    twice = e.select(F.explode("duplicates").alias("k", "v")).select(low("k").alias("email"), low("v").alias("canonical"))
    named = e.select(F.explode("display_names").alias("k", "v")).where("trim(v) != ''").select(low("k").alias("email"), F.trim("v").alias("name"))
    none = e.sparkSession.createDataFrame([], "email string, name string")
    out = I.classify_addresses(addresses(spark, sf).union(removed), removed, twice, none, named)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PEOPLE} SELECT email, array_to_string(list_transform(list_filter(regexp_split_to_array(split_part(email, '@', 1), '[._]'), lambda t: t <> ''), lambda t: upper(t[1]) || t[2:]), ' ') AS name, CASE WHEN contains(email, '@') THEN regexp_extract(email, '@([^@]*)$', 1) ELSE '' END AS domain FROM p")
def formatted_names(spark, sf):
    return addresses(spark, sf).select("email", I.formatted_name(F.col("email")).alias("name"), I.domain_part(F.col("email")).alias("domain"))


@query(
    r"""WITH m AS (SELECT row_id, lower(regexp_extract("from", '([^\s<>"(),;:\[\]]+@[^\s<>"(),;:\[\]]+)', 1)) AS email, "from" AS f FROM enron_emails),
    c AS (SELECT row_id, email, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(f, '<') THEN f ELSE '' END, '\s*</O=[^>]*>?', '', 'gi'), '\s*<[^>]*>', '', 'g'), '@[A-Z]{2,}\b\S*', '', 'g'), '\s*<IMCEA[^>]*>?', '', 'gi'), '\s*\([^)]*\)\s*$', '', 'g'), '(/[A-Z]+)+$', '', 'g') AS n FROM m WHERE email <> ''),
    d AS (SELECT row_id, email, trim(regexp_replace(n, '["'']', '', 'g')) AS n FROM c),
    e AS (SELECT row_id, email, trim(regexp_replace(CASE WHEN regexp_full_match(n, '[^,]+,\s*[^,]+') THEN regexp_replace(n, '^([^,]+),\s*([^,]+)$', '\2 \1') ELSE n END, '\s+', ' ', 'g')) AS n FROM d)
    SELECT email, arg_min(n, row_id) FILTER (n <> '') AS name FROM e GROUP BY email"""
)
def header_names(spark, sf):
    """Every sender's address with the cleaned name as first written beside it, null where none ever was."""
    m = table(spark, sf, "enron_emails").select(F.lower(F.regexp_extract("from", r"([^\s<>\"(),;:\[\]]+@[^\s<>\"(),;:\[\]]+)", 1)).alias("email"), "from", "row_id").where("email != ''")
    name = F.nullif(I.clean_header_name(F.when(F.col("from").contains("<"), F.col("from")).otherwise("")), F.lit(""))
    return m.withColumn("name", name).groupBy("email").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("row_id"))).alias("name"))


@query(f"SELECT year(CAST(utc AS TIMESTAMP)) AS year, count(*) AS n FROM ({_P7}) JOIN enron_emails USING (row_id) WHERE CAST(utc AS TIMESTAMP) BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2002-12-31 23:59:59' AND \"from\" IS NOT NULL AND \"to\" IS NOT NULL GROUP BY 1")
def mails_by_year(spark, sf):
    """Mail of 1998 to 2002 with sender and recipient, by year of the instant; dates of any layout, those without a sure instant left out."""
    mails = table(spark, sf, "enron_emails").select("date", "site", (F.col("from").isNotNull() & F.col("to").isNotNull()).alias("addressed"))
    m = normalise_timestamps(mails.join(table(spark, sf, "mail_sites"), "site", "left"), "date", "site", "time_zone", "day_first").withColumn("d", F.col("utc_instant"))
    m = m.where("addressed").where(F.col("d").between(F.lit("1998-01-01 00:00:00").cast("timestamp"), F.lit("2002-12-31 23:59:59").cast("timestamp")))
    return m.groupBy(F.year("d").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(None)
def mail_parse_roundtrip(spark, sf):
    """Every mail written as a raw message with all its headers and parsed again.

    message_id, subject and body come back as they are in the table, but for: ids and subjects trimmed, line breaks in
    headers one space, empty bodies null. Line ends and characters of a body stay. A header that is null in the table is
    null, a blank subject is ''. Addresses and date are what the parser reads of the field, null where it is not in the
    form of mail headers; a mail without any header is null throughout.
    """
    m = table(spark, sf, "enron_emails")
    raw = M.raw_message(*[F.col(c) for c in ("message_id", "date", "from", "to", "cc", "subject", "body")])
    parsed = M.parse_mail(m.select(F.col("row_id").cast("string").alias("file"), raw.alias("message")))
    return parsed.select(F.col("file").cast("bigint").alias("row_id"), "message_id", "date", "from", "to", "cc", "subject", "body")


@query(
    """WITH t AS (SELECT source AS label, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents WHERE text IS NOT NULL),
    k AS (SELECT label, word, count(*) AS tf FROM t WHERE length(word) > 2 GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM k GROUP BY 1), z AS (SELECT sum(tf) / count(DISTINCT label) AS a FROM k), n AS (SELECT label, sum(tf) AS n FROM k GROUP BY 1),
    s AS (SELECT label, word, tf / n * ln(1 + a / f) AS tfidf FROM k JOIN f USING (word) JOIN n USING (label), z)
    SELECT label, CAST(rk AS INT) AS rk, word FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(tfidf, 9) DESC, word) AS rk FROM s) WHERE rk <= 8"""
)
def class_words(spark, sf):
    return T.class_words(table(spark, sf, "documents"), "source", "text").select("label", "rk", "word")


_KEYWORDS = [(1, "Trading", "position", 3), (1, "Trading", "deal", 3), (1, "Trading", "curve", 1), (2, "Operations", "outage", 3), (2, "Operations", "meter", 3), (2, "Operations", "pressure", 1), (3, "Legal", "agreement", 3), (3, "Legal", "notice", 1)]


@query(
    "WITH cw AS (" + SQL["class_words"] + "), k(cat_ord, category, word, weight) AS (VALUES " + ", ".join(map(str, _KEYWORDS)) + """), s AS (SELECT label AS topic, cat_ord, category, sum(weight) AS s FROM cw JOIN k USING (word) GROUP BY 1, 2, 3),
    b AS (SELECT topic, arg_min(category, row(-s, cat_ord)) AS category FROM s GROUP BY topic) SELECT DISTINCT label AS topic, coalesce(category, 'General Operations') AS category FROM cw LEFT JOIN b ON topic = label"""
)
def categories_of_words(spark, sf):
    """Sources put into categories by a small table of keywords."""
    words = T.class_words(table(spark, sf, "documents"), "source", "text").groupBy(F.col("label").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "word"))), lambda x: x["word"]).alias("words"))
    return T.categorise(words, spark.createDataFrame(_KEYWORDS, "cat_ord int, category string, word string, weight int"), "General Operations")


@query(
    """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
    d AS (SELECT vec_id, c.label, sum(embedding[i]::DOUBLE * m) / (sqrt(sum(embedding[i]::DOUBLE * embedding[i]::DOUBLE)) * sqrt(sum(m * m))) AS s FROM embeddings, c GROUP BY 1, 2)
    SELECT vec_id, label, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS rk FROM d) WHERE rk = 1"""
)
def centroid_assign(spark, sf):
    v = table(spark, sf, "embeddings")
    return T.assign(v, "vec_id", "embedding", T.centroids(v, "label", "embedding", 64)).select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query(None)
def cluster_sizes(spark, sf):
    """Clusters fitted to the vectors, small ones as outliers, with their sizes."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return T.with_clusters(v, "embedding", T.fit_clusters(v, "embedding", 10)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def hashed_sample(spark, sf):
    """A repeatable sample of 500 documents (the sampling operator)."""
    return T.hashed_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 500)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, sf):
    return windowed_counts(table(spark, sf, "events"), "ts", ["event_type"]).withColumn("window_start", F.unix_micros("window_start"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, epoch_us(min(ts)) AS window_start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS window_end, count(*) AS n FROM g GROUP BY user_id, k"""
)
def event_sessions(spark, sf):
    out = session_counts(table(spark, sf, "events"), "ts", ["user_id"])
    return out.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def event_properties(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
