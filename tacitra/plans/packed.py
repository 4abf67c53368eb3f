"""The queries of problems 1, 2 and 7 over the mail table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitra.operators.delivery import keep_first, message_key, surplus_rows
from tacitra.operators.timestamps import normalise_timestamps, utc_text
from tacitra.operators.unpack import unpack_fields
from tacitra.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_fields(table(spark, sf_dir, "enron_emails"), "row_id", ["to", "cc"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "enron_emails")
    return surplus_rows(mails, message_key(F.col("message_id")), "received_at", "row_id", unique_ties=True)


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail with one copy of each message, by row and file."""
    mails = table(spark, sf_dir, "enron_emails").select("row_id", "message_id", "received_at", "file")
    return keep_first(mails, message_key(F.col("message_id")), "received_at", "row_id", unique_ties=True).select("row_id", "file")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "enron_emails").select("row_id", "date", "site")
    sites = table(spark, sf_dir, "mail_sites")
    placed = mails.join(sites, "site", "left")
    done = normalise_timestamps(placed, "date", "site", "time_zone", "day_first")
    return done.where(F.col("utc_instant").isNotNull()).select("row_id", utc_text(F.col("utc_instant")).alias("utc"))


def p7_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found with the sites' order of slashed dates withheld: expectation-maximisation tells it from each site's own dates.

    Rows left ambiguous have no instant and no row here.
    """
    mails = table(spark, sf_dir, "enron_emails").select("row_id", "date", "site")
    sites = table(spark, sf_dir, "mail_sites").select("site", "time_zone", F.lit(None).cast("boolean").alias("day_first"))
    done = normalise_timestamps(mails.join(sites, "site", "left"), "date", "site", "time_zone", "day_first")
    return done.where(F.col("utc_instant").isNotNull()).select("row_id", utc_text(F.col("utc_instant")).alias("utc"))


def p7_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of slashed dates of each site as its own dates show it, nothing stated."""
    mails = table(spark, sf_dir, "enron_emails").select("row_id", "date", "site")
    sites = table(spark, sf_dir, "mail_sites").select("site", "time_zone", F.lit(None).cast("boolean").alias("day_first"))
    done = normalise_timestamps(mails.join(sites, "site"), "date", "site", "time_zone", "day_first", certainty=0.5)
    read = done.where(F.col("reading").contains("first"))
    return read.groupBy("site").agg((F.count_if(F.col("reading").contains("day first")) > F.count_if(F.col("reading").contains("month first"))).alias("day_first"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_kept": p2_kept, "p7_found": p7_found, "p7_inferred": p7_inferred, "p7_conventions": p7_conventions}

_T = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?: *([AaPp])[Mm]\b)?"
_Z = r"(?: *([Zz]|[+-]\d\d(?::?\d\d)?|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_/+-]+))?(?: *\([^)]*\))?"
_D = r"(?:[A-Za-z]{3,9},? +)?"
_LAYOUTS = [
    ("iso", rf"(\d{{4}})-(\d\d)-(\d\d)[T ]+{_T}{_Z}", "y m d h i s f p z"),
    ("compact", rf"(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d){_Z}", "y m d h i s z"),
    ("words", rf"{_D}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}|\d\d) +{_T}{_Z}", "d m y h i s f p z"),
    ("words", rf"{_D}([A-Za-z]{{3,9}}) +(\d{{1,2}}),? +(\d{{4}}),? +{_T}{_Z}", "m d y h i s f p z"),
    ("words", rf"{_D}([A-Za-z]{{3,9}}) +(\d{{1,2}}) +(\d\d?):(\d\d):(\d\d) +(\d{{4}}){_Z}", "m d h i s y z"),
    ("dotted", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d\d),? +{_T}{_Z}", "d m y h i s f p z"),
    ("slashed", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d\d),? +{_T}{_Z}", "m d y h i s f p z"),
]


def _sql_layout(kind: str, pattern: str, groups: str) -> str:
    names = ", ".join(f"'{g}'" for g in groups.split())
    columns = ", ".join(f"g.{c}" if c in groups.split() else f"'' AS {c}" for c in "ymdhisfpz")
    return f"SELECT row_id, tz, df, '{kind}' AS kind, {columns} FROM (SELECT row_id, tz, df, regexp_extract(t, '^{pattern}$', [{names}]) AS g FROM b WHERE regexp_full_match(t, '{pattern}'))"


_P7 = r"""WITH b AS (SELECT row_id, regexp_replace(date, '^\s+|\s+$', '', 'g') AS t, time_zone AS tz, day_first AS df FROM enron_emails LEFT JOIN mail_sites USING (site)),
    n AS (SELECT row_id, CASE WHEN k < 100000000000 THEN k * 1000000 WHEN k < 100000000000000 THEN k * 1000 ELSE k END AS us FROM (SELECT row_id, CAST(t AS BIGINT) AS k FROM b WHERE regexp_full_match(t, '[0-9]{1,17}'))),
    r AS (LAYOUTS),
    q AS (SELECT row_id, tz, z, kind, CAST(y AS INT) + CASE WHEN length(y) > 2 THEN 0 WHEN CAST(y AS INT) >= 90 THEN 1900 ELSE 2000 END AS y,
        CASE WHEN kind = 'words' THEN list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(m[1:3])) WHEN kind = 'slashed' AND df THEN CAST(d AS INT) ELSE CAST(m AS INT) END AS m,
        CASE WHEN kind = 'slashed' AND df THEN CAST(m AS INT) ELSE CAST(d AS INT) END AS d, CASE WHEN p = '' THEN CAST(h AS INT) WHEN lower(p) = 'p' THEN CAST(h AS INT) % 12 + 12 ELSE CAST(h AS INT) % 12 END AS h,
        CAST(i AS INT) AS i, CASE WHEN s = '' THEN 0 ELSE CAST(s AS INT) END AS s, CAST(rpad(f, 6, '0')[1:6] AS INT) AS f FROM r),
    l AS (SELECT *, TRY(make_timestamp(y, m, d, h, i, s + f / 1000000.0)) AS w, CASE WHEN z = '' THEN tz WHEN contains(z, '/') THEN z END AS zone, CASE WHEN upper(z) IN ('Z', 'UT', 'UTC', 'GMT') THEN 0
        WHEN z[1] IN ('+', '-') THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 60 + CASE WHEN length(z) > 3 THEN CAST(z[-2:] AS INT) ELSE 0 END)
        ELSE CASE upper(z) WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300 WHEN 'MST' THEN -420 WHEN 'MDT' THEN -360 WHEN 'PST' THEN -480 WHEN 'PDT' THEN -420 WHEN 'BST' THEN 60 WHEN 'IST' THEN 330 END END AS off FROM q),
    u AS (SELECT row_id, w, zone, CASE WHEN off IS NOT NULL THEN epoch_us(w) - CAST(off AS BIGINT) * 60000000 ELSE epoch_us(timezone(zone, w)) END AS us, off FROM l WHERE w IS NOT NULL),
    v AS (SELECT row_id, CASE WHEN off IS NULL AND timezone(zone, make_timestamptz(us - 3600000000)) = w THEN us - 3600000000 ELSE us END AS us FROM u UNION ALL SELECT * FROM n)
    SELECT row_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS utc FROM v WHERE us IS NOT NULL""".replace("LAYOUTS", " UNION ALL ".join(_sql_layout(*x) for x in _LAYOUTS))

_P2 = r"""WITH k AS (SELECT row_id, received_at, file, regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g') AS m FROM enron_emails),
        q AS (SELECT row_id, received_at, file, CASE WHEN m = '' THEN NULL WHEN contains(m, '@') THEN regexp_replace(m, '@[^@]*$', '') || '@' || lower(regexp_extract(m, '@([^@]*)$', 1)) ELSE m END AS k FROM k)"""

SQL = {
    "p7_found": _P7,
    "p7_conventions": "SELECT site, day_first FROM mail_sites WHERE site IN (SELECT site FROM enron_emails WHERE regexp_matches(date, '^\\s*[0-9]{1,2}/[0-9]{1,2}/'))",
    "p1_found": r"""WITH f AS (SELECT row_id, 'to' AS field, "to" AS s FROM enron_emails UNION ALL SELECT row_id, 'cc', cc FROM enron_emails),
        a AS (SELECT row_id, field, list_transform(regexp_extract_all(s, '[^\s<>()",;|/:]+@[^\s<>()",;|/:]+'), lambda x: lower(CASE WHEN length(x) > 2 AND x[1] = chr(39) AND x[-1] = chr(39) THEN x[2:-2] ELSE x END)) AS v FROM f WHERE contains(s, '@')),
        n AS (SELECT row_id, field, list_filter(list_transform(regexp_split_to_array(s, '[;|\n\t\r]'), lambda x: trim(x, ' "')), lambda x: trim(x, ' ,') <> '') AS v FROM f WHERE NOT contains(s, '@'))
        SELECT row_id, field, CAST(generate_subscripts(v, 1) AS INT) AS pos, unnest(v) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM n)""",
    "p2_kept": _P2 + " SELECT row_id, file FROM q QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY received_at, row_id) = 1",
    "p2_found": r"""WITH k AS (SELECT row_id, received_at, regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g') AS m FROM enron_emails),
        q AS (SELECT row_id, received_at, CASE WHEN m = '' THEN NULL WHEN contains(m, '@') THEN regexp_replace(m, '@[^@]*$', '') || '@' || lower(regexp_extract(m, '@([^@]*)$', 1)) ELSE m END AS k FROM k)
        SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY k ORDER BY received_at, row_id) AS rk FROM q WHERE k IS NOT NULL) WHERE rk > 1""",
}
