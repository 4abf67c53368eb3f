"""Mixed timestamp texts brought to one unambiguous instant.

Every text is matched against a few layouts. A layout may allow several readings (month or day first, one of the zones
that share an abbreviation); all readings that name a valid instant are candidates. Per source, expectation-maximisation
over the mixture of readings turns candidates into posteriors: a text counts for each of its valid readings in
proportion to the present weights, the weights are the normalised counts plus a prior. A reading is chosen if its
posterior reaches ``certainty``; otherwise the row is marked as ambiguous and gets no instant. A stated convention of a
source is a prior without mass on the other reading, so it decides every text of that source.

Only (source, layout, candidate set) triples with their counts leave the map side, so EM works on a few rows a source
whatever the number of texts.

Defined results
* null, blank and unreadable texts, impossible dates and times: status ``invalid``, no instant;
* a text without zone whose source has no time zone: status ``no_zone``, no instant;
* more than one reading left after EM: status ``ambiguous``, no instant; else status ``ok``;
* a local time that occurs twice is the earlier instant, a skipped one is read with the offset before the change;
* numbers count seconds below 1e11, milliseconds below 1e14, microseconds from there, since 1970 UTC;
* years of two digits lie in 1990-2089; parts not given are zero; digits beyond microseconds are cut off.
"""

from __future__ import annotations

import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations, their offsets, and the regions that use them.
ABBREVIATIONS = [
    ("EST", "-05:00", ["America/"]),
    ("EDT", "-04:00", ["America/"]),
    ("CST", "-06:00", ["America/"]),
    ("CST", "+08:00", ["Asia/Shanghai", "Asia/Taipei"]),
    ("CDT", "-05:00", ["America/"]),
    ("MST", "-07:00", ["America/"]),
    ("MDT", "-06:00", ["America/"]),
    ("PST", "-08:00", ["America/"]),
    ("PDT", "-07:00", ["America/"]),
    ("BST", "+01:00", ["Europe/London"]),
    ("BST", "+06:00", ["Asia/Dhaka"]),
    ("IST", "+05:30", ["Asia/Kolkata", "Asia/Calcutta"]),
    ("IST", "+01:00", ["Europe/Dublin"]),
    ("IST", "+02:00", ["Asia/Jerusalem"]),
    ("CET", "+01:00", ["Europe/"]),
    ("CEST", "+02:00", ["Europe/"]),
]
_SHARED = sorted({a for a, _, _ in ABBREVIATIONS if sum(x[0] == a for x in ABBREVIATIONS) > 1})

_TIME = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?: *([AaPp])[Mm](?![A-Za-z]))?"
_ZONE = r"(?: *([Zz]|[+-]\d\d(?::?\d\d)?|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_/+-]+))?(?: *\([^)]*\))?"
_DAY = r"(?:[A-Za-z]{3,9},? +)?"
# layout, pattern, replacement to year|month|day|hour|minute|second|fraction|half day|zone
LAYOUTS = [
    ("iso", rf"^(\d{{4}})-(\d\d)-(\d\d)[T ]+{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", rf"^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d){_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7"),
    ("day_month", rf"^{_DAY}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}|\d\d) +{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_day", rf"^{_DAY}([A-Za-z]{{3,9}}) +(\d{{1,2}}),? +(\d{{4}}),? +{_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("year_last", rf"^{_DAY}([A-Za-z]{{3,9}}) +(\d{{1,2}}) +(\d\d?):(\d\d):(\d\d)(?: +([A-Za-z]{{2,5}}|[+-]\d{{4}}))? +(\d{{4}}){_ZONE}$", "$7|$1|$2|$3|$4|$5|||$6$8"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d\d),? +{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d\d),? +{_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _parts(text: Column) -> Column:
    """'layout|year|month|…' of the first layout that matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern, to in reversed(LAYOUTS):
        out = F.when(text.rlike(pattern), F.concat(F.lit(f"{name}|"), F.regexp_replace(text, pattern, to))).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.cast("int"))


def _month(c: Column) -> Column:
    word = F.lower(c)
    names = F.create_map(*[x for i, (a, b) in enumerate(zip(_MONTHS, _FULL)) for k in dict.fromkeys((a, b, "sept" if i == 8 else a)) for x in (F.lit(k), F.lit(i + 1))])
    return F.when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(names[word])


def _region(c: Column) -> Column:
    """The name if it is a known region, else null: an unknown one would end the job."""
    known = ",".join(["UTC", "GMT", *sorted(z for z in zoneinfo.available_timezones() if "/" in z)])
    return F.when(F.array_contains(F.split(F.lit(known), ","), c), c)


def _zone(c: Column) -> Column:
    """An offset or region for what is written, null if it is an abbreviation, unknown or nothing."""
    offset = (
        F.when(c.rlike(r"^[+-]\d\d$"), F.concat(c, F.lit(":00")))
        .when(c.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(c, 1, 3), F.lit(":"), F.substring(c, 4, 2)))
        .when(c.rlike(r"^[+-]\d\d:\d\d$"), c)
    )
    return F.when(F.upper(c).isin("Z", "UT", "UTC", "GMT"), F.lit("+00:00")).when(offset.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"), offset).when(c.contains("/"), _region(c))


def _try_instant(year, month, day, hour, minute, second, zone) -> Column:
    return F.try_make_timestamp(year, month, day, hour, minute, second, zone)


def readings(df: DataFrame, text_col: str, zone_col: str) -> DataFrame:
    """Adds _layout, _kind and the array _cands of struct(reading, utc) with every reading that is a valid instant."""
    text = F.regexp_replace(F.col(f"`{text_col}`"), r"^\s+|\s+$", "")
    number = F.when(text.rlike(r"^\d{1,17}$"), text.cast("bigint"))
    df = df.withColumn("_text", text).withColumn("_number", number).withColumn("_parts", F.split(F.when(F.col("_number").isNull(), _parts(F.col("_text"))), r"\|"))
    p = lambda i: F.get(F.col("_parts"), F.lit(i))
    year = F.when(F.length(p(1)) == 2, p(1).cast("int") + F.when(p(1).cast("int") >= 90, 1900).otherwise(2000)).otherwise(_int(p(1)))
    hour = _int(p(4))
    half = F.lower(p(8))
    hour = F.when(half == "", hour).when(~hour.between(1, 12), None).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
    second = F.concat(F.when(p(6) == "", F.lit("0")).otherwise(p(6)), F.lit("."), F.substring(F.concat(p(7), F.lit("000000")), 1, 6)).cast("decimal(8,6)")
    second = F.when(second < 60, second)
    df = df.withColumns({"_layout": F.when(F.col("_number").isNotNull(), F.lit("number")).otherwise(p(0)), "_y": year, "_a": _month(p(2)), "_b": _int(p(3)), "_h": hour, "_mi": _int(p(5)), "_s": second, "_z": p(9)})
    known = _zone(F.col("_z"))
    abbreviation = F.upper(F.col("_z"))
    site = _region(F.col(f"`{zone_col}`"))
    # (reading, month, day) x (reading, zone); nearly every text has one of each
    days = F.when(
        F.col("_layout") == "slashed",
        F.array(F.struct(F.lit("month first").alias("r"), F.col("_a").alias("m"), F.col("_b").alias("d")), F.struct(F.lit("day first").alias("r"), F.col("_b").alias("m"), F.col("_a").alias("d"))),
    ).otherwise(F.array(F.struct(F.lit("").alias("r"), F.col("_a").alias("m"), F.col("_b").alias("d"))))
    zone_type = "array<struct<r:string,z:string>>"
    of_abbreviation = F.lit(None).cast(zone_type)
    for short in dict.fromkeys(a for a, _, _ in ABBREVIATIONS):
        options = F.array(*[F.struct(F.lit(f"{short} {o}" if sum(x[0] == short for x in ABBREVIATIONS) > 1 else "").alias("r"), F.lit(o).alias("z")) for a, o, _ in ABBREVIATIONS if a == short])
        of_abbreviation = F.when(abbreviation == short, options).otherwise(of_abbreviation)
    zones = (
        F.when(known.isNotNull(), F.array(F.struct(F.lit("").alias("r"), known.alias("z"))))
        .when(F.col("_z") == "", F.array(F.struct(F.lit("").alias("r"), site.alias("z"))))
        .otherwise(of_abbreviation)
    )
    both = F.flatten(
        F.transform(days, lambda d: F.transform(zones, lambda z: F.struct(F.concat_ws(" ", F.when(d["r"] != "", d["r"]), F.when(z["r"] != "", z["r"])).alias("reading"), _try_instant(F.col("_y"), d["m"], d["d"], F.col("_h"), F.col("_mi"), F.col("_s"), z["z"]).alias("utc"))))
    )
    n = F.col("_number")
    counted = F.array(F.struct(F.lit("").alias("reading"), F.timestamp_micros(F.when(n < 10**11, n * 1000000).when(n < 10**14, n * 1000).otherwise(n)).alias("utc")))
    cands = F.when(F.col("_layout") == "number", counted).otherwise(F.filter(both, lambda c: c["utc"].isNotNull()))
    no_zone = (F.col("_z") == "") & site.isNull() & F.col("_layout").isNotNull() & (F.col("_layout") != "number")
    df = df.withColumn("_cands", F.coalesce(cands, F.array().cast("array<struct<reading:string,utc:timestamp>>"))).withColumn("_no_zone", F.coalesce(no_zone, F.lit(False)))
    return df.drop("_text", "_number", "_parts", "_y", "_a", "_b", "_h", "_mi", "_s", "_z")


def _em(prior_mass: float, rounds: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source and layout: posteriors of the readings of each candidate set."""
        rows = []
        pdf = pdf[pdf.readings.notna()]
        for _, group in pdf.groupby("layout", dropna=False):
            names = sorted({r for s in group.readings for r in s})
            day_first, zone = group.day_first.iloc[0], group.zone.iloc[0]

            def prior(reading: str) -> float:
                mass = prior_mass
                if "first" in reading and day_first is not None and not pd.isna(day_first):
                    mass *= float(("day first" in reading) == bool(day_first))
                for short, offset, regions in ABBREVIATIONS:
                    if f"{short} {offset}" in reading and isinstance(zone, str):
                        mass *= float(any(zone.startswith(r) for r in regions))
                return mass

            priors = {r: prior(r) for r in names}
            weights = {r: priors[r] / (sum(priors.values()) or 1) for r in names}
            for _ in range(rounds):
                counts = {r: 0.0 for r in names}
                for s, n in zip(group.readings, group.n):
                    total = sum(weights[r] for r in s)
                    for r in s:
                        counts[r] += n * weights[r] / total if total and priors[r] else 0.0
                whole = sum(counts[r] + priors[r] for r in names) or 1.0
                weights = {r: (counts[r] + priors[r]) / whole if priors[r] else 0.0 for r in names}
            for s in group.readings:
                total = sum(weights[r] for r in s)
                best = max(s, key=lambda r: (weights[r], r))
                rows.append((group.source.iloc[0], group.layout.iloc[0], list(s), best if total else None, weights[best] / total if total else 0.0))
        return pd.DataFrame(rows, columns=["source", "layout", "readings", "reading", "posterior"])

    return fit


def normalise_timestamps(
    df: DataFrame, text_col: str, source_col: str, zone_col: str, day_first_col: str, prior_mass: float = 1.0, rounds: int = 30, certainty: float = 0.95, max_broadcast_rows: int = 20_000
) -> DataFrame:
    """``df`` with utc_instant (TIMESTAMP), reading, posterior and status (see the module).

    ``zone_col`` holds the IANA name of the source's time zone, ``day_first_col`` its order of slashed dates; null
    where it is not known, then EM decides from the source's own texts. Input columns named as a result are replaced.
    """
    # the row travels as one column, so none of its own names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    inner = df.select(row, *[F.col(f"`{c}`").alias(n) for c, n in ((text_col, "_in_text"), (source_col, "_in_source"), (zone_col, "_in_zone"), (day_first_col, "_in_first"))])
    found = readings(inner, "_in_text", "_in_zone")
    # one candidate that needs no choice never enters EM; only layouts with readings do
    several = F.exists(F.col("_cands"), lambda c: c["reading"] != "")
    names = F.transform(F.col("_cands"), lambda c: c["reading"])
    source = F.coalesce(F.col("_in_source").cast("string"), F.lit(""))
    found = found.withColumns({"_source": source, "_names": F.when(several, names)})
    # the first filter reads the text alone, so that pushing it down repeats no parsing; sets without a choice are left
    # out inside the fit for the same reason
    open_text = F.col("_in_text").rlike(r"^\s*\d+/\d+/") | F.upper("_in_text").rlike(r"\b(" + "|".join(_SHARED) + r")\b")
    sets = (
        found.where(open_text)
        .groupBy(F.col("_source").alias("source"), F.col("_layout").alias("layout"), F.col("_names").alias("readings"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("_in_first").alias("day_first"), F.max("_in_zone").alias("zone"))
    )
    choice = "source string, layout string, readings array<string>, reading string, posterior double"
    chosen = sets.groupBy("source").applyInPandas(_em(prior_mass, rounds), choice)
    renamed = lambda c: c.toDF("_source", "_layout", "_names", "_reading", "_posterior")
    few = chosen.limit(max_broadcast_rows + 1).collect()
    if len(few) <= max_broadcast_rows:
        small = df.sparkSession.createDataFrame([tuple(r) for r in few], choice)
        out = found.join(F.broadcast(renamed(small)), ["_source", "_layout", "_names"], "left")
    else:  # very many sources: only rows with a choice enter the exchange, so null keys cannot pile up in one task
        named = found.where(open_text).join(renamed(chosen), ["_source", "_layout", "_names"], "left")
        out = named.unionByName(found.where(~F.coalesce(open_text, F.lit(False))), allowMissingColumns=True)
    sure = F.col("_names").isNull() | (F.col("_posterior") >= certainty)
    picked = F.get(F.filter(F.col("_cands"), lambda c: F.col("_names").isNull() | (c["reading"] == F.col("_reading"))), F.lit(0))["utc"]
    utc = F.when(sure, picked)
    status = (
        F.when(F.col("_no_zone"), "no_zone")
        .when(F.size("_cands") == 0, "invalid")
        .when(utc.isNotNull(), "ok")
        .when(F.col("_reading").isNull(), "invalid")
        .otherwise("ambiguous")
    )
    columns = [F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("utc_instant", "reading", "posterior", "status")]
    return out.select(
        *columns, utc.alias("utc_instant"), F.when(utc.isNotNull(), F.coalesce("_reading", F.lit(""))).alias("reading"), F.when(utc.isNotNull(), F.coalesce("_posterior", F.lit(1.0))).alias("posterior"), status.alias("status")
    )


def utc_text(instant: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss.SSSSSS' in UTC whatever the session's time zone."""
    micros = F.unix_micros(instant)
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1000000).cast("decimal(18,6)")).cast("decimal(18,6)"))
    text = wall.cast("string")
    return F.rpad(F.when(text.contains("."), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
