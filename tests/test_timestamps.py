import pytest
from pyspark.sql import functions as F

from tacitra.operators.timestamps import normalise_timestamps, utc_text

CH, LO, KO, PX = ("hq", "America/Chicago", False), ("ldn", "Europe/London", True), ("blr", "Asia/Kolkata", True), ("dsrt", "America/Phoenix", False)
CASES = [
    (CH, "Mon, 31 Dec 1979 16:59:59 -0700 (MST)", "1979-12-31 23:59:59.000000"),
    (CH, " 1999-01-06T17:54:30.628Z\t", "1999-01-06 17:54:30.628000"),
    (CH, "01/08/1999 19:52", "1999-01-09 01:52:00.000000"),
    (LO, "01/08/1999 19:52", "1999-08-01 18:52:00.000000"),
    (CH, "07/01/1999 2:48 AM", "1999-07-01 07:48:00.000000"),
    (CH, "07/01/1999 12:05 AM", "1999-07-01 05:05:00.000000"),
    (CH, "31/31/2001 10:00", None),
    (CH, "25/03/2001 10:00", None),  # the site writes the month first
    (CH, "19990107T111556Z", "1999-01-07 11:15:56.000000"),
    (CH, "01.04.2001 02:59", "2001-04-01 08:59:00.000000"),  # skipped hour: the offset before the change
    (CH, "2000-10-29 01:30:00", "2000-10-29 06:30:00.000000"),  # occurs twice: the earlier instant
    (CH, "29-Oct-00 01:30:00 CST", "2000-10-29 07:30:00.000000"),
    (CH, "915700053", "1999-01-07 09:07:33.000000"),
    (CH, "915475459622", "1999-01-04 18:44:19.622000"),
    (CH, "915511751004428", "1999-01-05 04:49:11.004428"),
    (CH, "1999-01-04 17:26:22 Asia/Kolkata", "1999-01-04 11:56:22.000000"),
    (CH, "1999-01-04 17:26:22 Mars/Base", None),
    (CH, "1999-01-06T09:45:33-05", "1999-01-06 14:45:33.000000"),
    (CH, "1999-01-06 02:02:22.549242-06:00", "1999-01-06 08:02:22.549242"),
    (CH, "1999-01-07T07:40:53,963", "1999-01-07 13:40:53.963000"),
    (CH, "Sun Jan 10 08:26:07 1999", "1999-01-10 14:26:07.000000"),
    (CH, "Sun Jan 10 08:26:07 CST 1999", "1999-01-10 14:26:07.000000"),
    (CH, "Sun Jan 10 08:26:07 +0100 1999", "1999-01-10 07:26:07.000000"),
    (CH, "Mon Jan  4 21:57:53 1999", "1999-01-05 03:57:53.000000"),
    (CH, "January 20, 1999 1:35:46 AM EST", "1999-01-20 06:35:46.000000"),
    (KO, "January 17, 1999 5:22:52 AM +05:30", "1999-01-16 23:52:52.000000"),
    (KO, "14-Jan-99 19:55:36 IST", "1999-01-14 14:25:36.000000"),
    (LO, "5-Sep-00 05:35:58 BST", "2000-09-05 04:35:58.000000"),
    (CH, "29 Oct 1998 05:20:01 UT", "1998-10-29 05:20:01.000000"),
    (PX, "2000-07-01 00:00:00", "2000-07-01 07:00:00.000000"),
    (CH, "1-Jan-89 00:00:00 GMT", "2089-01-01 00:00:00.000000"),
    (CH, "1-Jan-90 00:00:00 GMT", "1990-01-01 00:00:00.000000"),
    (CH, "0000-00-00 00:00:00", None),
    (CH, "Thu, 00 Xxx 0000 25:61:00", None),
    (CH, "2001-02-29 10:00:00", None),
    (CH, "2001-02-28 24:00:00", None),
    (CH, "13:00 PM", None),
    (CH, "yesterday", None),
    (CH, "", None),
    (CH, None, None),
    ((None, None, None), "1999-01-06 10:00:00", None),
    ((None, None, None), "1999-01-06T10:00:00Z", "1999-01-06 10:00:00.000000"),
    (("odd", "No/Zone", False), "1999-01-06 10:00:00", None),
    (CH, "x" * 50000, None),
]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, t, *s, "clash") for i, (s, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, date string, site string, zone string, day_first boolean, _cands string").withColumn("status", F.lit("old"))
    out = normalise_timestamps(df, "date", "site", "zone", "day_first")
    return {r.id: r for r in out.withColumn("text", utc_text(F.col("utc_instant"))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(done, i):
    assert done[i].text == CASES[i][2], (CASES[i], done[i])


def test_clashing_names(done):
    assert all(r["_cands"] == "clash" and r.status != "old" for r in done.values())


def test_status(done):
    kinds = {CASES[i][1]: r.status for i, r in done.items()}
    assert kinds["yesterday"] == "invalid" and kinds["31/31/2001 10:00"] == "invalid" and kinds[None] == "invalid"
    assert [r.status for i, r in done.items() if CASES[i][0][0] is None] == ["no_zone", "ok"]


def test_em_learns_the_order_of_a_source(spark):
    """Without a stated convention the unambiguous dates of a source decide the others; without any, they stay open."""
    rows = [("uk", f"{d}/03/2001 10:00") for d in range(13, 29)] + [("uk", "02/03/2001 10:00"), ("us", "03/20/2001 10:00"), ("us", "03/21/2001 10:00")] + [("us", f"03/{d}/2001 11:00") for d in range(13, 29)]
    rows += [("us", "02/03/2001 10:00"), ("none", "02/03/2001 10:00")]
    df = spark.createDataFrame([(*r, "UTC", None) for r in rows], "site string, date string, zone string, day_first boolean")
    got = {(r.site, r.date): (r.status, r.utc_instant) for r in normalise_timestamps(df, "date", "site", "zone", "day_first", certainty=0.9).collect()}
    assert got["uk", "02/03/2001 10:00"][1].month == 3 and got["us", "02/03/2001 10:00"][1].month == 2
    assert got["none", "02/03/2001 10:00"] == ("ambiguous", None)


def test_many_sources_take_the_other_way(spark):
    rows = [(str(i), "02/03/2001 10:00", "UTC", i % 2 == 0) for i in range(20)] + [("x", "2001-01-01T00:00:00Z", "UTC", None)]
    df = spark.createDataFrame(rows, "site string, date string, zone string, day_first boolean")
    one = normalise_timestamps(df, "date", "site", "zone", "day_first")
    two = normalise_timestamps(df, "date", "site", "zone", "day_first", max_broadcast_rows=3)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
    assert normalise_timestamps(df.limit(0), "date", "site", "zone", "day_first").count() == 0


def test_conventions_withheld(spark):
    import os

    import pytest

    from tacitra.plans import packed

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    stated = {tuple(r) for r in packed.p7_found(spark, sf).collect()}
    inferred = {tuple(r) for r in packed.p7_inferred(spark, sf).collect()}
    assert inferred <= stated and len(inferred) >= 0.98 * len(stated)


def test_choices_in_a_broadcast_or_a_join(spark):
    rows = [(f"s{i % 7}", d) for i, d in enumerate(["13/01/2000 10:00", "01/02/2000 10:00", "25/12/1999 8:00", "03/04/2001 9:00", None, "no date", "1999-01-02 03:04:05Z"] * 20)]
    df = spark.createDataFrame(rows, "site string, date string").selectExpr("site", "date", "'Europe/London' AS tz", "cast(null AS boolean) AS df")
    one, two = (sorted(map(str, normalise_timestamps(df, "date", "site", "tz", "df", max_broadcast_rows=n).collect())) for n in (0, 20_000))
    assert one == two and len(one) == len(rows)
