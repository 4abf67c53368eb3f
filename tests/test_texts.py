from tacitra.plans import texts


def mails(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path / "enron_emails.parquet"))


def test_mails_by_year_reads_every_layout(spark, tmp_path):
    dates = ["2001-05-14T10:00:00.000Z", "Mon, 14 May 2001 10:00:00 -0700", "25/05/2001 10:00", "989834400", "2000-12-31 23:30:00 -0700", "14.05.1997 10:00", "no date", None]
    rows = [(i, d, "s", "a@x", "b@x") for i, d in enumerate(dates)] + [(90, dates[0], "s", None, "b@x"), (91, dates[0], "s", "a@x", None)]
    mails(spark, tmp_path, rows, "row_id long, date string, site string, from string, to string")
    spark.createDataFrame([("s", "Europe/London", True)], "site string, time_zone string, day_first boolean").write.parquet(str(tmp_path / "mail_sites.parquet"))
    assert [tuple(r) for r in texts.mails_by_year(spark, str(tmp_path)).collect()] == [(2001, 5)]


def test_roundtrip_keeps_every_mail(spark, tmp_path):
    rows = [
        (1, "<1@x>", "Mon, 14 May 2001 10:00:00 -0700", "A B <A@x.com>", "b@x.com, c@x.com", None, " Re: caf\u00e9 ", "Gr\u00fc\u00dfe \u20ac\r\nline\rend\n\u2028x\n"),
        (2, "<2@x>\n", None, None, "b@x.com,\r\n c@x.com", " ", None, "From a\n\nplain"),
        (3, None, "nothing", "a@x.com", None, "d@x.com", " ", ""),
        (4, "<4@x>", None, "a@x.com", None, None, "two\nlines", None),
    ]
    mails(spark, tmp_path, rows, "row_id long, message_id string, date string, from string, to string, cc string, subject string, body string")
    got = {r.row_id: r.asDict() for r in texts.mail_parse_roundtrip(spark, str(tmp_path)).collect()}
    assert {k: (r["message_id"], r["subject"], r["body"]) for k, r in got.items()} == {
        1: ("<1@x>", "Re: caf\u00e9", rows[0][7]),
        2: ("<2@x>", None, rows[1][7]),
        3: (None, "", None),
        4: ("<4@x>", "two lines", None),
    }
    assert {k: (r["from"], r["to"], r["cc"]) for k, r in got.items()} == {1: ("a@x.com", "b@x.com, c@x.com", None), 2: (None, "b@x.com, c@x.com", None), 3: ("a@x.com", None, "d@x.com"), 4: ("a@x.com", None, None)}
    assert {k: r["date"] and r["date"].isoformat()[:19] for k, r in got.items()} == {1: "2001-05-14T17:00:00", 2: None, 3: None, 4: None}
