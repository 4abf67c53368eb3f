import os

from tacitra.sources import io
from tacitra.sources.mail import header, malformed, parse_mail
from tacitra.streaming.counts import deliver_once, windowed_counts

PLAIN = "Message-ID: <1@x>\nDate: Mon, 4 Jan 1999 10:00:00 -0800\nFrom: Ann <Ann@X.example>\nTo: b@x.example, \"C, D\" <c@x.example>\nSubject: Hi\nX-From: Ann Lee\n\nbody line\nsecond"
MULTI = 'Message-ID: <2@x>\nFrom: a@x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/plain\n\none\n--B\nContent-Type: text/html\n\n<b>no</b>\n--B\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ntwo =E9\n--B--\n'
BASE64 = "Message-ID: <3@x>\nFrom: a@x\nDate: not a date\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nY2Fmw6k="


def test_parse(spark):
    raw = spark.createDataFrame([("f1", PLAIN), ("f2", MULTI), ("f3", BASE64), ("f4", None), ("f5", ""), ("f6", "no header at all")], "file string, message string")
    got = {r.file: r for r in parse_mail(raw).collect()}
    assert got["f1"]["from"] == "ann@x.example" and got["f1"].to == "b@x.example, c@x.example" and got["f1"].cc is None
    assert str(got["f1"].date) == "1999-01-04 18:00:00" and got["f1"].body == "body line\nsecond"
    assert got["f2"].body == "one\ntwo é" and got["f2"].to is None
    assert got["f3"].body == "café" and got["f3"].date is None and got["f3"].message_id == "<3@x>"
    assert all(got[f].message_id is None and got[f].body is None for f in ("f4", "f5", "f6"))
    assert malformed(parse_mail(raw)).first().n_malformed == 3
    assert raw.select(header(raw.message, "X-From").alias("h")).first().h == "Ann Lee"


def test_files(spark, tmp_path):
    csv = tmp_path / "mail.csv"
    csv.write_text('file,message\nf1,"line one\nhe said ""hi"", bye"\nf2,short\n')
    assert {r.file: r.message for r in io.read_mail_csv(spark, str(csv)).collect()} == {"f1": 'line one\nhe said "hi", bye', "f2": "short"}
    doc = tmp_path / "words.json"
    doc.write_text('{"1": ["a", "b"],\n "2": []}')
    assert {r.key: r.value for r in io.read_json_map(spark, str(doc)).collect()} == {"1": ["a", "b"], "2": []}
    assert io.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    edges = spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, weight double")
    io.write_graphml(edges, str(tmp_path / "g"))
    assert [tuple(r) for r in io.read_graphml(spark, str(tmp_path / "g")).collect()] == [("a", "b", 2.0)]
    io.write_documents(spark.createDataFrame([(1, "old"), (2, "old")], "id int, t string"), str(tmp_path / "d1"))
    io.update_field(spark, str(tmp_path / "d1"), str(tmp_path / "d2"), "id", spark.createDataFrame([(1, "new")], "id bigint, t string"), "t")
    assert {(r.id, r.t) for r in spark.read.json(str(tmp_path / "d2")).collect()} == {(1, "new"), (2, "old")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "2000-01-01 10:05:00"), ("m1", "2000-01-01 10:06:00"), ("m2", "2000-01-01 11:10:00")], "id string, ts string")
    rows.selectExpr("id", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.id for r in run(deliver_once(stream, "id", "ts"), "once", "append")) == ["m1", "m2"]
    counts = run(windowed_counts(stream, "ts", ["id"]), "counts", "complete")
    assert {(r.id, r.window_start.hour, r.n) for r in counts} == {("m1", 10, 2), ("m2", 11, 1)}
    batch = windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["id"])
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in counts}


def test_entry_points_without_the_text_package():
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tacitra.llm.registry'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p8_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)
