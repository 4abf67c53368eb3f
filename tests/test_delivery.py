from datetime import datetime

from pyspark.sql import functions as F

from tacitra.operators.delivery import keep_first, message_key, surplus_rows

T = [datetime(2000, 1, d) for d in range(1, 6)]
ROWS = [
    (1, T[1], "<A.1@Mail.Example>", "late"),
    (2, T[0], " A.1@mail.example ", "first"),
    (3, T[0], "<A.1@MAIL.EXAMPLE>", "tie"),
    (4, T[0], "<a.1@mail.example>", "other case before @"),
    (5, T[0], None, "none"),
    (6, T[0], None, "none"),
    (7, T[0], " <> ", "blank"),
    (8, None, "b@x", "no time"),
    (9, T[4], "b@x", "timed"),
    (10, T[2], "plain", "x"),
    (11, T[3], "plain", "x"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "row_id bigint, received_at timestamp, message_id string, _key string")


def test_surplus_and_kept(spark):
    df = frame(spark)
    key = message_key(F.col("message_id"))
    assert sorted(r[0] for r in surplus_rows(df, key, "received_at", "row_id").collect()) == [1, 3, 8, 11]
    kept = keep_first(df, key, "received_at", "row_id")
    assert kept.columns == df.columns
    assert sorted(r.row_id for r in kept.collect()) == [2, 4, 5, 6, 7, 9, 10]
    assert {r.row_id: r["_key"] for r in kept.collect()}[2] == "first"


def test_repeated_and_empty(spark):
    key = message_key(F.col("message_id"))
    twice = frame(spark, ROWS[:4] * 2)
    assert sorted(r[0] for r in surplus_rows(twice, key, "received_at", "row_id").collect()) == [1, 3]
    assert sorted(r.row_id for r in keep_first(twice, key, "received_at", "row_id").collect()) == [2, 4]
    empty = frame(spark).limit(0)
    assert surplus_rows(empty, key, "received_at", "row_id").count() == 0 and keep_first(empty, key, "received_at", "row_id").count() == 0


def test_null_row_ids(spark):
    key = message_key(F.col("message_id"))
    df = frame(spark, [(None, T[0], "a@x", ""), (None, T[1], "a@x", ""), (1, T[2], "a@x", "")])
    assert [r[0] for r in surplus_rows(df, key, "received_at", "row_id").collect()] == [1]
    assert [r.row_id for r in keep_first(df, key, "received_at", "row_id").collect()] == [None, None]


def test_hot_identifier(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.timestamp_seconds(F.lit(5000) - F.col("id")).alias("received_at"), F.when(F.col("id") % 3 == 0, "hot@x").otherwise(F.concat(F.col("id").cast("string"), F.lit("@x"))).alias("message_id"))
    assert surplus_rows(df, message_key(F.col("message_id")), "received_at", "row_id").count() == 1666


def test_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, rnd.choice(T), rnd.choice(["a@X", "A@x", "<a@x>", None, " a@x", "b"]), "") for i in range(300)]
    groups = {}
    for i, t, m, _ in rows:
        if m is not None:
            k = m.strip(" <>")
            k = k.split("@")[0] + "@" + k.split("@")[1].lower() if "@" in k else k
            groups.setdefault(k, []).append((t, i))
    expected = sorted(i for g in groups.values() for _, i in sorted(g)[1:])
    assert sorted(r[0] for r in surplus_rows(frame(spark, rows), message_key(F.col("message_id")), "received_at", "row_id").collect()) == expected


def test_ties_shared_by_identifiers(spark):
    df = spark.createDataFrame([("A", T[1], 1), ("B", T[0], 0), ("B", T[2], 1), ("C", T[0], 5), ("C", T[3], 5)], "m string, t timestamp, tie bigint")
    kept = keep_first(df, F.col("m"), "t", "tie")
    assert sorted(map(tuple, kept.collect())) == [("A", T[1], 1), ("B", T[0], 0), ("C", T[0], 5)]
    assert sorted(r[0] for r in surplus_rows(df, F.col("m"), "t", "tie").collect()) == [1, 5]


def test_every_kind_of_tie_break_agrees(spark):
    import random

    rnd = random.Random(11)
    rows = [(rnd.choice("abcd"), rnd.choice([*T, None]), rnd.choice([-(2**63), -5, 0, 7, 2**63 - 1]), i) for i in range(400)]
    best = {}
    for m, t, tie, _ in rows:
        best[m] = min(best.get(m, (2, 0, 0)), (t is None, t or 0, tie))
    expected = sorted((m, t or None, tie) for m, (_, t, tie) in best.items())
    df = spark.createDataFrame(rows, "m string, t timestamp, tie bigint, extra int")
    assert sorted((r.m, r.t, r.tie) for r in keep_first(df, F.col("m"), "t", "tie").collect()) == expected
    texts = df.withColumn("tie", F.lpad((F.col("tie").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"))
    assert sorted((r.m, r.t, int(r.tie) - 2**63) for r in keep_first(texts, F.col("m"), "t", "tie").collect()) == expected


def test_aggregated_by_hash(spark):
    plan = surplus_rows(frame(spark), message_key(F.col("message_id")), "received_at", "row_id", unique_ties=True)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
