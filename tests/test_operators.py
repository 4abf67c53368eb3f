import random

import pytest
from pyspark.sql import functions as F

from tacitra.operators import cascade as C
from tacitra.operators import curves as V
from tacitra.operators import dims as D
from tacitra.operators import expertise as X
from tacitra.operators import identity as I
from tacitra.operators import risk as R
from tacitra.operators import simulate as S
from tacitra.operators import topics as T


def one(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first().x


def profile(spark, rows):
    return spark.createDataFrame(rows, "person string, topic int, cnt int, score double")


def test_expertise(spark):
    p = profile(spark, [("a", 1, 6, 1.0), ("b", 1, 18, 1.0), ("a", 2, 30, 0.6), ("b", 2, 3, 0.3), ("c", 3, 1, 0.4), ("c", 4, 1, 0.5), ("d", 5, 1, 0.2)])
    assert {tuple(r) for r in X.topics_top_expert(p).collect()} == {("a", 2), ("c", 2), ("d", 1)}
    assert {tuple(r) for r in X.topic_monopoly(p).collect()} == {("a", 1)}  # 0.3 and 0.5 themselves do not count
    assert {r.topic: r.n_requests for r in X.request_schedule(p.where("person = 'a'")).collect()} == {1: 1, 2: 2}
    v = {r.topic: (r.n_experts, r.hhi, round(r.vulnerability, 4), [x.person for x in r.top_experts]) for r in X.topic_vulnerability(p).collect()}
    assert v[5] == (0, 1.0, 2.0, ["d"]) and v[1] == (2, 0.5, 0.75, ["a", "b"])
    same = X.min_max(spark.createDataFrame([(1, 2.0), (2, 2.0)], "i int, x double"), ["x"])
    assert [r.x_norm for r in same.collect()] == [0.0, 0.0]
    assert X.topic_vulnerability(p.limit(0)).count() == 0


def test_quadrants_and_ladders(spark):
    q = lambda kr, pi: spark.range(1).select(R.quadrant(F.lit(kr), F.lit(pi)).alias("q")).first().q
    assert q(0.12, 0.65) == "Organizational Emergency" and q(0.11995, 0.2) == "Silent Threat" and q(0.1199, 0.65) == "Replaceable Executive" and q(0.0, 0.6499) == "Low Priority"
    impact = {"Senior Vice President": 0.95, "Junior Associate": 0.20, "Executive Assistant, Office of the Chairman": 0.15, "Coordinator": 0.15, "VP, Trading": 0.65, "Managing Director": 0.75, "Director": 0.5, "Assistant Director": 0.30, "Analyst": 0.3, "Poet": 0.25, None: 0.25}
    for title, expected in impact.items():
        assert one(spark, title, lambda c: D.positional_impact(c.cast("string"))) == expected, title
    assert one(spark, "Vice President", D.role_category) == "Communications" and one(spark, "Vice President", lambda c: D.role_category(c, with_pr=False)) == "Executive"
    assert spark.range(1).select(D.department(F.lit("Chief Counsel"), F.lit("Legal"))).first()[0] == "Executive"
    topics = {r.category: r.automability for r in D.ai_topics(spark).collect()}
    assert topics["Government Relations"] == 14 and topics["Document Mgmt & Admin"] == 84
    assert one(spark, "abc", R.name_hash) == (97 * 31 + 98) * 31 + 99
    counts = R.quadrant_counts(spark.createDataFrame([("Silent Threat",)], "quadrant string"))
    assert {tuple(r) for r in counts.collect()} == {("Silent Threat", 1), ("Low Priority", 0), ("Organizational Emergency", 0), ("Replaceable Executive", 0)}


def test_risk_in_unit_interval(spark):
    rnd = random.Random(1)
    rows = [(f"p{i}", rnd.randrange(5), rnd.random(), rnd.random() * 9, rnd.randrange(3), 0) for i in range(40)]
    m = spark.createDataFrame(rows, "person string, topic_monopoly int, betweenness double, weighted_degree double, topics_top_expert int, component_delta int")
    scores = [r.risk for r in R.risk_score(m).collect()]
    assert len(scores) == 40 and min(scores) >= 0 and max(scores) <= 0.95


def naive_plateau(rates, step=0.01):
    n = len(rates)
    for i in range(n - 1):
        if all(abs(rates[j] - rates[j - 1]) < step for j in range(i + 1, n)):
            return i + 1
    return None


def test_plateau_against_the_loop(spark):
    rnd = random.Random(4)
    series = {p: [round(rnd.choice([0.1, 0.105, 0.2, 0.205]), 3) for _ in range(12)] for p in range(200)}
    series |= {900: [0.5] * 12, 901: [i / 20 for i in range(12)], 902: [0.1] * 10 + [0.5, 0.5]}
    df = spark.createDataFrame([(p, m + 1, r) for p, s in series.items() for m, r in enumerate(s)], "person int, month int, rate double")
    got = {r.person: r.plateau_month for r in V.plateau_month(df).collect()}
    assert got == {p: naive_plateau(s) for p, s in series.items()}
    flat = {r.person: r.flat_month for r in V.first_flat_month(df).collect()}
    assert flat[901] == 12 and flat[900] == 2


def test_losses_and_padding(spark):
    q = {("a", 1): [0.1] * 6 + [0.9] * 6, ("b", 1): [0.9] * 3 + [0.1] * 9, ("c", 1): [0.30] * 12, ("d", 1): [0.1] * 5 + [0.9] * 7}
    df = spark.createDataFrame([(p, t, m + 1, x) for (p, t), s in q.items() for m, x in enumerate(s)], "person string, topic int, month int, q double")
    assert {tuple(r) for r in V.permanent_loss(df).collect()} == {("a", 1, 6), ("b", 1, 9)}
    n = {(r.person, r.month): r.n for r in V.cumulative_losses(V.permanent_loss(df)).collect()}
    assert n["a", 5] == 0 and n["a", 6] == 1 and n["b", 12] == 1
    arrays = spark.createDataFrame([(1, [0.1, 0.2]), (2, []), (3, [float(i) for i in range(15)]), (4, None)], "i int, s array<double>")
    got = {r.i: r.p for r in arrays.select("i", V.padded(F.col("s")).alias("p")).collect()}
    assert got[1] == [0.1] + [0.2] * 11 and got[2] == [0.0] * 12 and got[3] == [float(i) for i in range(12)] and got[4] == [0.0] * 12
    best = {(r.person, r.month): r.best for r in V.running_best(df).collect()}
    assert best["d", 5] == 0.1 and best["d", 6] == 0.9


def test_simulation(spark):
    rows = [
        ("x", 1, 1.0, 2, "a", 0.9, 1, 1.0, 0.5),  # full, one request a month
        ("x", 1, 1.0, 2, "b", 0.8, 2, 9.0, 0.4),  # 0.56: takes the rest
        ("x", 2, 0.5, 1, None, None, None, None, None),  # nobody
    ]
    can = spark.createDataFrame(rows, "departed string, topic int, dep_score double, n_requests int, cand string, score double, tier int, bandwidth double, readiness double")
    log = sorted(S.simulate(can).collect(), key=lambda r: r.seq)
    first = [r for r in log if r.month == 1]
    assert [(r.topic, r.step, r.quality, r.agent) for r in first] == [(1, 1, "full", "a"), (1, 2, "partial", "b"), (2, 4, "none", None)]
    assert first[0].ratio == pytest.approx(0.9 * 0.5 * 0.40) and first[1].ratio == pytest.approx(0.8 * 0.4 * 0.40)
    assert len(log) == 36
    months = {r.month: r for r in S.timeline(spark.createDataFrame(log, S.LOG)).collect()}
    assert months[1].n_lost == 1 and months[12].n_recovered == 2 and months[1].loss_rate == 0.3333
    lost = V.permanent_loss(S.topic_quality(spark.createDataFrame(log, S.LOG)))
    assert ("x", 2, 6) in {tuple(r) for r in lost.collect()}


def test_upgrade_and_ties(spark):
    rows = [("x", 1, 1.0, 12, "b", 0.75, 1, 99.0, 1.0), ("x", 1, 1.0, 12, "a", 0.75, 1, 99.0, 1.0)]
    can = spark.createDataFrame(rows, "departed string, topic int, dep_score double, n_requests int, cand string, score double, tier int, bandwidth double, readiness double")
    log = sorted(S.simulate(can).collect(), key=lambda r: r.seq)
    assert {r.agent for r in log} == {"a"}  # the tie goes to the smaller name, then its learning keeps it ahead
    assert log[1].base_ratio == pytest.approx(0.78)


def test_cascade(spark):
    people = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.2)], "person string, risk double")
    gone = C.ranked_removed(people.where("person != 'c'"))
    prof = spark.createDataFrame([("a", "T", 1.0), ("a", "T", 0.5), ("b", "T", 0.5), ("c", "T", 1.0)], "person string, category string, score double")
    tau = C.overlap_factor(C.category_vectors(prof), gone)
    assert tau.first().tau == 0.5
    t = C.cascade_total(gone, tau).first()
    assert t.plain == pytest.approx(0.7) and t.total == 1.0 and t.amplification == 43
    assert C.live_risk(people, prof, gone).first().live_risk == pytest.approx(0.2 + 0.015 + 0.023)
    assert {tuple(r) for r in C.topic_hits(prof, gone).collect()} == {("T", 2, "LOST")}
    assert C.overlap_factor(C.category_vectors(prof), gone.where("i = 0")).first().tau == 0.0


def test_identity(spark):
    names = {"Varberg, Susan (Legal)": "Susan Varberg", "Susan Varberg </O=CORP/OU=NA/CN=SV>": "Susan Varberg", 'Ann  Lee <ann@x.example>': "Ann Lee", "Ann Lee@CORV": "Ann Lee", "'Ann Lee'": "Ann Lee", "Susan Varberg/HQ/CORV": "Susan Varberg"}
    for raw, expected in names.items():
        assert one(spark, raw, I.clean_header_name) == expected, raw
    system = {"40desk@x": True, "noreply@x": True, "12345678@x": True, "ab1@x": True, "abcdef1@x": False, "ann.lee@x": False}
    for address, expected in system.items():
        assert one(spark, address, I.is_system_account) is expected, address
    assert one(spark, "ann_lee.x7@y", I.formatted_name) == "Ann Lee X7" and one(spark, "none", I.domain_part) == ""
    assert one(spark, "Ann Lee", I.valid_successor) and not one(spark, "Ann", I.valid_successor) and not one(spark, "Ann L33", I.valid_successor)
    t = lambda rows, s: spark.createDataFrame(rows, s)
    out = I.classify_addresses(t([(" A@x",), ("b@x",), ("c@x",), ("d.e@x",), (None,), ("f@x",)], "email string"), t([("a@x",)], "email string"), t([("b@x", "z@x"), ("a@x", "z@x")], "email string, canonical string"), t([("c@x", "Cy")], "email string, name string"), t([("f@x", "Flo"), ("c@x", "no")], "email string, name string"))
    assert {(r.email, r.kind, r.name) for r in out.collect()} == {("a@x", "removed", "A"), ("b@x", "duplicate", "B"), ("c@x", "fixed", "Cy"), ("d.e@x", "unknown", "D E"), ("f@x", "discovered", "Flo")}


def test_topics(spark):
    words = spark.createDataFrame([(1, ["Gas", "gas", "pipe"]), (2, ["law", "gas"]), (3, ["none"])], "topic int, words array<string>")
    keys = spark.createDataFrame([(1, "Fuel", "gas", 3), (2, "Law", "law", 3), (1, "Fuel", "pipe", 1)], "cat_ord int, category string, word string, weight int")
    assert {tuple(r) for r in T.categorise(words, keys, "Other").collect()} == {(1, "Fuel"), (2, "Fuel"), (3, "Other")}
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.0, 0.0], 1)], "id int, v array<double>, label int")
    got = {r.id: (r.label, round(r.similarity, 3)) for r in T.assign(v, "id", "v", T.centroids(v, "label", "v", 2)).collect()}
    assert got[1][0] == 0 and got[3] == (1, 1.0) and got[4] == (0, 0.0)
    small = T.without_small(spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id int, label int"), 2)
    assert {tuple(r) for r in small.select("id", "label").collect()} == {(1, 5), (2, 5), (3, -1)}
