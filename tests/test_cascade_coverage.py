import pytest

from tacitra.operators import simulate as S
from tacitra.plans import risks


def test_departed_without_profile_is_inferred(spark):
    edges = spark.createDataFrame([("a", "x", 9.0), ("b", "x", 9.0), ("a", "b", 9.0)], "src string, dst string, weight double")
    profile = spark.createDataFrame([("a", 1, 8, 1.0), ("b", 1, 4, 0.5), ("b", 2, 4, 0.5)], "person string, topic int, cnt int, score double")
    departed = spark.createDataFrame([("x",), ("a",), ("alone",)], "person string")
    got = {(r.person, r.topic): (r.cnt, r.score) for r in S.departed_profile(departed, profile, edges).collect()}
    assert got == {("a", 1): (8, 1.0), ("x", 1): (100, 0.5), ("x", 2): (67, 0.3333)}
    roles = spark.createDataFrame([], "person string, role string")
    assert {r.departed for r in S.readiness(departed, profile, edges, roles).collect()} == {"a", "x"}


def test_loss_categories_lie_in_the_first_topics(spark):
    departed = spark.createDataFrame([("a",), ("b",)], "person string")
    top = spark.createDataFrame([("a", "Legal"), ("a", "Legal"), ("a", "Trading")], "person string, category string")
    losses = spark.createDataFrame([("a", "Legal"), ("a", "Legal"), ("a", "Tax")], "person string, category string")
    assert sorted(map(tuple, S.loss_categories(departed, top, losses).collect())) == [("a", 1, 2), ("b", 0, 1)]


def test_combined_metrics(spark):
    gone = spark.createDataFrame([("a",), ("b",)], "person string")
    gaps = spark.createDataFrame([("a", 0.335)], "departed string, external_hire_gap double")
    months = spark.createDataFrame([("a", 12, 0.5), ("a", 11, 0.1), ("b", 12, 0.1)], "departed string, month int, recovery_rate double")
    losses = spark.createDataFrame([("a", 2, 3), ("b", 1, 1)], "departed string, n_perm_loss_categories long, total_categories long")
    r = S.combined_metrics(gone, gaps, months, losses).first()
    assert (r.n, r.avg_hire_gap, round(r.avg_recovery_12, 6), r.total_perm_loss_categories) == (2, 17.0, 21.0, 3)
    with pytest.raises(Exception, match="2 to 5 persons"):
        S.combined_metrics(gone.limit(1), gaps, months, losses).collect()


def test_live_quadrant_follows_the_live_risk(spark, tmp_path):
    spark.createDataFrame([(f"g{i}", 0.9 - i / 100) for i in range(5)] + [("near", 0.10), ("far", 0.10)], "person string, risk_score double").write.parquet(str(tmp_path / "risk_scores.parquet"))
    spark.createDataFrame([("g0", 0, 5, 1.0), ("g1", 0, 5, 1.0), ("near", 0, 5, 1.0)], "from string, topic int, count int, score double").write.parquet(str(tmp_path / "expertise.parquet"))
    spark.createDataFrame([], "email string, title string").write.parquet(str(tmp_path / "titles.parquet"))
    assert {tuple(r) for r in risks.live_quadrant(spark, str(tmp_path)).collect()} == {("near", "Silent Threat"), ("far", "Low Priority")}
