from tacitra.plans import departures


def test_two_hundred_departures(spark, tmp_path):
    rows = [(f"p{i:03d}", 1 - i / 1000) for i in range(250)]
    spark.createDataFrame(rows, "person string, risk_score double").write.parquet(str(tmp_path / "risk_scores.parquet"))
    assert sorted(r.person for r in departures.leaving(spark, str(tmp_path)).collect()) == [f"p{i:03d}" for i in range(200)]
