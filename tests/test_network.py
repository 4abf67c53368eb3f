from tacitra.plans import network


def test_components_of_weak_and_strong_edges(spark, tmp_path):
    rows = [("a", "b", 25.0), ("b", "c", 1.0), ("d", "e", 2.0), ("e", "d", 30.0), ("f", "f", 50.0)]
    spark.createDataFrame(rows, "src string, dst string, weight double").write.parquet(str(tmp_path / "edges.parquet"))
    got = {tuple(r) for r in network.components(spark, str(tmp_path)).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    delta = {tuple(r) for r in network.component_delta(spark, str(tmp_path)).collect()}
    assert delta == {("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 0)}
