import random

from tacitra.operators import topics as T


def test_nearest_centroid_in_one_block_or_many(spark):
    rnd = random.Random(9)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(200, None), (201, []), (202, [0.0] * 5), (3, [9.0] * 5)]
    centres = [(f"c{i:02}", [rnd.gauss(0, 1) for _ in range(5)]) for i in range(23)] + [("d", [1.0] * 5), ("e", [2.0] * 5), ("z", [0.0] * 5)]
    v = spark.createDataFrame(vectors, "id int, v array<double>")
    c = spark.createDataFrame(centres, "label string, centroid array<double>")

    def cosine(a, b):
        if not a or len(a) != len(b):
            return 0.0
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    expected = {}
    for i, a in vectors:
        best = min((-round(cosine(a, b), 9), label) for label, b in centres)
        expected[i] = min(expected.get(i, (9, "")), best)
    for block in (4, 10_000):
        got = {r.id: (-round(r.similarity, 9) + 0.0, r.label) for r in T.assign(v, "id", "v", c, block=block).collect()}
        assert {k: x[1] for k, x in got.items()} == {k: x[1] for k, x in expected.items()}
        assert all(abs(got[k][0] - expected[k][0]) < 1e-8 for k in got)
    assert T.assign(v, "id", "v", c.limit(0)).count() == 0 and T.assign(v.limit(0), "id", "v", c).count() == 0


def test_clusters_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rnd = random.Random(1)
    rows = [(i, [float(10 * (i % 3)) + rnd.random(), rnd.random()]) for i in range(120)] + [(500, [90.0, 90.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    model = T.fit_clusters(df, "v", 4)
    model.write().overwrite().save(str(tmp_path / "model"))
    labels = {r.id: r.label for r in T.with_clusters(df, "v", PipelineModel.load(str(tmp_path / "model"))).collect()}
    assert labels == {r.id: r.label for r in T.with_clusters(df, "v", model).collect()}
    assert labels[500] == -1 and len({labels[i] for i in range(120)}) == 3 and all(len({labels[i] for i in range(k, 120, 3)}) == 1 for k in range(3))
