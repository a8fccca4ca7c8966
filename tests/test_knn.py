import numpy as np

from tessera.operators import learn
from tessera.plans import queries


def test_every_row_is_predicted_from_all_others(spark):
    assert "knn_predict_all" in queries()
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((130, 6)), 1)
    x[60:80] = x[59]  # ties
    label = rng.integers(0, 4, 130)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(130)] + [(200, None, 1), (201, [float("nan")] * 6, 1), (202, [None] * 6, 1), (None, [0.0] * 6, 1)]
    want = {}
    for i in range(130):
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(130) if j != i)[:5]
        votes = [int(label[j]) for _, j in near]
        want[i] = min(set(votes), key=lambda c: (-votes.count(c), c))
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    for query_rows in (1000, 40):
        assert {r["id"]: r["pred"] for r in learn.knn_others(df, 5, query_rows).collect()} == want
    assert learn.knn_others(df.limit(1)).count() == learn.knn_others(df.limit(0)).count() == 0
