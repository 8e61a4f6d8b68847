"""The logistic kernel's sums against the plain formula."""

import numpy as np

from skeinflow.operators.traces import SLOPE, logistic_sums


def test_logistic_sums_equal_the_plain_formula(spark):
    rng = np.random.default_rng(3)
    seconds = {"a": rng.integers(0, 5_000_000, 4000), "b": np.array([7]), "c": np.concatenate((rng.integers(0, 50, 300), [10**9]))}
    widths = {"a": 40_000.5, "b": 1.0, "c": 3.25, "unused": 1.0}
    counts = {k: rng.integers(1, 9, len(v)) for k, v in seconds.items()}
    hist = spark.createDataFrame([(k, int(v), int(n)) for k, vs in seconds.items() for v, n in zip(vs, counts[k], strict=True)], "activity string, secs long, n long")
    hist = hist.groupBy("activity", "secs").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    points = [(k, i, float(t)) for k, v in seconds.items() for i, t in enumerate(rng.uniform(v.min() - 99, v.max() + 99, 60).tolist() + [float(v.min()), 1e12, -1e12])]
    got = logistic_sums(spark.createDataFrame(points, "activity string, i int, t double"), hist, spark.createDataFrame(list(widths.items()), "activity string, bw double")).collect()
    assert len(got) == len(points)
    for r in got:
        z = np.clip(SLOPE * (r.t - seconds[r.activity]) / widths[r.activity], -700, 700)
        assert abs(r.until - (counts[r.activity] / (1 + np.exp(-z))).sum()) <= 1e-11 * counts[r.activity].sum()
