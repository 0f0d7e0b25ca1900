"""The quality classifier's parts beside plain computations."""

import numpy as np

from geomosaic.llm import quality


def test_pool_adjacent_is_the_best_ascending_fit():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = rng.integers(1, 7)
        total = rng.integers(1, 9, n).astype(float)
        positive = np.minimum(rng.integers(0, 9, n), total).astype(float)
        got = quality.pool_adjacent(total, positive)
        assert (np.diff(got) >= -1e-12).all()
        # max-min formula of the isotonic regression
        s, t = np.concatenate([[0], np.cumsum(positive)]), np.concatenate([[0], np.cumsum(total)])
        mean = lambda i, j: (s[j + 1] - s[i]) / (t[j + 1] - t[i])
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(got, want)


def test_statistics_of_a_text():
    got = dict(zip(quality.STATISTICS, quality.statistics("Ab 1!\nAb 1!\n\x00é").tolist()))
    raw = "Ab 1!\nAb 1!\n\x00é".encode()
    assert got["log_bytes"] == np.log1p(len(raw))
    assert [round(got[c] * len(raw)) for c in ("upper", "lower", "digit", "blank", "line_feed", "exclaim", "control", "high")] == [2, 2, 2, 2, 2, 2, 1, 2]
    assert got["repeated_lines"] == 1 - 2 / 3 and got["log_words"] == np.log1p(5)
    assert not quality.statistics("").any()


def test_the_solution_is_the_ridge_regressions(spark):
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    x = rng.standard_normal((400, d))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0).astype(int)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = quality.train(spark, stats, labels, F.lit(True))
    z = model.features(x)
    damp = np.diag([*[quality.RIDGE] * quality.DIMENSION, 1e-6])
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + damp, z.T @ y), atol=1e-6)
    assert (np.diff(model.heights) >= 0).all() and 0 <= model.heights.min() and model.heights.max() <= 1
    # the features' inner products are near the Gaussian kernel's
    kernel = np.exp(-0.5 * (1.2**2 / d) * ((((x[:50, None] - x[None, :50]) / model.features.scale) ** 2).sum(-1)))
    assert np.abs(z[:50, :-1] @ z[:50, :-1].T / quality.DIMENSION - kernel).mean() < 0.1
