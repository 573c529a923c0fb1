"""Registered classifiers, judged on rows they did not learn from."""

import pytest

from rastermill.plans.catalog import QUERIES


@pytest.mark.parametrize("name,groups", [("kernel_machines", {"rbf": 0.92, "poly": 0.92, "sigmoid": 0.95}), ("network_scores", {None: 0.9})])
def test_held_out_accuracy(spark, name, groups):
    rows = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    for group, least in groups.items():
        own = [r for r in rows if group is None or r.kernel == group]
        held = [r.label == r.prediction for r in own if r.held_out]
        assert len(own) == 2000 and len(held) > 400 and sum(held) / len(held) >= least, (group, sum(held) / len(held))


def test_the_best_setting_holds_on_rows_kept_aside(spark):
    rows = QUERIES["tuned_with_holdout"](spark, "/root/testdata/sf0.1").collect()
    assert 300 < len(rows) < 500 and {r.params for r in rows} <= {"regParam=0.001", "regParam=0.1"}
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.9


def test_the_last_of_equal_trainings_stays():
    from rastermill.operators.learning import best_of

    assert best_of([("a", 0.5), ("b", 0.2), ("c", 0.2), ("d", 0.3)]) == "c" and best_of([]) is None


def test_kernel_values_against_landmarks(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from rastermill.operators import kernels, learning

    x = np.random.default_rng(4).normal(size=(20, 3))
    rows = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "vec_id long, x array<double>").withColumn("features", array_to_vector("x"))
    assert learning.kernel_gamma(rows, "auto") == pytest.approx(1 / 3) and learning.kernel_gamma(rows, "scale") == pytest.approx(1 / (3 * x.var()))
    for kernel in (kernels.Kernel("linear"), kernels.Kernel("rbf", 0.4), kernels.Kernel("poly", 0.4, 3, 0.5), kernels.Kernel("sigmoid", 0.4, coef0=0.1)):
        lifted = learning.with_kernel(rows, x[:5].tolist(), kernel.name, kernel.gamma, kernel.degree, kernel.coef0)
        got = {r.vec_id: r.lifted.toArray() for r in lifted.collect()}
        assert np.allclose([got[k] for k in range(20)], kernel.between(x, x[:5]))


def test_centre_candidates(spark):
    from rastermill.operators import segmentation

    square = [(1, r, c) for r in range(6, 15) for c in range(6, 15)]
    line = [(1, 17, c) for c in range(3, 18)]
    mask = spark.createDataFrame(square + line, "image_id long, r int, c int")
    images = spark.createDataFrame([(1, 20, 22)], "image_id long, height int, width int")
    found = {(x.r, x.c) for x in segmentation.center_candidates(mask, images, 2, 1, 2).collect()}
    assert (10, 10) in found and found <= {(r, c) for _, r, c in square + line}
    assert segmentation.center_candidates(mask.limit(0), images, 2, 1, 2).count() == 0
