"""Penalised networks: gradients against differences, sums over partitions against one, and what training does."""

import numpy as np
import pytest

from rastermill.operators.network import Moments, Training, _summed, first_parameters, is_weight, loss_and_gradient, train_network, with_probability

SIZES = (3, 5, 4, 1)


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 2, 1]
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 2)).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(k, a.tolist(), int(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "vec_id long, features array<double>, label int")


def test_gradients_are_differences_of_the_loss():
    x, y = data(40)
    at = first_parameters(SIZES, 3)
    loss, gradient = loss_and_gradient(SIZES, at, x, y)
    assert len(gradient) == len(at) == len(is_weight(SIZES)) == 3 * 5 + 5 + 5 * 4 + 4 + 4 + 1
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        apart = loss_and_gradient(SIZES, at + step, x, y)[0] - loss_and_gradient(SIZES, at - step, x, y)[0]
        assert gradient[k] == pytest.approx(apart / 2e-6, rel=1e-4, abs=1e-4)
    assert np.isfinite(loss_and_gradient(SIZES, at * 1e4, x, y)[0]) and loss > 0


def test_sums_over_partitions_are_the_sum(spark):
    x, y = data(100)
    at = first_parameters(SIZES, 3)
    rows = frame(spark, x, y).selectExpr("features as x", "cast(label as double) as y").repartition(7)
    want = loss_and_gradient(SIZES, at, x, y)[1]
    assert np.allclose(_summed(rows, lambda a, b: loss_and_gradient(SIZES, at, a, b)[1]), want)
    assert len(_summed(rows.limit(0), lambda a, b: a.sum(0))) == 0


def test_solvers_follow_their_formulas():
    adam, g = Moments(Training(learning_rate=0.1), 2), np.array([1.0, -4.0])
    assert np.allclose(adam.step(g), [-0.1, 0.1])  # the first step has the rate's length
    assert np.allclose(adam.step(np.zeros(2)), -0.1 * np.sign(g) * (0.09 / 0.19) / np.sqrt(0.000999 / 0.001999))
    sgd = Moments(Training(solver="sgd", learning_rate=0.1, momentum=0.5), 2)
    assert np.allclose(sgd.step(g), -0.15 * g) and np.allclose(sgd.first, -0.1 * g)
    with pytest.raises(ValueError):
        Training(solver="newton")


@pytest.mark.parametrize("solver,rate", [("adam", 0.05), ("sgd", 0.1)])
def test_training_lowers_the_loss_and_holds_on_fresh_rows(spark, solver, rate):
    x, y = data(600)
    model = train_network(frame(spark, x, y), Training((12,), alpha=1e-3, solver=solver, learning_rate=rate, batches=2, epochs=40))
    assert model.losses[-1] < 0.5 * model.losses[0]
    fresh, truth = data(300, seed=5)
    got = {r.vec_id: r.score for r in with_probability(frame(spark, fresh, truth), model).collect()}
    assert np.mean([(got[k] > 0.5) == (truth[k] == 1) for k in range(300)]) > 0.9
    assert np.allclose([got[k] for k in range(300)], model.probability(fresh))


def test_the_penalty_shrinks_weights_and_training_stops(spark):
    x, y = data(200)
    free, tight = (train_network(frame(spark, x, y), Training((6,), alpha=a, learning_rate=0.05, batches=1, epochs=40)) for a in (0.0, 200.0))
    size = lambda m: np.abs(m.parameters[is_weight(m.sizes)]).sum()
    assert size(tight) < 0.2 * size(free)
    short = train_network(frame(spark, x, y), Training((6,), learning_rate=1e-9, batches=1, epochs=30, patience=3))
    assert len(short.losses) == 4


def test_nulls_constant_values_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, [0.0, 7.0], 1), (2, [1.0, 7.0], 0), (3, None, 1), (4, [0.2, 7.0], None), (5, [0.1, 7.0], 1), (6, [0.9, 7.0], 0)], "vec_id long, features array<double>, label int")
    model = train_network(odd, Training((4,), learning_rate=0.1, batches=3, epochs=30))
    got = {r.vec_id: r.score for r in with_probability(odd, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] is None and got[4] > 0.5
    with pytest.raises(ValueError):
        train_network(odd.limit(0))
