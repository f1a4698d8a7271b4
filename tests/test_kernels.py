"""Kernel machines and ε-insensitive regression against closed forms, plain minimisers and held-out rows."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from glossa.operators import kernels
from glossa.operators.kernels import Kernel


def rows_of(spark, x, y, kind="double"):
    return spark.createDataFrame([(i, [float(v) for v in a], b) for i, (a, b) in enumerate(zip(x, y, strict=True))], f"id long, features array<double>, label {kind}").repartition(3)


def test_kernels_by_definition():
    a, b = np.array([[1.0, 2.0]]), np.array([[0.5, -1.0], [3.0, 1.0]])
    assert np.allclose(Kernel("linear")(a, b), [[-1.5, 5.0]])
    assert np.allclose(Kernel("polynomial", 2.0, 2, 1.0)(a, b), [[4.0, 121.0]])
    assert np.allclose(Kernel("rbf", 0.5)(a, b), [[np.exp(-0.5 * 9.25), np.exp(-0.5 * 5)]])
    assert np.allclose(Kernel("sigmoid", 0.1, shift=0.2)(a, b), np.tanh([[0.05, 0.7]]))
    with pytest.raises(ValueError, match="no kernel"):
        Kernel("other")(a, b)


def test_landmarks_reproduce_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(20, 3))
    made = kernels.machine(rows_of(spark, x, [0.0] * 20), Kernel("rbf", 0.3), "id", 20)
    phi = made.features(x)[:, :-1]
    assert np.allclose(phi @ phi.T, made.kernel(x, x), atol=1e-6)


def test_linear_regression_within_its_margin(spark):
    """On an exact line and nearly no penalty, all errors end within the margin; with a margin of nothing, weights are the line's."""
    x = np.random.default_rng(2).normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 0.5
    rows = rows_of(spark, x, y.tolist())
    for margin, bound in ((0.0, 5e-3), (0.2, 0.205)):
        made = kernels.regression(rows, Kernel("linear"), "id", margin, 1e-7, rounds=30, settled=1e-6)
        got = kernels.predicted(rows, made).collect()
        assert max(abs(r.prediction - r.label) for r in got) <= bound
    # a tenth of wild labels don't move the line, as the loss grows linearly
    wild = y + np.where(np.arange(80) % 10 == 0, 50.0, 0.0)
    made = kernels.regression(rows_of(spark, x, wild.tolist()), Kernel("linear"), "id", 0.0, 1e-7, rounds=30, settled=1e-6)
    assert np.abs(made.features(x) @ made.weights[0] - y).max() < 0.05


def test_hinge_is_minimal_and_never_rises(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = np.where(x @ [1.0, 0.5] + 0.4 * rng.normal(size=60) > 0, 1, 0)
    rows, strength = rows_of(spark, x, y.tolist(), "int"), 0.05
    made, before = kernels.classifier(rows, Kernel("linear"), "id", strength, rounds=1), np.inf
    phi, sign = made.features(x), np.where(y == 1, 1.0, -1.0)
    cost = lambda w: np.maximum(0, 1 - sign * (phi @ w)).mean() + strength / 2 * (w[:-1] ** 2).sum()
    for rounds in (1, 4, 25):
        now = cost(kernels.classifier(rows, Kernel("linear"), "id", strength, rounds=rounds, settled=0).weights[1])
        assert now <= before + 1e-9
        before = now
    w, best = np.zeros(3), np.inf
    for t in range(1, 60_000):  # plain subgradients
        on = sign * (phi @ w) < 1
        w = w - (2 / (t + 50)) * (np.append(strength * w[:-1], 0) - (phi[on] * sign[on, None]).sum(0) / 60)
        best = min(best, cost(w))
    assert before <= best * 1.002


def test_rings_of_classes_and_odd_rows(spark):
    """Three rings, which no line parts; null and non-finite rows don't count, and have null predictions."""
    rng = np.random.default_rng(4)
    c = np.arange(300) % 3
    at = rng.uniform(0, 2 * np.pi, 300)
    x = (1 + c + rng.normal(0, 0.1, 300))[:, None] * np.column_stack([np.cos(at), np.sin(at)])
    rows = rows_of(spark, x, [f"ring {v}" for v in c], "string")
    odd = spark.createDataFrame([(900, None, "ring 0"), (901, [1.0, None], "ring 1"), (902, [float("nan"), 1.0], "ring 2"), (903, [1.0, 0.0], None)], rows.schema)
    held = rows.where("id % 5 = 0")
    made = kernels.classifier(rows.where("id % 5 > 0").union(odd), Kernel("rbf", 1.0), "id", landmarks=60, rounds=10)
    got = kernels.predicted(held.union(odd), made).collect()
    assert np.mean([r.label == r.prediction for r in got if r.id < 900]) > 0.95
    assert {r.id: r.prediction for r in got if r.id >= 900} == {900: None, 901: None, 902: None, 903: "ring 0"}
    again = kernels.from_rows(kernels.to_rows(spark, made))
    assert again.classes == made.classes and again.kernel == made.kernel and np.array_equal(again.weights, made.weights)
    assert sorted(map(str, kernels.predicted(held, again).collect())) == sorted(map(str, kernels.predicted(held, made).collect()))
    with pytest.raises(ValueError, match="no rows"):
        kernels.classifier(rows.limit(0), Kernel(), "id")
    with pytest.raises(PythonException, match="features need 2 places"):
        kernels.predicted(spark.createDataFrame([([1.0],)], "features array<double>"), made).collect()
