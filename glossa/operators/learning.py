"""Classifiers over sparse features: pyspark.ml where it has the algorithm, and perceptrons that average over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(rows: DataFrame, words: str, size: int = 1 << 14) -> DataFrame:
    """rows with `features`: counts of words hashed to a fixed number of places."""
    return HashingTF(numFeatures=size, inputCol=words, outputCol="features").transform(rows)


def _weighted(estimator, weight: str | None):
    return estimator.setWeightCol(weight) if weight else estimator


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with `weight`: all classes weigh the same together."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    share = n.join(F.broadcast(total)).select(F.col(label).alias("_label"), (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(share), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def logistic(rows: DataFrame, l1: bool = False, strength: float = 0.01, weight: str | None = None, bias: bool = True):
    """weight: a column of the rows' weights."""
    return _weighted(LogisticRegression(regParam=strength, elasticNetParam=float(l1), maxIter=30, fitIntercept=bias), weight).fit(rows)


def linear_svm(rows: DataFrame, strength: float = 0.01, weight: str | None = None, bias: bool = True):
    return _weighted(LinearSVC(regParam=strength, maxIter=30, fitIntercept=bias), weight).fit(rows)


def random_forest(rows: DataFrame, trees: int = 20, seed: int = 7):
    return RandomForestClassifier(numTrees=trees, subsamplingRate=0.66, featureSubsetStrategy="sqrt", seed=seed).fit(rows)


def perceptron(rows: DataFrame, size: int, epochs: int = 5, margin: float = 1.0, parts: int = 8) -> np.ndarray:
    """Weights, the last for the bias, of an averaged margin perceptron on (id, features: array<int> of places, label 0 or 1).

    Each partition trains on its rows, and the averages are averaged by rows; the driver gets one vector of weights a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for b in batches:
            xs += [np.array(x, np.int64) for x in b.column("features").to_pylist()]
            ys += b.column("label").to_pylist()
        w, total = np.zeros(size + 1), np.zeros(size + 1)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(xs)):
                y = 1.0 if ys[i] else -1.0
                if y * (w[xs[i]].sum() + w[-1]) < margin:
                    np.add.at(w, xs[i], y)
                    w[-1] += y
            total += w
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array([len(xs)]), pa.array([total / epochs], pa.list_(pa.float64()))], ["n", "w"])

    dealt = rows.select("id", "features", "label").repartition(parts, "id")
    found = dealt.mapInArrow(run, "n long, w array<double>").collect()
    return np.average([r["w"] for r in found], axis=0, weights=[r["n"] for r in found]) if found else np.zeros(size + 1)


def decide(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """rows with `prediction` by a perceptron's weights."""
    w = weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.array(w)
        for b in batches:
            got = [int(v[np.array(x, np.int64)].sum() + v[-1] > 0) for x in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], [*b.schema.names, "prediction"])

    return rows.mapInArrow(run, rows.select("*").schema.add("prediction", "integer"))


def vote(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, prediction): the most frequent prediction of an ensemble, ties to the smaller."""
    counts = predictions.groupBy(*keys, "prediction").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("prediction"))


def regression(rows: DataFrame, strength: float = 0.0):
    """Least squares of `label` on `features`; strength: of the L2 penalty."""
    return LinearRegression(regParam=strength, solver="normal" if not strength else "auto").fit(rows)


def bagged(rows: DataFrame, fit, rounds: int = 10, share: float = 0.66, seed: int = 7) -> list:
    """A model for each of `rounds` samples of the rows, drawn with replacement."""
    return [fit(rows.sample(withReplacement=True, fraction=share, seed=seed + i)) for i in range(rounds)]


def ensemble(rows: DataFrame, models: list, *keys: str) -> DataFrame:
    """(keys, prediction): the vote of several models."""
    out = models[0].transform(rows).select(*keys, "prediction")
    for m in models[1:]:
        out = out.union(m.transform(rows).select(*keys, "prediction"))
    return vote(out, *keys)


def cross_validated(rows: DataFrame, fit, folds: int, fold: str = "fold") -> DataFrame:
    """The rows with the `prediction` of a model that was fitted on the other folds."""
    out = None
    for i in range(folds):
        part = fit(rows.where(F.col(fold) != i)).transform(rows.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


def selected(gains: DataFrame, n: int, feature: str, gain: str = "gain") -> DataFrame:
    """The n features of the highest gain, ties to the smaller feature."""
    return gains.orderBy(F.desc(gain), feature).limit(n)


def fold_sums(rows: DataFrame, features: list[str], label: str, fold: str = "fold") -> dict:
    """By fold the sums of products of all pairs among (1, features, label): all that least squares need, in one pass. A fold's row has d (d + 1) / 2 numbers."""
    columns = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features), F.col(label).cast("double")]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.where(F.col(label).isNotNull()).groupBy(fold).agg(*(F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs))
    out = {}
    for r in sums.collect():  # a row a fold
        m = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r[fold]] = m
    return out


def _held_out_error(sums: dict, places: list[int], strength: float) -> float:
    """The mean squared error of least squares on some features, each fold by the fit on the others."""
    total = sum(sums.values())
    error, n = 0.0, 0.0
    at = [0, *places]
    for m in sums.values():
        rest = total - m
        a = rest[np.ix_(at, at)] + strength * np.eye(len(at))
        b = np.linalg.solve(a, rest[at, -1])
        error += m[-1, -1] - 2 * b @ m[at, -1] + b @ m[np.ix_(at, at)] @ b
        n += m[0, 0]
    return error / n


def forward_selection(sums: dict, features: list[str], groups: dict[str, list[str]], strength: float = 1e-6) -> list[tuple[str, float]]:
    """(group, error) in the order in which groups of features are taken: each time the one that lowers the held-out error most, until none does; ties to the first by name.

    All candidates of all steps are scored from fold_sums(), so the rows are read once.
    """
    place = {c: i + 1 for i, c in enumerate(features)}
    taken: list[int] = []
    out: list[tuple[str, float]] = []
    best = float("inf")
    while True:
        scores = [(_held_out_error(sums, [*taken, *(place[c] for c in groups[g] if place[c] not in taken)], strength), g) for g in sorted(groups) if g not in {x for x, _ in out}]
        if not scores or min(scores)[0] >= best:
            return out
        best, group = min(scores)
        taken += [place[c] for c in groups[group] if place[c] not in taken]
        out.append((group, best))
