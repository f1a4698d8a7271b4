"""Kernel machines and ε-insensitive regression.

A kernel is stood for by Nyström features: its values against a bounded number of landmark rows, turned so that their inner products are the kernel's on the
landmarks. The hinge and the ε-insensitive loss are then minimised by majorisation: each round puts a quadratic over each row's loss that touches it at
the row's present value, sums the quadratics over all rows, in partial sums by partition, and solves for the weights. No round raises the objective,
which is the mean loss plus strength / 2 times the squared weights, the bias left out. Features and labels are written to the shared folder once, where the rounds read them.

`features` is an array<double> of one length, `label` a class or a number. Rows with a null or non-finite feature, or a null label, take no part in learning; predictions
for such features are null. A table without rows to learn from is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glossa.plans.lineage import delete, spread, written

#: The least distance from a loss's kink at which its quadratic is put, which bounds the quadratic's curvature.
NEAR = 1e-4


@dataclass(frozen=True)
class Kernel:
    """'linear', 'polynomial' (gamma xy + shift)^degree, 'rbf' exp(-gamma |x - y|²) or 'sigmoid' tanh(gamma xy + shift)."""

    kind: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    shift: float = 0.0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = a @ b.T
        if self.kind == "linear":
            return dot
        if self.kind == "polynomial":
            return (self.gamma * dot + self.shift) ** self.degree
        if self.kind == "rbf":
            return np.exp(-self.gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * dot, 0))
        if self.kind == "sigmoid":
            return np.tanh(self.gamma * dot + self.shift)
        raise ValueError(f"no kernel {self.kind}")


@dataclass(frozen=True)
class Machine:
    """classes: empty for a regression. weights: a row a class, or one row; the last place is the bias."""

    kernel: Kernel
    landmarks: np.ndarray
    basis: np.ndarray
    classes: tuple = ()
    weights: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.kernel(x, self.landmarks) @ self.basis, np.ones((len(x), 1))])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of arrays of finite numbers, and which these are."""
    there = column.is_valid()
    whole = column.filter(there)
    if pc.any(pc.not_equal(pc.list_value_length(whole), width)).as_py():
        raise ValueError(f"features need {width} places")
    x = whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(x).all(1)
    good = there.to_numpy(zero_copy_only=False).copy()
    good[good] = finite
    return x[finite], good


def machine(rows: DataFrame, kernel: Kernel, key: str, landmarks: int = 128) -> Machine:
    """A machine without weights. Its landmarks are the rows with the smallest hashes of `key`; their number is the bound of what the driver and each task hold of the table."""
    usable = F.expr("features is not null and forall(features, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    found = rows.where(usable).select("features", F.xxhash64(key).alias("h")).orderBy("h", "features").limit(landmarks).collect()
    if not found:
        raise ValueError("no rows to learn from")
    marks = np.unique(np.array([r["features"] for r in found], float), axis=0)
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    kept = values > 1e-10 * max(values.max(), 1e-300)  # kernels that aren't positive lose their negative part
    if not kept.any():
        raise ValueError("the kernel is zero on all landmarks")
    return Machine(kernel, marks, vectors[:, kept] / np.sqrt(values[kept]))


def _touching(slack: np.ndarray) -> np.ndarray:
    """The curvature of the quadratic that touches max(0, slack) at the slack."""
    return 0.5 / np.maximum(np.abs(slack), NEAR)


def _summed(rows: DataFrame, made: Machine, margin: float | None) -> tuple[int, np.ndarray]:
    """The number of rows, and for each row of weights the matrix and right side of the next round's equations."""
    classes, weights, width = list(made.classes), made.weights, made.landmarks.shape[1]
    if len(classes) == 2 and margin is None:  # the second of two classes is the first one's mirror, in every round
        n, sums = _summed(rows, replace(made, classes=made.classes[:1], weights=weights[:1]), margin)
        return n, np.concatenate([sums, sums * np.where(np.arange(sums.shape[2]) < sums.shape[1], 1.0, -1.0)])
    size = weights.shape[1]
    shape = (len(weights), size, size + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(shape)
        for b in batches:
            x, good = _matrix(b.column("features"), width)
            labels = [y for y, g in zip(b.column("label").to_pylist(), good, strict=True) if g]
            there = np.array([y is not None for y in labels], bool)
            x, labels = x[there], [y for y in labels if y is not None]
            phi = made.features(x)
            values = phi @ weights.T
            n += len(x)
            for j in range(len(weights)):
                if margin is None:
                    y = np.where(np.array([v == classes[j] for v in labels], bool), 1.0, -1.0)
                    curve = _touching(1 - y * values[:, j])
                    side = y * (0.5 + curve)
                else:
                    y = np.array(labels, float)
                    over, under = _touching(values[:, j] - y - margin), _touching(y - values[:, j] - margin)
                    curve, side = over + under, over * (y + margin) + under * (y - margin)
                half = phi * np.sqrt(curve)[:, None]
                total[j, :, :-1] += half.T @ half  # a matrix by itself: numpy makes one half of the product, and mirrors it
                total[j, :, -1] += phi.T @ side
        yield batch(TaskContext.get().partitionId(), n, total)

    def batch(part: int, n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([total.tobytes()])], ["part", "n", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(shape)
        for b in batches:
            n += sum(b.column("n").to_pylist())
            for one in b.column("sums"):
                total += np.frombuffer(one.as_py()).reshape(shape)
        if n:
            yield batch(0, n, total)

    # adaptive execution makes as many tasks of the shuffle as the partial sums' bytes need; the driver gets a sum of each
    form = "part long, n long, sums binary"
    partials = rows.select("features", "label").mapInArrow(partial, form).where("n > 0")
    found = partials.repartition("part").mapInArrow(added, form).collect()
    return sum(r["n"] for r in found), sum((np.frombuffer(r["sums"]).reshape(shape) for r in found), np.zeros(shape))


def _fitted(rows: DataFrame, made: Machine, strength: float, margin: float | None, rounds: int, settled: float) -> Machine:
    size = made.basis.shape[1] + 1
    made = replace(made, weights=np.zeros((max(1, len(made.classes)), size)))
    shrink = np.diag([strength] * (size - 1) + [1e-12])
    held = written(spread(rows.select("features", "label")))  # in many files, as few small ones would be few tasks in every round
    try:
        for _ in range(rounds):
            n, sums = _summed(held, made, margin)
            if not n:
                raise ValueError("no rows to learn from")
            new = np.array([np.linalg.lstsq(x[:, :-1] / n + shrink, x[:, -1] / n, rcond=None)[0] for x in sums])
            moved = np.abs(new - made.weights).max() / max(np.abs(new).max(), 1e-300)
            made = replace(made, weights=new)
            if moved < settled:
                break
    finally:
        delete(held)
    return made


def classifier(rows: DataFrame, kernel: Kernel, key: str, strength: float = 1e-3, landmarks: int = 128, rounds: int = 15, settled: float = 1e-3) -> Machine:
    """A support vector machine for each class against the others, by the hinge loss, all of them in the same passes."""
    classes = tuple(sorted(r[0] for r in rows.where("label is not null").select("label").distinct().collect()))  # a row a class
    if not classes:
        raise ValueError("no rows to learn from")
    return _fitted(rows, replace(machine(rows, kernel, key, landmarks), classes=classes), strength, None, rounds, settled)


def regression(rows: DataFrame, kernel: Kernel, key: str, margin: float = 0.1, strength: float = 1e-3, landmarks: int = 128, rounds: int = 15, settled: float = 1e-3) -> Machine:
    """A regression whose loss is what an error has beyond the margin."""
    return _fitted(rows, machine(rows, kernel, key, landmarks), strength, margin, rounds, settled)


def predicted(rows: DataFrame, made: Machine) -> DataFrame:
    """rows with `prediction`, in place of a column of that name: the class of the highest value, ties to the smaller class, or the regression's value."""
    kept = rows.drop("prediction")
    of = rows.schema["label"].dataType if made.classes and "label" in rows.columns else None
    kind = T.DoubleType() if not made.classes else of or (T.StringType() if isinstance(made.classes[0], str) else T.DoubleType() if isinstance(made.classes[0], float) else T.LongType())
    width, to = made.landmarks.shape[1], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = _matrix(b.column("features"), width)
            values = made.features(x) @ made.weights.T
            found = iter([made.classes[i] for i in values.argmax(1)] if made.classes else values[:, 0].tolist())
            got = [next(found) if g else None for g in good]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, to)], [*b.schema.names, "prediction"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("prediction", kind)]))


def to_rows(spark, made: Machine) -> DataFrame:
    """The machine as a table, for files of any format: (part, place, name, values)."""
    k = made.kernel
    rows = [("kernel", 0, k.kind, [float(k.gamma), float(k.degree), float(k.shift)])]
    rows += [("class", i, str(c), [float(not isinstance(c, str)), float(isinstance(c, float))]) for i, c in enumerate(made.classes)]
    for part, m in (("landmark", made.landmarks), ("basis", made.basis), ("weights", made.weights)):
        rows += [(part, i, None, r.tolist()) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "part string, place int, name string, values array<double>")


def from_rows(table: DataFrame) -> Machine:
    """The machine of to_rows(); a row a landmark and class."""
    found = sorted(table.collect(), key=lambda r: (r["part"], r["place"]))
    of = lambda part: [r for r in found if r["part"] == part]
    matrix = lambda part: np.array([r["values"] for r in of(part)], float)
    (k,) = of("kernel")
    gamma, degree, shift = k["values"]
    typed = lambda r: (float if r["values"][1] else int)(r["name"]) if r["values"][0] else r["name"]
    return Machine(Kernel(k["name"], gamma, int(degree), shift), matrix("landmark"), matrix("basis"), tuple(map(typed, of("class"))), matrix("weights"))
