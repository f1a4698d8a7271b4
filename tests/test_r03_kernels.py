"""Training of kernel machines in several tasks, and of two classes at the price of one."""

import numpy as np
from pyspark.sql import functions as F

from glossa.operators import kernels
from glossa.operators.kernels import Kernel


def test_rows_of_one_task_are_trained_on_by_several(spark, monkeypatch):
    rows = spark.range(400).select("id", F.array(F.col("id") % 20 / 20, F.col("id") % 7 / 7).alias("features"), (F.col("id") % 20 < 8).cast("int").alias("label")).coalesce(1)
    parts, weights = [], []
    summed = kernels._summed

    def seen(held, made, margin):
        parts.append(held.select(F.spark_partition_id().alias("p")).distinct().count())
        weights.append(made.weights)
        return summed(held, made, margin)

    monkeypatch.setattr(kernels, "_summed", seen)
    made = kernels.classifier(rows, Kernel("rbf", 1.0), "id", landmarks=30, rounds=4, settled=0)
    assert min(parts) > 1
    assert {len(w) for w in weights} == {1, 2}  # the second of two classes isn't summed up, but is there
    assert np.allclose(made.weights[0], -made.weights[1], atol=1e-6)
    right = kernels.predicted(rows, made).where("label = prediction").count()
    assert right > 380


def test_letter_shares_are_those_of_the_lower_cased_text(spark):
    from glossa.queries_learned import LETTERS, letter_shares

    texts = {1: "abba é", 2: "", 3: "ßß Zz 😀 ñ", 4: "x" * 3000 + "y"}
    rows = spark.createDataFrame(list(texts.items()), "key long, text string").select("key", F.lower("text").alias("text"), F.lit("en").alias("label"))
    got = {r["key"]: list(r["features"]) for r in letter_shares(rows).collect()}
    assert got == {k: [t.lower().count(c) / max(1, len(t)) for c in LETTERS] for k, t in texts.items()}
