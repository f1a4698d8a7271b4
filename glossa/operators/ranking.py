"""Learning to rank: a linear scorer by pairwise hinge loss, without making pairs.

A pair of rows of one query, one labelled better than the other, is wrong by as much as the better one's score fails to exceed the worse one's by the margin. What a row adds to the gradient
is how many rows it makes such pairs with: worse rows that score more than its score less the margin, better rows that score less than its score plus the margin. Both
are running counts over the query's rows in order of score, one for each label, so a round takes n log n, not n^2, and no pair exists.
All counts go by query, so a round takes one shuffle of its rows, and no join. Each round sends the weights to the tasks, and brings their gradient and the loss back, a number a feature.

Defined results: rows without a label or a query are scored but not trained on; features that are null or missing count nothing; queries whose labels are all equal add nothing;
rows repeated as a whole count again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(rows: DataFrame, weights: dict[int, float], out: str = "score") -> DataFrame:
    """rows with the sum of their features: map<int, double>, weighted."""
    table = F.from_json(F.lit("{" + ",".join(f'"{k}":{v!r}' for k, v in weights.items()) + "}"), "map<string,double>")
    products = F.transform(F.map_entries("features"), lambda e: F.coalesce(e["value"] * F.element_at(table, e["key"].cast("string")), F.lit(0.0)))
    return rows.withColumn(out, F.coalesce(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def pair_counts(rows: DataFrame, levels: list[float], margin: float = 1.0) -> DataFrame:
    """rows (qid, label, score) with `pull`: the wrong pairs in which the row is the better one, less those in which it is the worse one, and `loss`, the hinge of the former."""
    below = Window.partitionBy("qid").orderBy(F.col("score") / margin).rangeBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("qid").orderBy((F.col("score") / margin).desc()).rangeBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("qid")
    of = lambda k, c: F.when(F.col("label") == levels[k], c)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # rows of a level that score score - margin or less, and those whose score plus the margin is at most the row's: both from counts that run upwards
    sums = {}
    for k in range(len(levels)):
        sums |= {f"_all{k}": zero(F.count(of(k, F.lit(1))).over(every)), f"_far{k}": zero(F.count(of(k, F.lit(1))).over(below)), f"_high{k}": zero(F.count(of(k, F.lit(1))).over(above))}
        sums |= {f"_sum{k}": zero(F.sum(of(k, F.col("score"))).over(every)), f"_fars{k}": zero(F.sum(of(k, F.col("score"))).over(below))}
    points = rows.withColumns(sums)
    worse, better, loss = F.lit(0), F.lit(0), F.lit(0.0)
    for k, level in enumerate(levels):
        # a worse row is in a wrong pair unless it scores score - margin or less; a better one unless it scores score + margin or more
        count, total = F.col(f"_all{k}") - F.col(f"_far{k}"), F.col(f"_sum{k}") - F.col(f"_fars{k}")
        worse = worse + F.when(F.col("label") > level, count).otherwise(0)
        loss = loss + F.when(F.col("label") > level, total - count * (F.col("score") - margin)).otherwise(0.0)
        better = better + F.when(F.col("label") < level, F.col(f"_all{k}") - F.col(f"_high{k}")).otherwise(0)
    return points.select(*rows.columns, (worse - better).alias("pull"), loss.alias("loss"))


def _pairs(rows: DataFrame) -> float:
    """How many pairs of rows of one query have different labels."""
    by = rows.groupBy("qid", "label").agg(F.count("*").cast("double").alias("n")).groupBy("qid").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return by.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0.0


def train(rows: DataFrame, rounds: int = 25, rate: float = 1.0, strength: float = 1e-3, margin: float = 1.0) -> dict[int, float]:
    """Weights by feature, of rows (qid, label, features: map<int, double>), by gradient steps of falling size on the mean hinge of the pairs; the best round's."""
    rows = rows.where("qid is not null and label is not null").select("qid", F.col("label").cast("double").alias("label"), "features")
    levels = sorted(r[0] for r in rows.select("label").distinct().collect())  # as many as there are kinds of labels
    pairs = _pairs(rows)
    weights: dict[int, float] = {r[0]: 0.0 for r in rows.select(F.explode(F.map_keys("features"))).distinct().collect()}  # a number a feature
    best, least, sums = dict(weights), float("inf"), {k: 0.0 for k in weights}
    for i in range(rounds if pairs else 0):
        held = pair_counts(scored(rows, weights), levels, margin)
        # one pass for both: each row adds its loss at its first feature, or at none
        each = held.select("pull", "loss", F.posexplode_outer(F.map_entries("features")).alias("i", "e"))
        got = each.groupBy(F.col("e.key").alias("k")).agg(F.sum(F.col("pull") * F.col("e.value")).alias("g"), F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("loss"))).alias("loss")).collect()
        grad = {r["k"]: r["g"] for r in got if r["k"] is not None}
        loss = sum(r["loss"] or 0.0 for r in got) / pairs
        if loss + strength / 2 * sum(w * w for w in weights.values()) < least:
            best, least = dict(weights), loss + strength / 2 * sum(w * w for w in weights.values())
        for k in weights:  # each feature by its own scale of gradients so far
            g = (grad.get(k) or 0.0) / pairs - strength * weights[k]
            sums[k] += g * g
            weights[k] += rate * g / (sums[k] ** 0.5 + 1e-12)
    return best


def ranked(rows: DataFrame, weights: dict[int, float], order: list[Column] | None = None) -> DataFrame:
    """rows with score and rank, from 1, within each query; ties by `order`."""
    by = Window.partitionBy("qid").orderBy(F.desc("score"), *(order or []))
    return scored(rows, weights).withColumn("rank", F.row_number().over(by))
