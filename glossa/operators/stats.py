"""Counters, measures of agreement, feature statistics and folds, as aggregates that combine before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, proportion)."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("proportion", F.col("n") / rows.agg(F.count("*")).scalar())


def top_keys(counts: DataFrame, k: int, key: str) -> DataFrame:
    """The k largest counts, ties to the smaller key."""
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


def combine(left: DataFrame, right: DataFrame, key: str, how: str, default: float = 0.0) -> DataFrame:
    """Counters (key, n) added, subtracted, multiplied or divided over the union of their keys."""
    a, b = F.coalesce("x", F.lit(default)), F.coalesce("y", F.lit(default))
    value = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[how]
    both = left.select(key, F.col("n").cast("double").alias("x")).join(right.select(key, F.col("n").cast("double").alias("y")), key, "full_outer")
    return both.select(key, value.alias("n"))


def combined(left: DataFrame, right: DataFrame, key: str, default: float = 0.0) -> DataFrame:
    """(key, plus, minus, times, ratio) of counters (key, n), over the union of their keys, in one join."""
    a, b = F.coalesce("x", F.lit(default)), F.coalesce("y", F.lit(default))
    both = left.select(key, F.col("n").cast("double").alias("x")).join(right.select(key, F.col("n").cast("double").alias("y")), key, "full_outer")
    return both.select(key, (a + b).alias("plus"), (a - b).alias("minus"), (a * b).alias("times"), F.try_divide(a, b).alias("ratio"))


def dot_products(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(left, right, dot, cosine) of sparse vectors (id, key, n) that share a key."""
    norms = lambda df, i: df.groupBy(i).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = a.select(left, key, F.col("n").alias("x")).join(b.select(right, key, F.col("n").alias("y")), key).groupBy(left, right).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(norms(a, left).withColumnRenamed("norm", "p"), left).join(norms(b, right).withColumnRenamed("norm", "q"), right).select(left, right, "dot", (F.col("dot") / (F.col("p") * F.col("q"))).alias("cosine"))


def moments(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, n) for buckets closed on the right; every bucket has a row."""
    bucket = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col(value) <= b, F.lit(i)).otherwise(bucket)
    counts = rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(values: Column, gamma: float = 1.0) -> Column:
    scaled = F.transform(values, lambda x: x * gamma)
    return F.transform(scaled, lambda x: F.exp(x - log_sum_exp(scaled)))


def contingency(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, tn) of each label against the rest."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array_distinct(F.array(F.struct(F.col("g").alias("label"), F.lit(True).alias("gold")), F.struct(F.col("p").alias("label"), F.lit(False).alias("gold"))))).alias("s"), "g", "p", "n")
    by = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.gold") & (F.col("g") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("s.gold") & (F.col("g") != F.col("p")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("s.gold") & (F.col("g") != F.col("p")), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = rows.agg(F.count("*")).scalar()
    return by.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))


def scores(table: DataFrame) -> DataFrame:
    """(label, precision, recall, f1), zero where undefined."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return table.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def averages(table: DataFrame) -> DataFrame:
    """One row: micro and macro averages of precision and recall, and recall weighted by support."""
    s = table.select("*", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("r"))
    support = F.col("tp") + F.col("fn")
    return s.agg(
        F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp"))).alias("micro_precision"), F.try_divide(F.sum("tp"), F.sum(support)).alias("micro_recall"),
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.try_divide(F.sum(F.col("r") * support), F.sum(support)).alias("weighted_recall"),
    )


def information_gain(rows: DataFrame, feature: str, label: str) -> DataFrame:
    """(feature, gain) in nats of the presence of a feature; rows (id, label, feature), a row for each feature of an item."""
    items = rows.select("id", label).distinct()
    n = items.agg(F.count("*")).scalar()
    plogp = lambda x, m: F.when((x > 0) & (m > 0), -(x / m) * F.log(x / m)).otherwise(0.0)
    classes = items.groupBy(label).agg(F.count("*").alias("c"))
    base = classes.agg(F.sum(plogp(F.col("c"), n))).scalar()
    with_f = rows.select("id", label, feature).distinct().groupBy(feature, label).agg(F.count("*").alias("k"))
    joined = with_f.join(classes, label).withColumn("f", F.sum("k").over(Window.partitionBy(feature)))
    seen = joined.groupBy(feature).agg(
        F.first("f").alias("f"), F.sum(plogp(F.col("k"), F.col("f"))).alias("h1"), F.sum(plogp(F.col("c") - F.col("k"), n - F.col("f"))).alias("h0"),
        F.sum("c").alias("c"), F.sum(F.col("c") * F.log("c")).alias("clogc"),
    )
    # classes that never have the feature count wholly without it
    m, every = n - F.col("f"), classes.agg(F.sum(F.col("c") * F.log("c"))).scalar()
    rest = F.when((m > 0) & (F.col("c") < n), ((n - F.col("c")) * F.log(m) - (every - F.col("clogc"))) / m).otherwise(0.0)
    return seen.select(feature, (base - F.col("f") / n * F.col("h1") - m / n * (F.col("h0") + rest)).alias("gain"))


def scaled(rows: DataFrame, value: str, low: float = 0.0, high: float = 1.0, *keys: str) -> DataFrame:
    """rows with `scaled`: from low to high by the least and greatest value of the key; high where these are equal."""
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(bounds, list(keys))
    v = F.when(F.col("_lo") == F.col("_hi"), F.lit(high)).otherwise(low + (high - low) * (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return joined.withColumn("scaled", v).drop("_lo", "_hi")


def folds(rows: DataFrame, order: str, k: int, *keys: str) -> DataFrame:
    """rows with `fold`: contiguous folds by order within each key, the remainder in the last."""
    by = Window.partitionBy(*keys)
    at = F.row_number().over(by.orderBy(order)) - 1
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(by) / k))
    return rows.withColumn("fold", F.least(F.lit(k - 1), F.floor(at / size)).cast("int"))


def resampled(counts: np.ndarray, rounds: int, seed: tuple) -> np.ndarray:
    """For each round, how often each group comes up when as many rows as there are get drawn with replacement; counts: the groups' rows."""
    return np.random.default_rng(seed).multinomial(counts.sum(), counts / counts.sum(), size=rounds)


def bootstrap(rows: DataFrame, gold: str, a: str, b: str, rounds: int = 10_000, seed: int = 7, cells: int | None = None) -> DataFrame:
    """One row: the share of resamples, of as many rows as there are, in which system b doesn't beat system a."""
    gain = (F.col(b) == F.col(gold)).cast("double") - (F.col(a) == F.col(gold)).cast("double")
    return bootstrap_gains(rows.select(F.coalesce(gain, F.lit(0.0)).alias("gain")), rounds, seed, cells)


def bootstrap_gains(gains: DataFrame, rounds: int = 10_000, seed: int = 7, cells: int | None = None) -> DataFrame:
    """One row: p_value, the share of resamples of the rows in which `gain` doesn't sum to more than 0; 1.0 without rows.

    Rows of equal gain are drawn as one group, and groups are dealt to cells of some thousands: a resample is first dealt over the cells, by draws that all tasks repeat from the seed,
    and each task deals what came to its cell over its groups. That is the multinomial distribution itself, in two steps, so resamples are exact however many groups there are.
    """
    groups = gains.where("gain is not null").groupBy("gain").agg(F.count("*").alias("n"))
    if cells is None:
        cells = min(256, 1 + groups.count() // 4096)
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("gain"), F.lit(cells)).cast("int"))
    held = sorted((r["cell"], r["n"]) for r in groups.groupBy("cell").agg(F.sum("n").alias("n")).collect())  # a row a cell
    place = {cell: i for i, (cell, _) in enumerate(held)}
    totals = np.array([n for _, n in held], np.int64)

    def deal(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        group = group.sort_by("gain")
        each, n = group.column("gain").to_numpy(), group.column("n").to_numpy()
        share = resampled(totals, rounds, (seed, 0))[:, place[cell]]
        draw = np.random.default_rng((seed, 1, cell))
        sums = [draw.multinomial(share[i : i + 256], n / n.sum()) @ each for i in range(0, rounds, 256)]  # bounded memory
        return pa.table({"round": np.arange(rounds), "s": np.concatenate(sums)})

    sums = groups.groupBy("cell").applyInArrow(deal, "round long, s double").groupBy("round").agg(F.sum("s").alias("s"))
    return sums.agg((1 - F.count_if(F.col("s") > 1e-9) / F.lit(rounds)).alias("p_value"))


def bigrams(tokens: DataFrame, *keys: str, threshold: int = 0) -> DataFrame:
    """(first, second, n) of neighbouring words, for more than `threshold` occurrences."""
    after = F.lead("word").over(Window.partitionBy(*keys).orderBy("tok"))
    pairs = tokens.select(F.col("word").alias("first"), after.alias("second")).where("second is not null")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") > threshold)


def precision_at_1(rows: DataFrame, query: str, gold: str, score: str) -> DataFrame:
    """One row: how often the label of the best score is the best label of the query."""
    best = rows.groupBy(query).agg(F.max_by(gold, F.struct(score, gold)).alias("got"), F.max(gold).alias("want"))
    return best.agg(F.avg((F.col("got") == F.col("want")).cast("double")).alias("p_at_1"))


def interpolated(head: Column, label: Column, weight: float) -> Column:
    """Scores of two heads, softmaxed and mixed, with their places, best first: array<struct<score, place>>."""
    mixed = F.zip_with(softmax(head), softmax(label), lambda a, b: weight * a + (1 - weight) * b)
    placed = F.transform(mixed, lambda s, i: F.struct((-s).alias("s"), i.alias("place")))
    return F.transform(F.array_sort(placed), lambda x: F.struct((-x["s"]).alias("score"), x["place"].alias("place")))


def frequent(rows: DataFrame, feature: str, threshold: int, strict: bool = False) -> DataFrame:
    """(feature, n) of features in `threshold` items or more, or in more than that."""
    counts = rows.select("id", feature).distinct().groupBy(feature).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > threshold if strict else F.col("n") >= threshold)


def extremes(counts: DataFrame, key: str, *keys: str) -> DataFrame:
    """(keys, most, least): the keys of the greatest and the least count, ties to the smaller key."""
    rank = F.struct("n", key)
    return counts.groupBy(*keys).agg(F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias("most"), F.min_by(key, rank).alias("least"))


def accuracy(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.agg((100 * F.avg((F.col(gold) == F.col(predicted)).cast("double"))).alias("accuracy"))


def norms(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, l1, l2) of counters (keys, n): the plain sum of the values, and the root of the sum of their squares."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("l1"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l2"))


def equal_histogram(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(bucket, n) of n buckets of equal width between least and largest value, closed on the right; every bucket has a row."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).where("lo is not null")
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((F.col(value) - F.col("lo")) * n / (F.col("hi") - F.col("lo"))) - 1))
    bucket = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(at).cast("int")
    counts = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # one row
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def n_best(rows: DataFrame, n: int, score: str, *ties: str) -> DataFrame:
    """The n rows of the highest scores; each task keeps n at most."""
    return rows.orderBy(F.desc(score), *ties).limit(n)


def n_sampled(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows at random: those of the least hash of seed and key, whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def top_per_group(rows: DataFrame, n: int, group: str, score: str, *ties: str) -> DataFrame:
    """The n rows of the highest scores of each group, with rank from 1; each task keeps n of a group at most."""
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def micro_scores(gold: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """One row (precision, recall, f1) of exact matches of distinct rows, summed over all."""
    both = gold.select(*on).distinct().withColumn("_g", F.lit(1)).join(predicted.select(*on).distinct().withColumn("_p", F.lit(1)), on, "full_outer")
    sums = both.agg(F.count("_g").alias("g"), F.count("_p").alias("p"), F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("hit"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.select(share("hit", "p").alias("precision"), share("hit", "g").alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def indexed(rows: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """(group, key, index): a lexicon of the distinct keys of each group, numbered from 0 in the order they come first in.

    Keys taken out before are not counted, so that later ones move up.
    """
    first = rows.groupBy(group, key).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(group, key, (F.row_number().over(Window.partitionBy(group).orderBy("_at", key)) - 1).alias("index"))
