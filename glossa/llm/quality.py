"""Quality rules with risk-controlled thresholds.

Every document gets counts over its whole text. For each stratum (a language) and each rule, labelled
holdouts decide the cutoff: a cutoff is admitted only if an exact binomial (Clopper-Pearson) upper bound on the
share of good documents it rejects stays within the rule's part of `alpha`, at a confidence that is corrected
(Bonferroni) for every stratum, rule and cutoff tried. Of the admitted cutoffs, that with the largest gap between
rejected bad and rejected good documents is taken, ties to the mildest; without a gap the rule stays off.

Defined results: null or empty text has no words and so fails the base rule; a null stratum is a stratum of its own;
labels null, or for unknown documents, aren't used; a document labelled twice counts once, good only if all its labels are good;
a stratum with too few labels to prove anything has no rules but the base; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table

BLANK = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
WINDOW = 8

#: Features a rule may reject on, when above its cutoff, as SQL over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / n_words",
}
GRIDS = {
    "symbols_per_word": (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_word_share": (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.28),
    "upper_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "chars_per_word": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    rank = seq
    for step in (1, 2, 4):  # windows of 2, 4, 8 words, named exactly: equal numbers mean equal windows
        pairs = rank[:-step] * (len(words) + 1) + rank[step:]
        values, rank, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
    starts = np.flatnonzero(times[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS, over the whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANK),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(k for c, k in Counter(text).items() if c.isupper()),
    )


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with one column `_<count>` for each of COUNTS. text: a column, or a field of the first column."""
    names = docs.columns if keep is None else keep
    schema = docs.select(*names).schema
    for c in COUNTS:
        schema = schema.add(f"_{c}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounded memory
                part = b.slice(at, 512)
                texts = part.column(0).field(text.split(".")[1]) if "." in text else part.column(text)
                found = np.array([counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(found[:, i]) for i in range(len(COUNTS))], [*names, *(f"_{c}" for c in COUNTS)])

    return docs.select(*(names if "." in text else dict.fromkeys([*names, text]))).mapInArrow(run, schema)


def feature(name: str):
    sql = FEATURES[name]
    for c in COUNTS:
        sql = sql.replace(c, f"_{c}")
    return F.when(F.col("_n_words") > 0, F.expr(f"cast({sql} as double)"))


def base_failed():
    return (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p); exact sum over the terms that count."""
    if k >= n:
        return 0.0
    if p <= 0 or p >= 1:
        return 0.0 if p <= 0 else -math.inf
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k >= n * p:
        return 0.0 if k > n * p else math.log(0.5)  # far above any confidence in use
    top, total, i, t = term(k), 0.0, k, 1.0
    while i >= 0 and t > 1e-18:  # terms fall towards 0 below the mean
        total += t
        t *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return top + math.log(total)


def proven(rejected: int, n: int, limit: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound, at confidence 1 - delta, on the rejected share is within limit."""
    return n > 0 and rejected < n * limit and log_binomial_cdf(rejected, n, limit) <= math.log(delta)


def calibrate(labelled: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05, grids: dict = GRIDS) -> dict:
    """{stratum: {feature: cutoff}} from counted documents with a column _good (boolean).

    The driver gets one row per stratum that has enough labels for any proof, with two numbers a cutoff.
    """
    limit = alpha / len(grids)
    pairs = [(f, c) for f, grid in grids.items() for c in grid]
    good = F.col("_good")
    shapes = [F.count_if(good).alias("good"), F.count_if(~good).alias("bad")]
    for i, (f, c) in enumerate(pairs):
        over = F.coalesce(feature(f) > c, F.lit(False))
        shapes += [F.count_if(good & over).alias(f"g{i}"), F.count_if(~good & over).alias(f"b{i}")]
    least = math.log(delta / len(pairs)) / math.log1p(-limit)  # fewer good labels can prove nothing
    rows = labelled.where(~base_failed()).groupBy(F.col(stratum).alias("stratum")).agg(*shapes).where(F.col("good") >= least).collect()
    chosen: dict = {}
    for r in rows:
        rules = chosen.setdefault(r["stratum"], {})
        for f, grid in grids.items():
            best = (0.01, 0.0)
            for i, (g, c) in enumerate(pairs):
                if g == f and r["bad"] and proven(r[f"g{i}"], r["good"], limit, delta / (len(pairs) * len(rows))):
                    best = max(best, (round(r[f"b{i}"] / r["bad"] - r[f"g{i}"] / r["good"], 9), c))
            if best[1]:
                rules[f] = best[1]
    return chosen


def accepted(chosen: dict, stratum: str):
    """The verdict as a column: not base_failed, and over no cutoff of the stratum."""
    over = F.lit(False)
    for value, rules in chosen.items():
        for f, c in rules.items():
            over = over | (F.col(stratum).eqNullSafe(F.lit(value)) & F.coalesce(feature(f) > c, F.lit(False)))
    return ~base_failed() & ~over


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, _good): one row a document."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return usable.groupBy("doc_id").agg((F.min("quality") > 0).alias("_good"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = cut(with_counts(docs, keep=["doc_id", "lang"]))
    chosen = calibrate(counted.join(one_label(table(spark, sf_dir, "labels")), "doc_id"), "lang")
    names = [c for c in COUNTS if c not in ("n_lines", "n_upper")]
    return counted.select("doc_id", *(F.col(f"_{c}").alias(c) for c in names), base_failed().alias("base_failed"), accepted(chosen, "lang").alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "lang")  # so no column's name can clash
    counted = stored(with_counts(whole, "_doc.text"))  # with the texts, so that neither they are counted twice nor shuffled
    chosen = calibrate(counted.drop("_doc").join(one_label(table(spark, sf_dir, "labels")), "doc_id"), "lang")
    return counted.where(accepted(chosen, "lang")).select("_doc.*")
