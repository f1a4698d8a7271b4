"""Exact top-k inner products with vector-approximation files.

Vectors are integers. Queries and candidates are dealt out on a grid, so that each query meets each candidate in one
cell of the grid. In a cell, candidates pass in blocks. A block's approximation holds each component as one of 2^bits cells between
the block's least and largest value; scanning it bounds every score from both sides. The exact vectors are then read in the order
of their upper bounds, and reading stops when the kth score found exceeds the next bound. The best k of
each cell of the grid meet in a last ranking, k rows a cell.

Defined results: vectors that are null or hold nulls, NaN or infinities, and rows without an id, take no part; vectors of another length are
not compared; ties go to the smaller id; rows repeated as a whole count once; empty vectors score 0; an empty table gives an empty result.
Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows at most of queries and of candidates in a cell of the grid; these bound a task's memory.
QUERY_ROWS, CANDIDATE_ROWS = 4096, 262_144


class Best:
    """A query's k best so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: list[Best], bits: int = 6, step: int = 64) -> int:
    """Brings `best` up to date with a block; returns how many exact vectors were read."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    width = np.maximum((high - low).astype(np.float64) / (1 << bits), 1e-9)
    cells = np.minimum(((vectors - low) / width).astype(np.uint8), (1 << bits) - 1)
    exact = queries.astype(np.float64)
    middle = exact @ (low + (cells + 0.5) * width).T
    slack = np.abs(exact) @ (width / 2)
    slack += 1e-6 * (np.abs(exact) @ np.maximum(np.abs(low), np.abs(high)).astype(np.float64)) + 1e-3  # rounding
    k, read = best[0].k, 0
    for i, b in enumerate(best):
        own = ids == query_ids[i]
        upper, lower = middle[i] + slack[i], middle[i] - slack[i]
        upper[own] = lower[own] = -np.inf
        least = max(b.least, np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf)
        open_ = np.flatnonzero((upper >= least) & ~own)
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        for at in range(0, len(open_), step):
            if upper[open_[at]] < b.least:
                break  # the kth is certain
            part = open_[at : at + step]
            b.add(ids[part], vectors[part] @ queries[i])
            read += len(part)
    return read


def top_k(queries: DataFrame, vectors: DataFrame, k: int, bits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs are (vec_id long, v array<long>), without nulls."""
    n_queries, n_vectors = queries.count(), vectors.count()
    q_groups = -(-n_queries // min(QUERY_ROWS, max(256, n_queries // 2))) or 1
    v_groups = -(-n_vectors // min(CANDIDATE_ROWS, max(512, n_vectors // 48))) or 1
    q = F.pmod(F.xxhash64("vec_id"), F.lit(q_groups)).cast("int")
    v = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(v_groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(q.alias("q"), every(v_groups).alias("c"), F.lit(0).alias("kind"), F.size("v").alias("d"), "vec_id", "v")
    right = vectors.select(every(q_groups).alias("q"), v.alias("c"), F.lit(1).alias("kind"), F.size("v").alias("d"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by cell of the grid and length, queries first."""
        now, held_ids, held, best = None, [], [], []
        matrix = ids = np.empty(0)

        def done() -> pa.RecordBatch:
            sizes = [len(b.ids) for b in best]
            cat = lambda xs: np.concatenate([*xs, np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes).astype(np.int64)), pa.array(cat(b.ids for b in best)), pa.array(cat(b.scores for b in best))], ["query_id", "vec_id", "score"])

        for batch in batches:
            q, c, kind, d = (batch.column(n).to_numpy() for n in ("q", "c", "kind", "d"))
            vec_ids, flat = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(d)))
            edges = np.flatnonzero((np.diff(q) != 0) | (np.diff(c) != 0) | (np.diff(kind) != 0) | (np.diff(d) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(q)], strict=True):
                key, rows = (q[a], c[a], d[a]), flat[ends[a] : ends[b]].reshape(b - a, d[a])
                if key != now:
                    if best:
                        yield done()
                    now, held_ids, held, best = key, [], [], []
                if kind[a] == 0:
                    held_ids.append(vec_ids[a:b])
                    held.append(rows)
                elif held:
                    if not best:
                        ids, matrix = np.concatenate(held_ids), np.concatenate(held)
                        best = [Best(k) for _ in ids]
                    for at in range(0, b - a, 4096):
                        scan(matrix, ids, rows[at : at + 4096], vec_ids[a:b][at : at + 4096], best, bits)
        if best:
            yield done()

    dealt = left.union(right).repartition(F.col("q"), F.col("c")).sortWithinPartitions("q", "c", "d", "kind")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for the vectors that take part."""
    fit = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fit).select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v")).distinct()


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(integer_vectors(table(spark, sf_dir, "embeddings")))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP3_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
