"""Repeated passages by a sparse suffix array.

Suffixes of texts, in words, are retained at minimisers only: positions whose hash of GRAM words is the least of WINDOW
neighbouring ones. The choice depends on the words alone, so any two copies of a passage of LENGTH words retain a suffix at the same
place within the first WINDOW words, and these suffixes agree in their first PREFIX = LENGTH - WINDOW + 1 words.

The array holds the retained suffixes, and is sorted by these words' hashes: its rows are dealt out by ranges of (hash, text, place), so that a passage that a third of
all documents share spreads over as many tasks as its rows need, and sorted within each. Each suffix is compared with the one before and the one after it; the first and
last rows of every range are compared across ranges. The suffixes that agree with a neighbour are extended to the left and to the right: the runs of LENGTH
words around them are sorted and compared with their neighbours in the same way, and runs found again, put together, are the passages at their full
length. (Extending a suffix against its two neighbours alone would lose matches, since the neighbour that goes on longest to the right needn't be the one that agrees to the left.)

So a word is reported exactly if it lies in a run of LENGTH words that occurs elsewhere, in another text or in the same one. Words are compared by two independent
hashes of 96 bits together, a rolling one of the words and one of their bytes. Words are lower-cased and parted by blanks. Equal texts are taken once; copies are repeated as a whole.

Defined results: null and empty texts, and those of fewer than LENGTH words, have no passages; rows repeated as a whole are copies of
each other; texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop, stored, table

LENGTH, WINDOW, GRAM = 50, 25, 8
PREFIX = LENGTH - WINDOW + 1
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Runs:
    """Hashes of runs of words of a text, each in constant time."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        self.n = n = len(words)
        if len(Runs.powers) < n + 1:
            size = 2 * n + 2
            Runs.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _P))), dtype=np.uint64)
            Runs.inverses = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _P_INVERSE))), dtype=np.uint64)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        self.bytes = b" ".join(words)
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(each * Runs.powers[:n], dtype=np.uint64)))

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * Runs.inverses[at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


    def checks(self, at: np.ndarray, length: int) -> np.ndarray:
        """32 more bits, of the words' bytes."""
        starts, view = np.where(at > 0, self.ends[at - 1] + 1, 0), memoryview(self.bytes)
        found = (xxhash.xxh32_intdigest(view[a:b]) for a, b in zip(starts.tolist(), self.ends[at + length - 1].tolist(), strict=True))
        return np.fromiter(found, np.uint32, len(at)).view(np.int32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def minimisers(runs: Runs) -> np.ndarray:
    """Retained positions that a whole prefix follows."""
    if runs.n < LENGTH:
        return np.empty(0, np.int64)
    grams = runs.hashes(np.arange(runs.n - GRAM + 1), GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return at[at + PREFIX <= runs.n]


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)], dtype=np.int32)), pa.array(np.concatenate([*arrays, np.empty(0, kind)]).astype(kind)))


PLACES = "at array<int>, keys array<long>, checks array<int>"


def _places(runs: list[Runs], at: list[np.ndarray], length: int) -> list[pa.ListArray]:
    return [
        _lists(at, np.int32),
        _lists([r.hashes(x, length).view(np.int64) for r, x in zip(runs, at, strict=True)], np.int64),
        _lists([r.checks(x, length) if len(x) else np.empty(0, np.int32) for r, x in zip(runs, at, strict=True)], np.int32),
    ]


def text_key() -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))


def with_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, at, keys, checks): the retained suffixes of each text, by place and hashes of their prefix."""
    shape = StructType([*docs.select("doc_id").schema.add("text_key", "binary").add("n_words", "long").fields, *StructType.fromDDL(PLACES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                runs = [Runs(words_of(text)) for text in part.column("text").to_pylist()]
                made = _places(runs, [minimisers(r) for r in runs], PREFIX)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([r.n for r in runs], pa.int64()), *made], [f.name for f in shape])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, shape)


def with_runs(texts: DataFrame) -> DataFrame:
    """(tid, at, keys, checks) of (tid, text, at): the runs of LENGTH words around the suffixes at `at`."""
    shape = StructType([*texts.select("tid").schema.fields, *StructType.fromDDL(PLACES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                runs, starts = [Runs(words_of(text)) for text in part.column("text").to_pylist()], []
                for r, at in zip(runs, part.column("at").to_pylist(), strict=True):
                    near = np.unique((np.array(at, np.int64)[:, None] - np.arange(WINDOW)).ravel())
                    starts.append(near[(near >= 0) & (near + LENGTH <= r.n)])
                yield pa.RecordBatch.from_arrays([part.column("tid"), *_places(runs, starts, LENGTH)], [f.name for f in shape])

    return texts.select("tid", "text", "at").mapInArrow(run, shape)


def repeated_places(places: DataFrame) -> DataFrame:
    """(tid, at): a row at least for each place of (tid, at, keys, checks) whose hashes another place has too."""
    shape = "tid long, at int, key long, check int, edge boolean"
    rows = places.select("tid", F.inline(F.arrays_zip("at", "keys", "checks"))).toDF("tid", "at", "key", "check")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tid", "at", "key", "check")
        batch = lambda cols, edge: pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), edge))], [*names, "edge"])
        last, same = None, False
        for b in batches:
            cols = [b.column(c).to_numpy() for c in names]
            if not b.num_rows:
                continue
            if last is None:
                yield batch([c[:1] for c in cols], True)
            else:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            agree = (cols[2][1:] == cols[2][:-1]) & (cols[3][1:] == cols[3][:-1])
            found = np.append(agree, False)
            found[1:] |= agree
            found[0] |= same
            yield batch([c[:-1][found[:-1]] for c in cols], False)
            last, same = [c[-1:].copy() for c in cols], bool(found[-1])
        if last is not None:
            yield batch(last, True)
            if same:
                yield batch(last, False)

    array = rows.repartitionByRange("key", "check", "tid", "at").sortWithinPartitions("key", "check", "tid", "at")
    found = stored(array.mapInArrow(run, shape))
    edges = found.where("edge").select("tid", "at", "key", "check").distinct()  # two rows a range
    over = edges.groupBy("key", "check").agg(F.count("*").alias("n")).where("n > 1")
    return found.where("not edge").select("tid", "at").union(edges.join(over, ["key", "check"]).select("tid", "at"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): the passages of (doc_id, text) that occur elsewhere too, end exclusive."""
    found = stored(with_suffixes(docs))
    arrays = [F.first(c).alias(c) for c in ("n_words", "at", "keys", "checks")]
    texts = found.where(f"n_words >= {LENGTH}").groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *arrays)
    texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()))
    asked = repeated_places(texts).groupBy("tid").agg(F.collect_set("at").alias("at"))
    asked = asked.join(texts.select("tid", F.col("text_key").alias("_key"), "first"), "tid")
    source = docs.select("doc_id", "text").withColumn("_key", text_key())
    chosen = source.join(asked, (source["doc_id"].eqNullSafe(asked["first"])) & (source["_key"] == asked["_key"])).select("tid", "text", "at")
    runs = stored(with_runs(chosen))
    again = cut(repeated_places(runs).groupBy("tid").agg(F.array_sort(F.collect_set("at")).alias("s")))
    drop(runs)
    # runs that touch or overlap are one passage
    begins = F.filter("s", lambda x, i: (i == 0) | (x > F.get("s", i - 1) + LENGTH))
    ends = F.transform(F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1) > x + LENGTH)), lambda x: x + LENGTH)
    spans = again.select("tid", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("spans"))
    copied = F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b")))
    of = texts.join(spans, "tid", "left").select("text_key", F.when(F.col("copies") > 1, copied).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    out = found.select("doc_id", "text_key").join(of, "text_key")
    return out.select("doc_id", F.inline("spans")).select("doc_id", F.col("a").alias("start_word"), F.col("b").alias("end_word"))


def op6_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumn("n_words", F.col("end_word") - F.col("start_word"))
