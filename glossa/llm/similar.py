"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

A text is the set of the 64-bit hashes of its shingles. Sets at a similarity of t share t of the elements of each at least, so that in any order of all elements the first
(1 - t) n + 1 of a set of n hold one that is among those of the other set, too: these prefixes find all candidates. The order is that of the hashes, but elements that
many prefixes hold come last, so that passages common to many texts make few candidates. Bitmaps of the sets, by a bound that no link breaks, leave out most others. A link needs the exact similarity; the sets
are made anew for the documents asked for, so that neither texts nor sets of the others are kept or shuffled.

Texts of equal sets are one item throughout (by 64-bit hash), so copies never form pairs. Defined results: null and empty texts, and
texts of blanks, are one item; a text of fewer words than a shingle is one shingle; rows with equal ids share the component only
if their texts do; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, drop
from .linking import bitmap, classes, may_link, possible, shared, spanning

SEED = 42
BITS = 1024
THRESHOLD = 0.8
#: Documents to verify up to which their ids are broadcast, so that the texts of the others aren't shuffled.
BROADCAST_ASKED = 200_000
#: Prefixes that hold an element from which on it comes last in the order, and the most elements to move at once; both bear on time alone.
COMMON, MOST_COMMON = 100, 200_000
#: Times that common elements are looked for, as others come into the prefixes in their place.
ORDERS = 3


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in parts of bounded size, however long the text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and blanks are \x20\x09-\x0d
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    for at in range(0, n, 65536):
        yield np.fromiter((h(view[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)), np.uint64, min(n - at, 65536))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def item(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def prefix(s: np.ndarray, threshold: float, common: np.ndarray) -> np.ndarray:
    """As many of a set's first elements as hold one of each set at the threshold's similarity; common ones, which are given sorted, come last."""
    if not len(s):
        return s
    if len(common):
        late = np.isin(s, common)
        s = np.concatenate((s[~late], s[late]))
    return s[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]


def _with(docs: DataFrame, text: str, keep: list[str], shingle: int, columns: dict) -> DataFrame:
    """The columns `keep` of docs, id, n, the size of the text's set, and columns of the longs that functions of the set give."""
    schema = docs.select(*keep).schema.add("id", "long").add("n", "long")
    for c in columns:
        schema = schema.add(c, ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):  # bounded memory
                part = b.slice(at, 128)
                sets = [shingle_set(t, shingle) for t in part.column(text).to_pylist()]
                made = [pa.array([item(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                for of in columns.values():
                    lists = [of(s).view(np.int64) for s in sets]
                    made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32)), pa.array(np.concatenate(lists))))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made], [*keep, "id", "n", *columns])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _ordered(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], threshold: float, shingle: int) -> DataFrame:
    """The rows (key, id) of prefixes that share their key, by an order in which common elements come last. items: (id, keys) by the order of the hashes.

    An item without a common element in its prefix has the same prefix in the new order, so only the texts of the others are read again.
    """
    keyed = shared(items.select("id", F.explode("keys").alias("key")))
    common, spark = np.empty(0, np.int64), items.sparkSession
    for _ in range(ORDERS):
        found = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()["key"].to_numpy()
        found = np.setdiff1d(found, common)
        if not len(found):
            break
        common = np.union1d(common, found)
        new, late = spark.createDataFrame(pa.table({"key": found})), spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
        asked = cut(keyed.join(F.broadcast(new), "key", "left_semi").select("id").distinct())
        again = _with(texts_of(asked), "_text", ["_asked"], shingle, {"keys": lambda s, late=late: prefix(s, threshold, late.value)}).where("id = _asked")
        items = cut(items.join(asked, "id", "left_anti").select("id", "keys").union(again.dropDuplicates(["id"]).select("id", "keys")))
        drop(keyed, asked)
        keyed = shared(items.select("id", F.explode("keys").alias("key")))
    return keyed


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): one row a document with an id; component_id is the smallest id that links reach."""
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_doc_id"), F.col(text).alias("_text"))
    none = np.empty(0, np.uint64)
    marked = cut(_with(docs, "_text", ["_doc_id"], shingle, {"keys": lambda s: prefix(s, threshold, none), "bits": lambda s: bitmap(s, BITS)}))
    firsts = cut(marked.groupBy("id").agg(F.min("_doc_id").alias("_first")))

    def texts_of(asked: DataFrame) -> DataFrame:
        """(_asked, _text) of the items asked for: an id may have several texts."""
        asked = cut(firsts.join(asked, "id").select(F.col("id").alias("_asked"), "_first"))
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ASKED else asked
        return docs.join(asked, F.col("_doc_id") == F.col("_first")).select("_asked", "_text")

    items = marked.join(firsts.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("_doc_id") == F.col("_first")))
    keyed = _ordered(items.select("id", "keys"), texts_of, threshold, shingle).withColumn("home", F.lit(True))
    traits = cut(items.join(keyed.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first(F.struct("bits", "n")).alias("trait")))

    near = may_link(threshold, BITS)

    def held(pairs: DataFrame) -> DataFrame:
        """Pairs of an exact Jaccard similarity of the threshold."""
        pairs = possible(pairs, traits, near)
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = _with(texts_of(asked), "_text", ["_asked"], shingle, {"s": lambda s: s}).where("id = _asked")
        sets = cut(sets.dropDuplicates(["id"]).select("id", "s"))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= threshold * (F.size("x") + F.size("y") - shared)).select("a", "b")

    joined = classes(keyed, lambda pairs: spanning(pairs, held), near, traits)
    named = firsts.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    of = cut(named.join(least, "component").select("id", "component_id"))
    drop(keyed, traits, firsts)
    return marked.select("_doc_id", "id").join(of, "id").select(F.col("_doc_id").alias(doc_id), "component_id")
