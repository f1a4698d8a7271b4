"""SimHash near-duplicates, found with deletion-variant signatures (raised bits on one side).

A text's fingerprint has 64 bits; bit j is set if over half of its shingles' hashes have it set.
Fingerprints link when they differ in `distance` bits at most. The 64 bits are cut into so few segments that, of
two linked fingerprints, one segment differs by at most one bit: floor(distance / segments) <= 1. The index holds
each segment as it is; the probes hold it as it is and with one bit raised, for each bit that isn't set. (Of two
segments that differ in one bit, one has it unset, so raising covers what deleting the bit on both sides would, with half of
the rows.) Equal keys are joined and each pair is verified on all 64 bits.

Equal fingerprints are one item throughout, so copies never form pairs. Defined results: null and empty texts, and
texts of blanks, have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one shingle;
rows with equal ids share the component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .linking import classes
from .similar import shingle_hashes, similar_documents


#: Documents to leave out up to which their ids are broadcast, so that the texts of the others aren't shuffled.
BROADCAST_GONE = 1_000_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    n, set_bits = 0, np.zeros(64, np.int64)
    for part in shingle_hashes(text, shingle):
        n += len(part)
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 4) -> DataFrame:
    """docs, or its columns `keep`, and _fp: the fingerprint as a signed long."""
    names = docs.columns if keep is None else keep
    schema = docs.select(*names).schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounded memory
                part = b.slice(at, 512)
                found = np.array([fingerprint(t, shingle) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found)], [*names, "_fp"])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def segment_keys(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(key, id, home) of distinct fingerprints `id`: keys at home in the index, and the probes with one bit raised."""
    n = max(1, (distance + 2) // 2)  # the fewest segments with floor(distance / n) <= 1
    bounds = [64 * i // n for i in range(n + 1)]
    made = []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        width = hi - lo
        value = f"(shiftrightunsigned(id, {lo}) & {(1 << width) - 1}L)"
        variants = ", ".join(f"if({value} & {1 << j}L = 0, {value} | {1 << j}L, null)" for j in range(width))
        made.append(f"transform(filter(array({variants}), x -> x is not null), x -> struct(x * {n} + {i} as key, false as home))")
        made.append(f"array(struct({value} * {n} + {i} as key, true as home))")
    return fps.select("id", F.explode(F.expr(f"concat({', '.join(made)})")).alias("v")).select("v.key", "id", "v.home")


def fingerprint_classes(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(id, component) for the fingerprints, column `id`, that link with another; component is one of the class."""

    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    # most keys are shared by accident, so that their number is the input's, and is never small enough to broadcast
    return classes(segment_keys(fps, distance), linked=near, broadcast_keys=-1)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, _fp, component_id): one row a document; component_id is the smallest id reachable."""
    marked = cut(with_fingerprint(docs, text, [doc_id], shingle))
    firsts = cut(marked.groupBy(F.col("_fp").alias("id")).agg(F.min(doc_id).alias("_first")))
    joined = fingerprint_classes(firsts.select("id"), distance)
    named = firsts.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    of = named.join(least, "component").select(F.col("id").alias("_fp"), "component_id")
    return marked.join(of, "_fp").select(doc_id, "_fp", "component_id")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that with the smallest doc_id; texts whose only content is blank form one class.

    Documents without an id have nothing to be told apart by, so they stay; rows repeated under one id stay or go together. A class is joined by links of an
    exact Jaccard similarity of 0.8 on five-word shingles, as few bits of a fingerprint neither cover nor prove it.
    """
    found = similar_documents(docs.select("doc_id", "text"))
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
