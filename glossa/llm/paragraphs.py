"""Near-duplicate paragraphs: MinHash banding, exact verification, and removal by connected classes.

Paragraphs are the lines of a text. Those of `least` words or more are taken, lower-cased, as sets of five-word shingles
(hashes of 32 bits of XXH64). BANDS bands of ROWS minima each are tuned for recall: of pairs at the threshold of 0.8, 99.5 % collide
in a band, above it nearly all. Colliding paragraphs are joined, and a link needs an exact Jaccard similarity of 0.8.
Where large groups of paragraphs meet that differ by more, a bitmap of each set goes first: bits in which two bitmaps
differ are never more than the elements in which the sets do, and a link allows a ninth of both sizes of these, so no link is lost.
Of each class that links join, the first occurrence, by doc_id and place, stays.

A set so small that one element more or less breaks a link (three shingles or fewer) links with equal sets only, so the hash of the set is its only key.
The query takes lines of any length from one word; functions take them from `least` words.

Paragraphs equal after lower-casing are one item throughout (by 64-bit hash), one row in all joins by keys, so copies never form pairs.
Only the keys that two items share are joined at all.
Defined results: null and empty texts and shorter paragraphs have no rows; a paragraph of fewer than five words, if `least` lets
it in, is one shingle; repeated rows count as further occurrences, and of rows equal in doc_id and place one stays for all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, drop, stored, table
from .linking import bitmap, classes, may_link, possible, shared, spanning

BANDS, ROWS = 10, 4
#: Bits of the bitmaps of sets up to BITS[0] / 4 elements, and of larger ones, which would fill so few.
BITS = (1024, 4096)
SHINGLE = 5
LEAST_WORDS = 25
THRESHOLD = 0.8
#: Rows (key, id) and paragraphs with a shared key up to which their hashes and places are broadcast, at 24 bytes each and some tens in the hash table, so that texts aren't shuffled.
BROADCAST_ASKED = 1_000_000
#: Hashes that a task remembers to give the set of a repeated paragraph once; beyond that it starts anew.
REMEMBERED = 500_000
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RANDOM.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles."""
    n = max(1, len(words) - SHINGLE + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.minimum.reduceat((every[:, None] * _A + _B) ^ (every[:, None] >> np.uint64(29)), starts, axis=0)
    mixed = (least.reshape(-1, BANDS, ROWS) * _MIX).sum(axis=2, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mixed.view(np.int64)


def paragraphs(text: str | None, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(line, start, end, lower-cased words) of each paragraph of `least` words or more; offsets in characters."""
    at = 0
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * least - 1 and len(words := line.lower().encode("utf-8", "surrogatepass").split()) >= least:
            yield i, at, at + len(line), words
        at += len(line) + 1


def item(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)], dtype=np.int32)), pa.array(np.concatenate(values)))


def with_paragraphs(docs: DataFrame, least: int = LEAST_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, para, start, end, n_words, id, bands) of the paragraphs of (doc_id, text); bands are empty where the task has given them before for the same id."""
    shape = docs.select("doc_id").schema
    for n in ("para", "start", "end", "n_words"):
        shape = shape.add(n, "integer")
    shape = shape.add("id", "long").add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = np.empty(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory
                part = b.slice(at, 256)
                rows, ids, sets, new, source = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for para, start, end, words in paragraphs(text, least):
                        id = item(words)
                        if id not in seen:
                            seen.add(id)
                            new.append(len(rows))
                            sets.append(shingles(words))
                        rows.append((para, start, end, len(words)))
                        ids.append(id)
                        source.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not rows:
                    continue
                numbers = np.array(rows, np.int32)
                bands = [none] * len(rows)
                if sets:
                    for j, s, keys in zip(new, sets, band_keys(sets), strict=True):
                        alone = len(s) < threshold * (len(s) + 1) - 1e-9
                        bands[j] = np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64) if alone else keys
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(source)), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(np.array(ids, np.uint64).view(np.int64)), _lists(bands)],
                    ["doc_id", "para", "start", "end", "n_words", "id", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def with_sets(texts: DataFrame) -> DataFrame:
    """(id, trait, s): the shingles, and their number and bitmap, of the paragraphs asked for in (text, asked), an array of (para, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):  # bounded memory
                part = b.slice(at, 128)
                ids, sets = [], [np.empty(0, np.int64)]
                for text, asked in zip(part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    for x in asked:
                        words = lines[x["para"]].lower().encode("utf-8", "surrogatepass").split() if x["para"] < len(lines) else []
                        if words and np.uint64(item(words)).view(np.int64) == x["id"]:  # another text of the same doc_id may have other lines
                            ids.append(x["id"])
                            sets.append(shingles(words).view(np.int64))
                bits = [bitmap(s.view(np.uint64), BITS[4 * len(s) > BITS[0]]) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets[1:]], pa.int64()), _lists(bits).slice(1), _lists(sets).slice(1)], ["id", "n", "bits", "s"])

    return texts.select("text", "asked").mapInArrow(run, "id long, n long, bits array<long>, s array<long>").dropDuplicates(["id"]).select("id", F.struct("bits", "n").alias("trait"), "s")


def duplicate_paragraphs(docs: DataFrame, least: int = LEAST_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, para, start, end, n_words, class_doc_id, class_para, kept) of every paragraph in a class of two or more."""
    found = stored(with_paragraphs(docs, least, threshold))
    given = found.where("size(bands) > 0")  # once for each id and task at least
    keyed = shared(given.select("id", F.explode("bands").alias("key"))).withColumn("home", F.lit(True))
    ids = keyed.select("id").distinct()
    ids = F.broadcast(ids) if keyed.count() <= BROADCAST_ASKED else ids
    sharing = cut(given.select("id", "doc_id", "para").join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "para")).alias("at")))
    asked = sharing.groupBy(F.col("at.doc_id").alias("_doc_id")).agg(F.collect_list(F.struct("at.para", "id")).alias("asked"))
    asked = F.broadcast(asked) if sharing.count() <= BROADCAST_ASKED else asked
    sets = stored(with_sets(docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_doc_id")))))
    traits, near = sets.select("id", "trait"), may_link(threshold, *BITS)

    def held(pairs: DataFrame) -> DataFrame:
        """Pairs of an exact Jaccard similarity of the threshold; their bitmaps go first."""
        pairs = possible(pairs, traits, near)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        shared_by = F.size(F.array_intersect("x", "y"))
        return both.where(shared_by >= threshold * (F.size("x") + F.size("y") - shared_by)).select("a", "b")

    joined = classes(keyed, lambda pairs: spanning(pairs, held), near, traits)
    items = found.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "para")).alias("first"))
    named = items.join(joined, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    size = named.groupBy("class").agg(F.sum("n").alias("members"), F.min("first").alias("class_first")).where("members > 1")
    inside = cut(named.join(size, "class").select("id", "class_first"))
    drop(keyed, sharing, sets)
    out = found.select("doc_id", "para", "start", "end", "n_words", "id").join(inside, "id")
    kept = F.struct("doc_id", "para") == F.col("class_first")
    return out.select("doc_id", "para", "start", "end", "n_words", F.col("class_first.doc_id").alias("class_doc_id"), F.col("class_first.para").alias("class_para"), kept.alias("kept"))


def remove_duplicate_paragraphs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs without the paragraphs that duplicate_paragraphs doesn't keep; doc_id must be unique."""
    gone = duplicate_paragraphs(docs, least).where("not kept").groupBy("doc_id").agg(F.collect_set("para").alias("gone"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # so no column's name can clash
    joined = whole.join(gone, F.col("doc.doc_id") == gone["doc_id"], "left")
    lines = F.filter(F.split("doc.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(lines, "\n"))
    return joined.select(*((text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns))


def op9_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(table(spark, sf_dir, "documents"), least=1)
