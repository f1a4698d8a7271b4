"""Benchmark passages in documents, by Wu-Manber search for many patterns at once.

The patterns are windows: runs of `window` words of an item, or a whole item of fewer words. Their distinct ones are cut into blocks of bounded size,
each a Parquet file in the shared folder. A task takes its documents in portions of bounded size and goes through the blocks for each, so neither the
benchmark nor a table of it is ever whole in one place, and nothing is shuffled but the windows themselves.

A block's patterns of one length make a table of their own, so that short items don't shorten the skips of long ones. Patterns are searched by
their last two words (one, where a pattern has no more): the shift table tells how far the next place is at which any pattern could end, and mostly all of a pattern's length but
one is skipped; where it tells nothing can be skipped, the bucket of these two words holds the patterns that end so, and each is compared word by word with the text.

Words are runs of digits, letters a to z after A to Z were lower-cased, and all characters beyond ASCII.

Defined results: a null, empty or wordless text has no words and no hits; a null, empty or wordless item has no windows; an item
without an id makes the words it occurs in hits, but isn't listed or counted; items repeated under one id are one item, and items of equal texts are
each listed; repeated documents are repeated rows; texts of any length are taken whole, in pieces that overlap by a window; empty tables give no hits and no rows;
further columns stay out unless they are named in `keep`, which may have any names, as they travel in a struct.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import portions, shared_dir, stored, table
from .warc import open_fs

#: What parts words, as SQL and the JVM's regular expressions write it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for bytes of UTF-8: lower case, and a blank for all that parts words.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of patterns in a block, which takes some 100 MB in a task at most.
BLOCK_WORDS = 1_000_000
#: Bytes of texts that a task holds while it goes through the blocks, and of a piece of a long text.
PORTION_BYTES, PIECE_BYTES = 32 << 20, 4 << 20


def windows(items: DataFrame, window: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): each distinct window, space-joined, and the sorted distinct ids, as strings, of the items that have it."""
    words = items.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), 0).alias("w")).where("size(w) > 0")
    each = words.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> array_join(slice(w, i, {window}), ' '))")).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def write_blocks(spark: SparkSession, found: DataFrame, folder: str, block_words: int = BLOCK_WORDS) -> list[str]:
    """Writes windows to files of at most about block_words words each; returns their paths."""
    found = stored(found)
    blocks = max(1, -(-(found.agg(F.sum(F.size(F.split("words", " ")) + F.size("items"))).first()[0] or 0) // block_words))
    found.repartition(int(blocks), "words").write.parquet(folder)
    return sorted(r[0] for r in spark.read.parquet(folder).select(F.input_file_name()).distinct().collect())


class Patterns:
    """Shift tables and buckets of a block, by the length of patterns."""

    def __init__(self, path: str):
        store, at = open_fs(path)
        with store.open_input_file(at) as f:
            block = pq.read_table(f)
        lists: dict[tuple, tuple] = {}
        by_length: dict[int, dict[tuple, tuple]] = defaultdict(dict)
        intern: dict[bytes, bytes] = {}
        for words, items in zip(block.column("words").to_pylist(), block.column("items").to_pylist(), strict=True):
            of = tuple(items)
            p = tuple(intern.setdefault(w, w) for w in words.encode("utf-8", "surrogatepass").split(b" "))
            by_length[len(p)][p] = lists.setdefault(of, of)  # windows of the same items share a list
        self.tables = []
        for m, patterns in sorted(by_length.items()):
            size = min(2, m)
            shift: dict = {}
            buckets: dict = defaultdict(list)
            for p, of in patterns.items():
                for end in range(size, m + 1):
                    key = p[end - size : end] if size > 1 else p[0]
                    if m - end < shift.get(key, m):
                        shift[key] = m - end
                buckets[key].append((p, of))
            self.tables.append((m, size, shift, dict(buckets)))

    def search(self, words: list[bytes], hits: list[tuple[int, int]], lists: dict[int, tuple], first: int = 0) -> None:
        """Adds each occurrence (start, end) in words, counted from `first`, to hits, and the list of its items to lists."""
        n = len(words)
        for m, size, shift, buckets in self.tables:
            far, at = m - size + 1, m
            skip = shift.get
            while at <= n:  # `at` is where a pattern would end
                block = (words[at - 2], words[at - 1]) if size > 1 else words[at - 1]
                step = skip(block, far)
                if step:
                    at += step
                    continue
                here = tuple(words[at - m : at])
                for p, of in buckets[block]:
                    if p == here:
                        hits.append((first + at - m, first + at))
                        lists[id(of)] = of
                        break  # the patterns of a block are distinct
                at += 1


@lru_cache(maxsize=2)
def patterns(path: str) -> Patterns:
    """A worker keeps what it has built of the last blocks, so one block is built once for all its tasks."""
    return Patterns(path)


def pieces(text: bytes, overlap: int, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(place of the first word, how many words are new, words) of pieces of a text, each led by the last `overlap` words before it."""
    at, done, last = 0, 0, []
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        new = text[at:end].split()
        yield done - len(last), len(new), last + new
        at, done, last = end, done + len(new), (last + new)[-overlap:] if overlap else []


def union(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that cover the same words, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def searched(docs: DataFrame, paths: list[str], keep: list[str], window: int = 10, text: str = "text", portion: int = PORTION_BYTES, piece: int = PIECE_BYTES) -> DataFrame:
    """keep (as a struct `row`), n_words, spans (of words, from 0, apart) and items (ids as strings, sorted) of each document."""
    row = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    shape = row.select("row").schema.add("n_words", LongType()).add("spans", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))).add("items", ArrayType(StringType()))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in portions(batch, "text", portion)):
            texts = [t.translate(BYTES) for t in b.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            counts, hits, lists = [0] * len(texts), [[] for _ in texts], [{} for _ in texts]
            if not paths:
                counts = [sum(new for _, new, _ in pieces(t, 0, piece)) for t in texts]
            for k, path in enumerate(paths):
                block = patterns(path)
                for i, t in enumerate(texts):
                    for first, new, words in pieces(t, window - 1, piece):
                        counts[i] += new if k == 0 else 0
                        block.search(words, hits[i], lists[i], first)
            spans = [[{"start": x, "end": y} for x, y in union(h)] for h in hits]
            items = [sorted({i for of in x.values() for i in of}, key=lambda s: s.encode()) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return row.mapInArrow(run, shape)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """row (a struct of the columns `keep`), n_words, spans and items of each document: the words inside of any window of an item, and these items.

    The blocks stay in the shared folder, as the result is read from them.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    return searched(docs, write_blocks(spark, windows(items, window, item, item_text), folder, block_words), keep, window, text)


def op12_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m),
occ AS (SELECT pos.r, pos.p, pos.m, win.item_id FROM (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS x FROM pos) pos JOIN win ON pos.m = win.m AND pos.x = win.x),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN its ON d.r = its.r"""
