"""Phrases whose words belong together, counted exactly with the help of count-min sketches.

First pass: each task adds its n-grams to a count-min sketch of its own, whose cells stop counting at the least count asked for. The sketches are merged block by
block of cells, by sums that stop there too. A cell counts whatever falls into it, so a merged sketch never tells less than the true count (up to that
least count), and what has one cell below it is rare for certain. Of the merged sketch only a bit a cell is kept: whether it reached the least count.

Second pass: n-grams that all of their cells let through are counted exactly, by the phrases themselves, combined before the shuffle. Single words and parts of
phrases occur as often as these at least, so nothing that a score needs is lost; what is let through by accident is dropped by its exact count. So the
result doesn't depend on the sketch. Its cells grow with the bytes of the texts up to `most_cells`, a bound on the memory of a task and on what is
broadcast (an eighth of a byte a cell and row); beyond it more of the rare n-grams pass the sketch and are dropped later.

Then a phrase a with f(a) occurrences is cut after each of its words, the cut that scores least counts, and phrases that mostly occur inside of a longer one are left out.

Words are runs of characters other than blanks and tabs, in pieces that end at . , ; : ! ? and line breaks; A to Z are lower-cased. Everything is per language.

Defined results: a null text is empty, and an empty one has no words; a null language is `und`; repeated rows count again; texts of any length are
taken whole; ties in score and count are ranked by the bytes of the phrase; an empty table gives no phrases; further columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import portions, stored, table

#: Lower case; line breaks for what ends a piece, blanks between words.
BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Words are numbered within a chunk by so many bits, and a chunk has fewer words than they can number.
WORD_BITS, CHUNK_BYTES = 21, 3 << 20
DEPTH, BLOCK_CELLS = 2, 1 << 18
#: Bytes of texts for a task at least: each shuffles its sketch, and each phrase that it has.
TASK_BYTES = 64 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Chunk:
    """The distinct n-grams of some text, with their counts. An n-gram is a number made of its words' numbers in the chunk, so no two are taken for one."""

    def __init__(self, lang: str, words: list[bytes], lengths: list[int], carried: int, longest: int):
        vocabulary = dict.fromkeys(words)
        for i, w in enumerate(vocabulary):
            vocabulary[w] = i
        ids = np.fromiter(map(vocabulary.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        self.lang, self.words, self.n_words = lang, list(vocabulary), len(words) - carried
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        key = ids
        for m in range(1, longest + 1):
            if m > 1:
                key = (key[:-1] << np.uint64(WORD_BITS)) | ids[m - 1 :]
            new = np.arange(m - 1, len(words)) >= carried  # those that end in carried words were counted before
            self.grams.append(np.unique(key[(piece[: len(piece) - m + 1] == piece[m - 1 :]) & new], return_counts=True))

    def numbers(self, m: int, key: np.ndarray) -> list[np.ndarray]:
        """For each place of an m-gram the number of its word."""
        return [((key >> np.uint64(WORD_BITS * (m - 1 - i))) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64) - 1 for i in range(m)]

    def cells(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(m, n-grams, counts, the cells of each by row of the sketch)."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        salt = np.uint64(xxhash.xxh64_intdigest(self.lang))
        for m, (key, count) in enumerate(self.grams, 1):
            g = np.full(len(key), salt, np.uint64)
            for n in self.numbers(m, key):
                g = (g ^ hashes[n]) * MIX[0]
                g ^= g >> np.uint64(29)
                g *= MIX[1]
                g ^= g >> np.uint64(32)
            yield m, key, count, np.stack([(g * MIX[2 + r]) >> np.uint64(64 - bits) for r in range(DEPTH)])


def chunks(lang: str, data: bytes, longest: int, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a text in which BYTES was applied; a piece that goes on in the next chunk takes its last words along."""
    at, carry = 0, []
    while at < len(data):
        ends = [e for e in (data.find(b"\n", at + size), data.find(b" ", at + size)) if e >= 0]
        end = min(ends, default=len(data))
        pieces = [p.split() for p in data[at:end].split(b"\n")]
        pieces[0] = carry + pieces[0]
        yield Chunk(lang, [w for p in pieces for w in p], [len(p) for p in pieces], len(carry), longest)
        at, carry = end, pieces[-1][1 - longest :] if longest > 1 else []


def read(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Chunk]:
    for b in (p for batch in batches for p in portions(batch, "text")):
        lang = b.column("lang").fill_null("und")
        for x in pc.unique(lang).to_pylist():
            texts = b.column("text").filter(pc.equal(lang, x)).cast(pa.binary()).drop_null().to_pylist()
            yield from chunks(x, b"\n".join(texts).translate(BYTES), longest)


def sketch(rows: DataFrame, bits: int, least: int, longest: int) -> np.ndarray:
    """For each row of the merged sketch of rows (lang, text) a bit a cell: whether it reached `least`."""
    cells, blocks = 1 << bits, max(1, (1 << bits) // BLOCK_CELLS)
    width = cells // blocks

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((DEPTH, cells), np.uint8)
        for c in read(batches, longest):
            for _, _, count, places in c.cells(bits):
                for r in range(DEPTH):
                    packed = np.sort((places[r] << np.uint64(8)) | np.minimum(count, least).astype(np.uint64))
                    at = packed >> np.uint64(8)
                    first = np.flatnonzero(np.diff(at, prepend=~np.uint64(0)))
                    if len(first):
                        at = at[first].astype(np.int64)
                        own[r, at] = np.minimum(own[r, at] + np.add.reduceat(packed & np.uint64(255), first), least)
        for r in range(DEPTH):
            for k in range(blocks):
                if (part := own[r, k * width : (k + 1) * width]).any():  # which cells aren't empty, and what they hold
                    packed = [zlib.compress(x.tobytes(), 1) for x in (np.packbits(part > 0), part[part > 0])]
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["row", "block", "full", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(width, np.uint16)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["row", "block", "cells"])

        for b in batches:
            for row, block, full, held in zip(b.column("row").to_pylist(), b.column("block").to_pylist(), b.column("full").to_pylist(), b.column("cells").to_pylist(), strict=True):
                if (row, block) != at:
                    if at:
                        yield done()
                    at, total = (row, block), np.zeros(width, np.uint16)
                cells_of = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(full), np.uint8)))
                total[cells_of] = np.minimum(total[cells_of] + np.frombuffer(zlib.decompress(held), np.uint8), least)
        if at:
            yield done()

    merged = rows.mapInArrow(add, "row int, block int, full binary, cells binary").repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, cells binary")
    out = np.zeros((DEPTH, max(1, cells // 8)), np.uint8)
    for x in merged.toLocalIterator():  # a bit a cell in all
        out[x["row"], x["block"] * width // 8 : (x["block"] + 1) * width // 8] = np.frombuffer(x["cells"], np.uint8)
    return out


def frequent(docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang", most_cells: int = 1 << 26) -> DataFrame:
    """(lang, m, phrase, f): exact counts of all phrases of 1 to `longest` words that occur `least` times or more, and with m = 0 all words of a language."""
    if not 1 <= longest <= 3 or not 1 <= least <= 255:
        raise ValueError("phrases have one to three words, and counts to start from are 1 to 255")
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(16, (size // 16).bit_length()), most_cells.bit_length() - 1)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    rows = rows.coalesce(tasks)  # what a task sees again isn't shuffled again
    passed = rows.sparkSession.sparkContext.broadcast(sketch(rows, bits, least, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = passed.value
        for c in read(batches, longest):
            words = pa.array(c.words, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c.lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([c.n_words], pa.int64())], names)
            for m, key, count, places in c.cells(bits):
                alive = np.ones(len(key), bool)
                for r in range(DEPTH):
                    alive &= (reached[r, places[r] >> np.uint64(3)] >> (places[r] & np.uint64(7)).astype(np.uint8)) & 1 == 1
                parts = [words.take(pa.array(n)) for n in c.numbers(m, key[alive])]
                phrase = (parts[0] if m == 1 else pc.binary_join_element_wise(*parts, b" ")).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(phrase), c.lang, object), pa.string()), pa.array(np.full(len(phrase), m, np.int32)), phrase, pa.array(count[alive], pa.int64())], names)

    names = ["lang", "m", "phrase", "f"]
    found = rows.mapInArrow(run, "lang string, m int, phrase string, f long")
    return found.groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f")).where(f"m = 0 or f >= {least}")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, m, phrase, a, l, r, score) of the phrases of two words or more among counts, by the cut that scores least, the first of such."""
    w = F.split("phrase", " ")
    cuts = counts.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("head"), F.array_join(F.slice(w, k + 1, F.col("m") - k), " ").alias("rest")))).alias("cut"))
    of = lambda p, f: counts.where("m > 0").select("lang", F.col("phrase").alias(p), F.col("f").alias(f))
    both = cuts.select("lang", "m", "phrase", "a", "cut.*").join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) * 1000000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    least = both.groupBy("lang", "m", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return least.select("lang", "m", "phrase", "a", "x.l", "x.r", "x.score")


def not_inside(phrases: DataFrame, counts: DataFrame, percent: int = 50) -> DataFrame:
    """phrases but those that lie inside of a longer one with that many percent of their occurrences."""
    w = F.split("phrase", " ")
    parts = F.expr("flatten(transform(sequence(2, m - 1), n -> transform(sequence(1, m - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    longer = counts.where("m > 2").select("lang", "m", "f", w.alias("w")).select("lang", "f", F.explode(parts).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(f"_longer is null or cast(_longer as decimal(38, 0)) * 100 < cast(a as decimal(38, 0)) * {percent}").drop("_longer")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", most_cells: int = 1 << 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases by score, occurrences and bytes."""
    counts = stored(frequent(docs, least, longest, text, lang, most_cells))
    kept = not_inside(scored(counts), counts, percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each of 32 shares of a language, then of these: no task has more than that of a hot language's phrases
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(f"rank <= {top}")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    n = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE m = 3),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON cuts.lang = x.lang AND cuts.head = x.phrase JOIN f y ON cuts.lang = y.lang AND cuts.rest = y.phrase),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3) GROUP BY lang, phrase),
k AS (SELECT b.* FROM b LEFT JOIN longer ON b.lang = longer.lang AND b.phrase = longer.phrase WHERE most IS NULL OR 100 * most < 50 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000"""
