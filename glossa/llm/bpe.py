"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the tokenizer's pattern, and each piece that the vocabulary doesn't hold whole is merged on its own.
Pieces that were not met before form matrices, one for each bucket of lengths, a piece in each row: every round finds
each row's leftmost pair of least rank, merges it and closes the gap, so that all rows of the matrix shrink by one column;
finished rows leave it. Ranks of pairs come from an open-addressing hash table, in numpy as well.
Pieces longer than the largest bucket, which would make a round for each of their bytes, are merged with a heap instead,
with the same result.

Defined results: a null text is an empty one, with no tokens and empty bytes; texts of any length are encoded whole;
equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import table

BUCKETS = (4, 8, 16, 32, 64, 128, 256)
NONE = np.int32(2**31 - 1)
#: Pieces whose tokens a Python worker remembers; beyond that it starts anew.
REMEMBERED = 200_000


class PairTable:
    """(left id, right id) -> id of the two merged."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        left = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, ranks = (left[:, 0] << 32) | left[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):  # the first of those that ask for a free slot gets it
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            left_over = np.ones(len(keys), bool)
            left_over[first] = False
            keys, ranks, at = keys[left_over], ranks[left_over], (at[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the two don't merge; a negative id merges with nothing."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        at = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.flatnonzero(keys != -2)
        flat, at, out = keys.ravel(), at.ravel(), out.ravel()
        while len(open_):
            met = self.keys[at[open_]]
            hit = met == flat[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out.reshape(keys.shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    pairs[a, b] = rank
        self.pairs, self.pair_table = pairs, PairTable(pairs)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return [m[0] for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Finds the tokens of the pieces that aren't known."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces - self.known.keys():
            raw = piece.encode("utf-8", "replace")
            if (whole := self.ranks.get(raw)) is not None:
                self.known[piece] = (whole,)
            elif len(raw) > BUCKETS[-1]:
                self.known[piece] = self._merge_long(raw)
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(raw) <= b), []).append((piece, raw))
        for width, rows in buckets.items():
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                for (piece, _), ids in zip(part, self._merge_rows([raw for _, raw in part], width), strict=True):
                    self.known[piece] = ids

    def _merge_rows(self, raws: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(len(raws), width)
        ids = np.where(np.arange(width) < n[:, None], self.single[padded], np.int32(-1))
        rank = self.pair_table(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(raws))
        out: list[tuple[int, ...]] = [()] * len(raws)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            if (over := least == NONE).any():  # these rows are done and leave the matrix
                for r, x in zip(row[over].tolist(), ids[over].tolist(), strict=True):
                    out[r] = tuple(i for i in x if i >= 0)
                ids, rank, row, at, least = ids[~over], rank[~over], row[~over], at[~over], least[~over]
                if not len(row):
                    break
            i, width = np.arange(len(row)), ids.shape[1] - 1
            ids[i, at] = least
            kept = np.ones(ids.shape, bool)
            kept[i, at + 1] = False
            ids = ids[kept].reshape(-1, width)
            kept = np.ones(rank.shape, bool)
            kept[i, at] = False
            rank = rank[kept].reshape(-1, width - 1)
            if width > 1:
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                rank[before, at[before] - 1] = self.pair_table(ids[before, at[before] - 1], ids[before, at[before]])
                rank[after, at[after]] = self.pair_table(ids[after, at[after]], ids[after, at[after] + 1])
        return out

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        ids: list[int] = self.single[np.frombuffer(raw, np.uint8)].tolist()
        ahead, behind = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs, end = self.pairs, len(ids)
        heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue  # one of the two has gone meanwhile
            ids[i], ids[j], ahead[i] = rank, -1, ahead[j]
            if ahead[j] < end:
                behind[ahead[j]] = i
                if (p := (rank, ids[ahead[j]])) in pairs:
                    heapq.heappush(heap, (pairs[p], i, *p))
            if behind[i] >= 0 and (p := (ids[behind[i]], rank)) in pairs:
                heapq.heappush(heap, (pairs[p], behind[i], *p))
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.split(t or "") for t in texts]
        self.learn(set(chain.from_iterable(cut)))  # all at once, for large matrices
        return [np.fromiter(chain.from_iterable(map(self.known.__getitem__, pieces)), np.int32) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """docs, or its columns `keep`, and _ids: array<int>, the tokens of the whole text.

    path: a vocabulary file in ranks that every executor has at this place. decoded: a column for the bytes that these tokens
    stand for, decoded in the same pass, which spares a second Python worker a task and the tokens' way through the JVM.
    """
    names = docs.columns if keep is None else keep
    shape = docs.select(*names).schema.add("_ids", ArrayType(IntegerType()))
    shape = shape.add(decoded, "binary") if decoded else shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory
                part = b.slice(at, 256)
                ids = v.encode(part.column(text).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                found = [pa.array([v.decode(x.tolist()) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, *found], [*names, "_ids", *([decoded] if decoded else [])])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, shape)


def with_bytes(docs: DataFrame, path: str, pattern: str, ids: str = "_ids", out: str = "_bytes") -> DataFrame:
    """docs and `out`: the bytes that the tokens stand for."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [v.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*names, out])

    return docs.mapInArrow(run, docs.select(*names).schema.add(out, "binary"))


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, tokens, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    both = with_tokens(docs, path, pattern, keep=keep, decoded="_bytes")
    ids = F.encode(F.array_join(F.col("_ids").cast("array<string>"), " "), "utf-8")
    return both.select(*keep, F.col("_ids").alias("tokens"), F.size("_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ["doc_id"]).drop("tokens")


def with_place(docs: DataFrame, columns: list) -> DataFrame:
    """`columns` of docs and _position: the row's place from 0 in the files that docs were read from, by name; null if docs aren't read from files."""
    try:
        placed = docs.select(*columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        counted = placed.groupBy("_file").agg(F.count("*").alias("n")).collect()
    except AnalysisException:
        return docs.select(*columns, F.lit(None).cast("long").alias("_position"))
    ends = accumulate((r["n"] for r in sorted(counted)), initial=0)
    first = docs.sparkSession.createDataFrame([(r["_file"], n) for r, n in zip(sorted(counted), ends, strict=False)], "_name string, _first long")
    return placed.join(F.broadcast(first), F.col("_file") == F.col("_name"), "left").withColumn("_position", F.col("_first") + F.col("_row")).drop("_file", "_row", "_name", "_first")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents but the text, their position in the mixed order, their tokens, and the digests of these and of what they decode to."""
    rest = F.struct(*(c for c in docs.columns if c != "text"))  # so no column's name can clash
    placed = with_place(docs, [rest.alias("_doc"), "text"])
    return digests(placed, ["_doc", "_position"]).select("_doc.*", F.col("_position").alias("position"), "tokens", "n_tokens", "ids_sha256", "decoded_sha256")
