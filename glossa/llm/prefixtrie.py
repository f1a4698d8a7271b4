"""A trie of conversations that begin alike, built as a Patricia trie.

1. A turn becomes two 64-bit hashes of its place, role and text; a prefix is known by the exclusive or of its turns' hashes, of 128 bits in all. Conversations are cut into segments of
   SEGMENT turns, so none is ever one row, and segments that begin at the same prefix are sorted by their turns, dealt out by ranges of (prefix, turns, conversation): copies spread over tasks.
2. Neighbours in that order are compared. Where they part is a branch point, where a conversation ends an end or leaf point; nothing else is created. Ends of ranges are compared across ranges.
3. Points are joined to the conversations that pass them, and aggregates are taken over points alone, combined before the shuffle. With the smallest member of a point as its owner, the
   conversations of a subtree give all its sums: each member adds the texts between the point and the last point on its way that it doesn't own, and a leaf is counted by its owner.
4. The unary nodes of an edge have the members of the point at its lower end. They are expanded from it, and their sums are the point's and the texts of the edge from them to the point, a suffix sum.

Defined results: rows without a conversation are part of none; null roles and texts are empty; rows of the same turn (or of none) in one conversation are ordered by their hashes, a fixed
order; rows repeated as a whole are turns of their own; texts and conversations of any length are taken whole; further columns, whatever their names, are not read; an empty table gives
no nodes, not even a root. The ids of the conversations that end at one node go through one task, as SHA-256 takes them in order, but in pieces, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import number_rows, stored, table

SEGMENT = 1024
PLACE = ["depth", "z1", "z2"]


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, t, a, b, len): the turns of each conversation in order, t from 0, as hashes of role and text with the text's length."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.expr(f"`{turn}` div {SEGMENT}").alias("cell"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.length(text).cast("long").alias("len"))
    return number_rows(rows, "c", "cell", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "t").select("c", "t", "a", "b", "len")


def rebuilt(turns: DataFrame, family: int = 100, leads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, size) and their turns (c, size, depth, a, b, len), where the first h turns are those of conversation c - c % family, h being the crc32 of c, modulo `leads`."""
    ids = turns.groupBy("c").agg(F.count("*").alias("own"))
    ids = ids.withColumn("h", F.crc32(F.encode(F.col("c").cast("string"), "utf-8")) % leads).withColumn("base", F.col("c") - F.col("c") % family)
    of = ids.select(F.col("c").alias("base"), F.col("own").alias("there"))
    ids = ids.join(of, "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0))))
    ids = stored(ids.select("c", "h", "base", "lead", (F.col("lead") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("size")))
    own = turns.join(ids.select("c", "h", "lead", "size"), "c").where("t >= h").select("c", "size", (F.col("lead") + F.col("t") - F.col("h") + 1).alias("depth"), "a", "b", "len")
    first = turns.where(F.col("t") < leads - 1).select(F.col("c").alias("base"), "t", "a", "b", "len")
    led = ids.where("lead > 0").join(first, "base").where("t < h").select("c", "size", (F.col("t") + 1).alias("depth"), "a", "b", "len")
    return ids.select("c", "size"), own.union(led)


def with_prefixes(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (c, size, depth, z1, z2, len, before: the lengths of the turns above), with the root's, and segments (z1, z2, depth, path, c, ends)."""
    mixed = stored(turns.select("c", "size", "depth", F.expr(f"(depth - 1) div {SEGMENT}").alias("cell"), F.xxhash64("depth", "a", "b").alias("x1"), F.xxhash64("b", "a", "depth").alias("x2"), "len"))
    above = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = mixed.groupBy("c", "cell").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("len").alias("len"))
    starts = stored(sums.select("c", "cell", *(F.coalesce(f.over(above), F.lit(0)).alias(n) for f, n in ((F.bit_xor("x1"), "s1"), (F.bit_xor("x2"), "s2"), (F.sum("len"), "ahead")))))
    inside = Window.partitionBy("c", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    cum = mixed.withColumn("w1", F.bit_xor("x1").over(inside)).withColumn("w2", F.bit_xor("x2").over(inside)).withColumn("to", F.sum("len").over(inside)).join(starts, ["c", "cell"])
    root = ids.select("c", "size", *(F.lit(0).cast("long").alias(n) for n in (*PLACE, "len", "before")))
    prefixes = cum.select("c", "size", "depth", F.col("s1").bitwiseXOR(F.col("w1")).alias("z1"), F.col("s2").bitwiseXOR(F.col("w2")).alias("z2"), "len", (F.col("ahead") + F.col("to") - F.col("len")).alias("before")).union(root)
    paths = mixed.groupBy("c", "size", "cell").agg(F.array_sort(F.collect_list(F.struct("depth", "x1", "x2"))).alias("p"))  # SEGMENT turns at most
    paths = paths.join(starts, ["c", "cell"]).select(F.col("s1").alias("z1"), F.col("s2").alias("z2"), (F.col("cell") * SEGMENT).alias("depth"), F.flatten(F.transform("p", lambda x: F.array(x["x1"], x["x2"]))).alias("path"), "c", (F.col("size") <= (F.col("cell") + 1) * SEGMENT).alias("ends"))
    bare = ids.where("size = 0").select(*(F.lit(0).cast("long").alias(n) for n in ("z1", "z2", "depth")), F.expr("cast(array() as array<bigint>)").alias("path"), "c", F.lit(True).alias("ends"))
    return stored(prefixes), paths.union(bare)


def points(segments: DataFrame) -> DataFrame:
    """(depth, z1, z2) of the root and of all branch, end and leaf points."""
    names = ["z1", "z2", "depth", "path", "c", "ends", "part", "side"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points as rows without a side, and the first and last row of the range as rows of side 0 and 1."""
        part, last, told = TaskContext.get().partitionId(), None, False  # told: whether the end of a path like the last one is among the points

        def row(z1, z2, depth, path, c, ends, side):
            return [z1, z2, depth, path, c, ends, part, side]

        for b in batches:
            found = []
            paths = b.column("path")
            ends_at, flat = paths.offsets.to_numpy(), paths.values.to_numpy(zero_copy_only=False)
            for i, (z1, z2, depth, c, ends) in enumerate(zip(*(b.column(n).to_pylist() for n in ("z1", "z2", "depth", "c", "ends")), strict=True)):
                path = flat[ends_at[i] : ends_at[i + 1]].reshape(-1, 2)

                def place(n, z1=z1, z2=z2, depth=depth, path=path):
                    x = np.bitwise_xor.reduce(path[:n], axis=0) if n else (0, 0)
                    found.append(row(int(z1 ^ int(x[0])), int(z2 ^ int(x[1])), depth + n, None, None, None, None))

                same = last is not None and last[:3] == (z1, z2, depth)
                if same:
                    short = min(len(path), len(last[3]))
                    differ = (path[:short] != last[3][:short]).any(axis=1)
                    agree = int(differ.argmax()) if differ.any() else short
                    if agree < short:
                        place(agree)
                    same = agree == len(path) == len(last[3])
                told = told and same
                if ends and not told:
                    place(len(path))
                    told = True
                now = (z1, z2, depth, path.copy(), c, ends)
                if last is None:
                    found.append(row(z1, z2, depth, path.ravel().tolist(), c, ends, 0))
                last = now
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row(*last[:3], last[3].ravel().tolist(), *last[4:], 1), kinds, strict=True)], names)

    kind = "z1 long, z2 long, depth long, path array<long>, c long, ends boolean, part int, side int"
    order = ["z1", "z2", "depth", "path", "c"]
    ranges = stored(segments.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, kind))
    edges = ranges.where("side is not null").repartition(1).sortWithinPartitions("part", "side").mapInArrow(compare, kind)  # two rows a range
    root = segments.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(n) for n in PLACE))
    return stored(ranges.union(edges).where("side is null").select(*PLACE).union(root).distinct())


def digests(ends: DataFrame) -> DataFrame:
    """(depth, z1, z2, ends_sha256) of the ids c that end at a point, in ascending order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of up to 64 Ki ids: place, first id, the ids joined."""
        at, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*at, ids[0])), pa.array([",".join(map(str, ids))])], [*PLACE, "c", "ids"])

        for b in batches:
            for *place, c in zip(*(b.column(n).to_pylist() for n in (*PLACE, "c")), strict=True):
                if place != at or len(ids) >= 1 << 16:
                    if ids:
                        yield piece()
                    at, ids = place, []
                ids.append(c)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in at), pa.array([state.hexdigest()])], [*PLACE, "ends_sha256"])

        for b in batches:
            for *place, ids in zip(*(b.column(n).to_pylist() for n in (*PLACE, "ids")), strict=True):
                if place != at:
                    if at:
                        yield done()
                    at, state = place, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if at:
            yield done()

    place = "depth long, z1 long, z2 long"
    order = [*PLACE, "c"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{place}, c long, ids string")
    return pieces.repartition(*PLACE).sortWithinPartitions(*order).mapInArrow(digest, f"{place}, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; ids and turns as rebuilt() gives them."""
    prefixes, segments = with_prefixes(ids, turns)
    passed = stored(prefixes.join(points(segments), PLACE))  # each conversation at each point on its way
    facts = stored(passed.groupBy(*PLACE).agg(F.min("c").alias("m"), F.count("*").alias("n"), F.count(F.when(F.col("depth") == F.col("size"), 1)).alias("n_ends")))  # apart from the join, so that hot points can be split there
    way, all_of = Window.partitionBy("c").orderBy("depth"), Window.partitionBy("c")  # points on the way of one conversation: no more than others part from it
    rows = passed.join(facts, PLACE)
    rows = rows.select("c", *PLACE, "len", "before", "m", "n",
        F.lag(F.struct(*PLACE, "m")).over(way).alias("up"),
        F.coalesce(F.max(F.when(F.col("m") != F.col("c"), F.struct("depth", (F.col("before") + F.col("len")).alias("to")))).over(all_of)["to"], F.lit(0)).alias("strange"),
        F.max(((F.col("m") == F.col("c")) & (F.col("n") == F.col("n_ends"))).cast("int")).over(all_of).alias("leaf"),
    )
    rows = stored(rows)
    sums = rows.groupBy(*PLACE).agg(F.sum(F.greatest(F.lit(0), F.col("strange") - F.col("before"))).alias("saved"), F.sum("leaf").alias("n_leaves"))
    owned = rows.where("c = m")
    children = owned.where("up is not null").groupBy(*(F.col(f"up.{p}").alias(p) for p in PLACE)).agg(F.count("*").alias("n_children"))
    ends = digests(passed.where("depth = size"))
    edges = owned.join(sums, PLACE).join(children, PLACE, "left").join(ends, PLACE, "left")
    edges = edges.select("c", "n", "saved", "n_leaves", "n_children", "ends_sha256", F.col("depth").alias("low"), F.col("before").alias("to"), F.coalesce("up.depth", F.lit(-1)).alias("top"), F.col("up.m").alias("above"))
    cells = edges.withColumn("cell", F.explode(F.expr(f"sequence((top + 1) div {SEGMENT}, low div {SEGMENT})")))
    nodes = cells.withColumn("depth", F.explode(F.expr(f"sequence(greatest(top + 1, cell * {SEGMENT}), least(low, cell * {SEGMENT} + {SEGMENT - 1}))")))
    nodes = nodes.join(prefixes.select("c", "depth", "before"), ["c", "depth"])
    point = F.col("depth") == F.col("low")
    return nodes.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top") + 1, F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(point, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n") - 1) * (F.col("to") - F.col("before"))).alias("saved_tokens"),
        F.coalesce(F.when(point, F.col("ends_sha256")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered(table(spark, sf_dir, "conversations")))
    return trie(*rebuilt(turns))


OP13_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(c::VARCHAR, '.'), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) AS x
  FROM (SELECT DISTINCT c FROM t)),
ids AS (SELECT c, x % 6 AS h, c - c % 100 AS base FROM crc),
led AS (SELECT ids.c, b.t + 1 AS d, b.role, b.text FROM ids JOIN t b ON b.c = ids.base AND b.t < ids.h),
n_led AS (SELECT c, count(*) AS n FROM led GROUP BY c),
r AS (SELECT * FROM led UNION ALL SELECT t.c, coalesce(n, 0) + t.t - h + 1, t.role, t.text FROM t JOIN ids ON t.c = ids.c LEFT JOIN n_led ON n_led.c = t.c WHERE t.t >= h),
k AS (SELECT c, 0 AS d, '' AS p, 0 AS len FROM ids UNION ALL SELECT c, d, string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY c ORDER BY d), length(text) FROM r),
last AS (SELECT c, max(d) AS d FROM k GROUP BY c),
node AS (SELECT p, k.d, min(k.c) AS conv_id, count(*) AS n_convs, max(len) AS len, string_agg(CASE WHEN k.d = last.d THEN k.c::VARCHAR END, ',' ORDER BY k.c) AS ends FROM k JOIN last ON k.c = last.c GROUP BY p, k.d),
kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT n.p, sum(CASE WHEN kids.p IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((s.n_convs - 1) * s.len) AS saved FROM node n JOIN node s ON starts_with(s.p, n.p) LEFT JOIN kids ON kids.p = s.p GROUP BY n.p)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sub ON sub.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN node up ON n.d > 0 AND up.p = left(n.p, length(n.p) - 32)"""
