"""Sharding by a k-d tree over documents' metadata.

The documents are split again and again, along the dimension in which a node is widest (against the whole table's
width), at the weighted quantile of its bytes, until a leaf holds the target. A node that becomes m leaves gives floor(m/2)
of them, and that share of its bytes, to its lower side. The dimensions are the source, the language (categories lie
where their hash falls) and the logarithm of the size. Within equal coordinates a hash orders the rows, so that
a category that holds a third of all rows can be cut anywhere.

The medians are distributed: each pass is one aggregate that sums bytes in bins of a node's interval, and the next pass
looks only into the bin where the quantile lies, until that bin's bytes don't matter. The driver sees bins and nodes,
never rows: at most BINS rows a pass, or LEAST_BINS for each node. Rows learn their node level by level, by joins with the level's splits.

Equal texts keep together, at the metadata of their smallest id, unless their bytes exceed `whole` of a leaf's;
such a group is cut like other rows, since it would make the sizes uneven.

Defined results: null texts count no bytes besides the fixed 16, like empty ones; null metadata are a category of their own; repeated
rows are rows of their own; an empty table gives an empty result; with fewer rows than leaves some leaves stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, hex_digits_for, number_rows, table

#: Rows at most that a pass over one level brings to the driver.
BINS = 1 << 17
LEAST_BINS = 8
#: Nodes of a level up to which its splits are broadcast, at some 100 bytes each.
BROADCAST_NODES = 1 << 20
SPAN = 1 << 31
#: Levels after which the rows' nodes are written down.
LEVELS = 6


def _coordinates(docs: DataFrame) -> list[Column]:
    place = lambda c: F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(SPAN))
    return [place("source"), place("lang"), (F.log2("size") / 50 * SPAN).cast("long")]


def _with(points: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """points with a level's rows (_n, ...), joined by node; nulls where there is none."""
    table = points.sparkSession.createDataFrame(rows, "_n int, " + names)
    return points.join(F.broadcast(table) if len(rows) <= BROADCAST_NODES else table, F.col("_node") == F.col("_n"), "left")


def _at(dims: int) -> Column:
    return F.get(F.array(*(F.col(f"_k{i}") for i in range(dims))), F.col("_d"))


def _quantiles(points: DataFrame, dims: int, wanted: dict[int, tuple[int, float]], slack: float) -> dict[int, int]:
    """{node: key}: the key at which the bytes below reach the target; wanted: {node: (dimension, target bytes)}."""
    bins = max(LEAST_BINS, BINS // len(wanted))
    state = {n: [d, 0, SPAN * SPAN, 0.0, target] for n, (d, target) in wanted.items()}  # dimension, interval, bytes below it, target
    found: dict[int, int] = {}
    while state:
        rows = [(n, d, a, b, max(1, -(-(b - a) // bins))) for n, (d, a, b, _, _) in state.items()]
        keyed = _with(points, rows, "_d int, _lo long, _hi long, _w long").where("_n is not null").withColumn("_k", _at(dims)).where("_k >= _lo and _k < _hi")
        sums = keyed.groupBy("_node", F.expr("(_k - _lo) div _w").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("_k").alias("least"), F.max("_k").alias("most")).collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r["_node"], []).append((r["bin"], r["bytes"], r["least"], r["most"]))
        for n in list(state):
            d, a, b, below, target = state[n]
            at = b
            for _, size, least, most in sorted(by.get(n, [])):
                if below + size >= target:
                    if least == most or size <= slack:  # the nearer side of what can't, or needn't, be cut
                        at = least if target - below < size / 2 else most + 1
                        found[n] = at
                        del state[n]
                    else:
                        state[n] = [d, least, most + 1, below, target]
                    break
                below += size
            else:
                found[n] = at
                del state[n]
    return found


def with_leaf(rows: DataFrame, leaves: int, whole: float = 0.05) -> DataFrame:
    """rows (group, doc_id, size, source, lang) with `shard`, from 0 to leaves - 1, near equal in bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    of = [c.alias(f"_c{i}") for i, c in enumerate(_coordinates(rows))]
    dims = len(of)
    first = F.min_by(F.struct(*of), F.struct("doc_id", *of))
    groups = rows.groupBy("group").agg(first.alias("_at"), F.sum("size").alias("_bytes"))
    small = F.col("_bytes") <= whole * total / leaves
    joined = rows.join(groups, "group")
    mine = F.struct(*of)
    tie = F.pmod(F.when(small, F.xxhash64("group")).otherwise(F.xxhash64("group", "doc_id")), F.lit(SPAN))
    points = joined.withColumn("_p", F.when(small, F.col("_at")).otherwise(mine)).withColumn("_h", tie)
    points = cut(points.select(*rows.columns, F.lit(0).alias("_node"), *((F.col(f"_p._c{i}") * SPAN + F.col("_h")).alias(f"_k{i}") for i in range(dims))))
    base, level = points, 0
    tree, parts, next_node = {}, {0: leaves}, 1
    whole_width: list[float] = []
    open_ = [0] if leaves > 1 else []
    while open_:
        shape = points.groupBy("_node").agg(F.sum("size").alias("bytes"), *(f(f"_k{i}").alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))))
        seen = {r["_node"]: r for r in shape.collect()}
        wanted = {}
        for n in open_:
            if n in seen:  # others are empty
                widths = [seen[n][f"hi{i}"] // SPAN - seen[n][f"lo{i}"] // SPAN for i in range(dims)]
                whole_width = whole_width or [max(1, w) for w in widths]
                d = max(range(dims), key=lambda i: (widths[i] / whole_width[i], -i))
                wanted[n] = (d, seen[n]["bytes"] * (parts[n] // 2) / parts[n])
        if not wanted:
            break
        splits, open_ = [], []
        for n, at in _quantiles(points, dims, wanted, slack=total / leaves / 1000).items():
            splits.append((n, wanted[n][0], at, next_node, next_node + 1))
            tree[n] = (next_node, next_node + 1)
            parts[next_node], parts[next_node + 1] = parts[n] // 2, parts[n] - parts[n] // 2
            open_ += [x for x in tree[n] if parts[x] > 1]
            next_node += 2
        points = _with(points, splits, "_d int, _split long, _left int, _right int")
        node = F.when(F.col("_n").isNull(), F.col("_node")).when(_at(dims) < F.col("_split"), F.col("_left")).otherwise(F.col("_right"))
        points = points.withColumn("_node", node).drop("_n", "_d", "_split", "_left", "_right")
        if (level := level + 1) % LEVELS == 0:
            points = cut(points)
            drop(base)
            base = points
    ends, stack = [], [0]  # the leaves from left to right
    while stack:
        n = stack.pop()
        if n in tree:
            stack += tree[n][::-1]
        else:
            ends.append((n, len(ends)))
    out = _with(points, ends, "shard int")
    return out.select(*rows.columns, "shard")


def shard_documents(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot is gapless from 0 within a shard."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = cut(docs.select("doc_id", "source", "lang", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group")))
    n = rows.count()
    if leaves is None:
        leaves = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = with_leaf(rows, leaves).withColumn("_cell", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, hex_digits_for(n // leaves + 1)))
    return number_rows(placed, "shard", "_cell", ["doc_id", "group"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"), leaves=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
