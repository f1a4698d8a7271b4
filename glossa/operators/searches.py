"""Searches within graphs of sentences: the rows of a graph meet in one task, where many graphs are searched at once in arrays.

Rows are shuffled once by their keys and sorted; a task reads them in batches and holds some 2^17 rows, or one graph where this is larger, and searches from so many starts at a time that
the nodes to be marked are some 2^22, or those of one start. Results leave in batches. Null keys and nodes have no edges, as a join would have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS, MARKS = 1 << 17, 1 << 22
NULL = -(1 << 63)
EDGE, START = 0, 1


def rows_of(df: DataFrame, keys: list[str], kind: int, a: str, b: str) -> DataFrame:
    """(keys, _kind, _a, _b): edges lose rows with nulls; other rows keep theirs."""
    if kind == EDGE:
        return df.dropna(subset=[*keys, a, b]).select(*keys, F.lit(kind).cast("byte").alias("_kind"), F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b"))
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL))
    return df.select(*keys, F.lit(kind).cast("byte").alias("_kind"), value(a).alias("_a"), value(b).alias("_b"))


def given_back(c: str, kind: str) -> Column:
    return F.nullif(F.col(c), F.lit(NULL)).cast(kind).alias(c)


class Graphs:
    """Graphs of a batch: nodes have numbers that run on from graph to graph, by their order within each."""

    def __init__(self, graph: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray):
        e, s = kind == EDGE, kind != EDGE
        names, place = np.unique(np.concatenate((a[e], b[e], a[s], b[s])), return_inverse=True)
        of = np.concatenate((graph[e], graph[e], graph[s], graph[s])) * len(names) + place
        known, code = np.unique(of, return_inverse=True)
        self.size, self.graph, self.name = len(known), known // max(1, len(names)), names[known % max(1, len(names))]
        count = np.bincount(self.graph, minlength=int(graph[-1]) + 1)
        self.count, self.first = count, np.cumsum(count) - count
        n, m = int(e.sum()), int(s.sum())
        pair = np.unique(code[:n] * self.size + code[n : 2 * n])
        self.src, self.dst = pair // self.size, pair % self.size
        self.begin = np.searchsorted(self.src, np.arange(self.size + 1))
        self.a, self.b = code[2 * n : 2 * n + m], code[2 * n + m :]

    def expanded(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `nodes`, once for each edge, and where these edges lead."""
        many = self.begin[nodes + 1] - self.begin[nodes]
        at = np.repeat(np.arange(len(nodes)), many)
        return at, self.dst[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[nodes], many)]

    def searched(self, starts: np.ndarray, nodes: np.ndarray, hops: int | None, parents: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """From each of `starts`, which has its own `nodes` (pairs of both, by starts): blocks of starts, where the marks of each begin, depths of a start's nodes (-1: not reached) and the least nodes that lead there first."""
        own, inverse = np.unique(starts, return_inverse=True)
        sizes = self.count[self.graph[own]]
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), MARKS, "right")) + i)
            offset = np.cumsum(sizes[i:j]) - sizes[i:j]
            shift = offset - self.first[self.graph[own[i:j]]]  # from a node's number to its mark
            depth = np.full(int(sizes[i:j].sum()), -1, np.int32)
            owner, up = np.empty(len(depth), np.int32), np.full(len(depth), self.size, np.int64) if parents else None
            here = (inverse >= i) & (inverse < j)
            who, now, d = inverse[here] - i, nodes[here], 0
            depth[shift[who] + now] = 0
            while len(now) and (hops is None or d < hops):
                d += 1
                at, following = self.expanded(now)
                mark = shift[who[at]] + following
                new = depth[mark] < 0
                at, following, mark = at[new], following[new], mark[new]
                if parents:
                    np.minimum.at(up, mark, now[at])
                owner[mark] = np.arange(len(mark), dtype=np.int32)
                once = owner[mark] == np.arange(len(mark), dtype=np.int32)
                depth[mark] = d
                who, now = who[at[once]], following[once]
            yield own[i:j], offset, depth, up
            i = j


Kernel = Callable[[Graphs], Iterator[tuple[np.ndarray, list[np.ndarray]]]]


def searched(rows: DataFrame, keys: list[str], kernel: Kernel, columns: str) -> DataFrame:
    """(keys, columns) of rows (keys, _kind, _a, _b): the kernel yields numbers of graphs, and the columns' values."""
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(columns).fields])

    def whole(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        graph = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
        kind, a, b = (t.column(c).to_numpy() for c in ("_kind", "_a", "_b"))
        for of, values in kernel(Graphs(graph, kind, a, b)):
            for at in range(0, len(of), 1 << 16):
                part = pa.array(first[of[at : at + (1 << 16)]])
                got = [t.column(k).combine_chunks().take(part) for k in keys] + [pa.array(v[at : at + (1 << 16)]) for v in values]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got], schema.names)

    def firsts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            x, y = t.column(k).slice(1), t.column(k).slice(0, t.num_rows - 1)
            new[1:] |= pc.fill_null(pc.not_equal(x, y), False).to_numpy() | (x.is_null().to_numpy() != y.is_null().to_numpy())
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, ROWS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                first = firsts(t)
                last = int(first[-1])  # this graph may go on
                if last:
                    yield from whole(t.slice(0, last), first[:-1])
                held, n = t.slice(last).to_batches(), t.num_rows - last
                enough = max(ROWS, 2 * n)
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from whole(t, firsts(t))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def reached(hops: int | None) -> Kernel:
    """(start, node, depth) from rows START (start, node); a start's number need be no node of the graph."""

    def kernel(g: Graphs) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for own, offset, depth, _ in g.searched(g.a, g.b, hops):
            mark = np.flatnonzero(depth >= 0)
            who = np.searchsorted(offset, mark, "right") - 1
            node = mark - offset[who] + g.first[g.graph[own[who]]]
            yield g.graph[own[who]], [g.name[own[who]], g.name[node], depth[mark]]

    return kernel


def paths(g: Graphs) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(start, end, step, node, next) from rows START (start, end): the steps of a shortest path, by the least nodes that lead on."""
    order = np.argsort(g.a, kind="stable")
    a, b = g.a[order], g.b[order]
    for own, offset, depth, up in g.searched(a, a, None, parents=True):
        here = slice(*np.searchsorted(a, [own[0], own[-1] + 1]))
        start, end = a[here], b[here]
        shift = offset[np.searchsorted(own, start)] - g.first[g.graph[start]]
        now = end
        while len(now):
            left = depth[shift + now] > 0
            start, end, shift, now = start[left], end[left], shift[left], now[left]
            before = up[shift + now]
            yield g.graph[start], [g.name[start], g.name[end], depth[shift + now] - 1, g.name[before], g.name[now]]
            now = before


def tops(g: Graphs) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(node) from rows START (node, node): nodes without incoming edges, and of those that none of these leads to, those that no smaller one leads to."""
    given = np.zeros(g.size, bool)
    given[g.a] = True
    root = given.copy()
    root[g.dst] = False
    seen, now = root.copy(), np.flatnonzero(root)
    while len(now):
        _, following = g.expanded(now)
        now = np.unique(following[~seen[following]])
        seen[now] = True
    least = np.arange(g.size)
    now = np.flatnonzero(given & ~seen)
    while len(now):
        at, following = g.expanded(now)
        value, keep = least[now[at]], given[following] & ~seen[following]
        value, following = value[keep], following[keep]
        less = value < least[following]
        np.minimum.at(least, following[less], value[less])
        now = np.unique(following[less])
    found = np.flatnonzero(root | (given & ~seen & (least == np.arange(g.size))))
    yield g.graph[found], [g.name[found]]
