"""Dependency trees as hexatags, and back: a tag for each word and one for each gap between words.

A projective tree is a binary tree over its words, in which a node L has its head on the left and a node R on the right. A word's tag is `tl-` or `tr-` (a left
or right child) with the label of the edge that comes in; a gap's tag is `nl-` or `nr-` with L or R, for the node whose children meet there.
The gap after the last word has the tag `eos`, which decoding doesn't read.

Trees are bounded by their sentences, so both directions are one Arrow pass over sentences, without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from glossa.functions.tokenizer import EDGE

Scores = list[list[tuple[str, float]]]


class Best:
    """The k entries of the highest scores; of equal ones, those that came first."""

    def __init__(self, k: int):
        self.k, self.heap, self.seen = k, [], 0

    def insert(self, score: float, item) -> bool:
        """Whether the entry is among the best so far."""
        self.seen += 1
        entry = (score, -self.seen, item)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
            return True
        return heapq.heappushpop(self.heap, entry) is not entry

    def sorted(self) -> list[tuple[float, object]]:
        return [(s, x) for s, _, x in sorted(self.heap, key=lambda e: (-e[0], -e[1]))]


def best_paths(scores: Scores, k: int) -> list[tuple[float, list[str]]]:
    """The k sequences of a tag a position that are likeliest by the softmax of each position, best first; fewer if there are fewer."""
    total, back = np.zeros(1), []
    for column in scores:
        if not column:
            return []
        x = np.array([s for _, s in column], np.float64)
        log = x - x.max()
        log -= np.log(np.exp(log).sum())
        grid = (total[:, None] + log[None, :]).ravel()
        kept = np.argsort(-grid, kind="stable")[:k]
        back.append(np.divmod(kept, len(column)))
        total = grid[kept]
    out = []
    for at in range(len(total)):
        path, i = [], at
        for (before, tag), column in zip(reversed(back), reversed(scores), strict=True):
            path.append(column[tag[i]][0])
            i = before[i]
        out.append((float(total[at]), path[::-1]))
    return out


def tree_of(term: list[str], gaps: list[str]) -> tuple[list[tuple[int, int, str]], int, str] | None:
    """(edges (head, word, label), root, its label) of a sentence's tags; none if they are no tree.

    The stack holds whole trees as (head, label), and unfinished ones as the open nodes along their right edge: only the last lacks its right child.
    """
    stack, edges = [], []
    for i, tag in enumerate(term):
        side, _, label = tag.partition("-")
        done = (i, label)
        if side == "tr":
            if not stack:
                return None
            for head, name, node in reversed(stack.pop()):
                (a, _), (b, modifier) = ((head, name), done) if node == "L" else (done, (head, name))
                edges.append((a, b, modifier))
                done = (head, name) if node == "L" else done
        elif side != "tl":
            return None
        if i + 1 == len(term):
            return (sorted(edges, key=lambda e: e[1]), *done) if not stack else None
        side, _, node = gaps[i].partition("-")
        if node not in ("L", "R") or side not in ("nl", "nr") or (side == "nr" and not stack):
            return None
        stack.append([*(stack.pop() if side == "nr" else ()), (*done, node)])
    return None


def decode(term: Scores, gaps: Scores, k: int = 25) -> tuple[list[tuple[int, int, str]], list[int]] | None:
    """(edges, roots) of the likeliest pair, among the k best pairs of the k best paths each, that is a tree."""
    if not term or len(term) != len(gaps):
        return None
    first = lambda scores, mark: [[x for x in scores[0] if x[0].startswith(mark)], *scores[1:]]
    pairs, right = Best(k), best_paths(first(gaps, "nl-") if len(gaps) > 1 else gaps, k)
    for a, words in best_paths(first(term, "tl-"), k):
        for b, nodes in right:
            if not pairs.insert(a + b, (words, nodes)):
                break  # those that follow have lower scores still
    for _, (words, nodes) in pairs.sorted():
        if found := tree_of(words, nodes):
            return found[0], [found[1]]
    return None


def likeliest(term: Scores, gaps: Scores) -> tuple[list[tuple[int, int, str]], list[int]] | None:
    """(edges, roots) of the likeliest pair of tag sequences that is a tree, however many likelier pairs are none; none if no pair is.

    Whether tags make a tree depends on their sides alone, by the number of open trees on the stack, so of each side the best tag of a position counts, and the
    best way to each number of open trees.
    """
    n = len(term)
    if not n or n != len(gaps):
        return None

    def best(column, sides: tuple[str, str], fits) -> list[tuple[float, str | None]]:
        out = [(-np.inf, None), (-np.inf, None)]
        for tag, score in column:
            side, _, rest = tag.partition("-")
            if side in sides and fits(rest) and score > out[at := sides.index(side)][0]:
                out[at] = (score, tag)
        return out

    words = [best(c, ("tl", "tr"), lambda _: True) for c in term]
    nodes = [best(c, ("nl", "nr"), lambda x: x in ("L", "R")) for c in gaps[:-1]]
    # 0: left, 1: right; the best side of each position, if that makes a tree, can't be bettered
    a, b = ([int(x[1][0] > x[0][0]) for x in found] for found in (words, nodes))
    depth = 0
    for i in range(n):
        depth -= a[i]
        if depth < 0 or (i + 1 < n and b[i] and not depth):
            depth = -1
            break
        depth += i + 1 < n and not b[i]
    if depth != 0:
        w, g = (np.array([[s for s, _ in x] for x in found], np.float64).reshape(-1, 2) for found in (words, nodes))
        total, back = np.array([0.0]), []
        for i in range(n - 1):  # from each depth by (word, gap): ll up, lr and rl level, rr down; no deeper than the words left can close
            top = min(i + 1, n - 1 - i)
            grid = np.full((4, top + 1), -np.inf)
            for way, (x, y) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                low, move = x + y if x and y else max(x, y), 1 - x - y
                part = total[low : max(low, top - move + 1)]
                grid[way, low + move : low + move + len(part)] = part + (w[i, x] + g[i, y])
            back.append(grid.argmax(axis=0).astype(np.int8))
            total = grid.max(axis=0)
        ends = [total[d] + w[n - 1, d] if d < len(total) else -np.inf for d in (0, 1)]
        depth = a[n - 1] = int(ends[1] > ends[0])
        if ends[depth] == -np.inf:
            return None
        for i in range(n - 2, -1, -1):
            a[i], b[i] = divmod(int(back[i][depth]), 2)
            depth -= 1 - a[i] - b[i]
    tags = [x[s][1] for x, s in zip(words, a, strict=True)], [x[s][1] for x, s in zip(nodes, b, strict=True)]
    if None in tags[0] or None in tags[1]:
        return None
    edges, root, _ = tree_of(*tags)
    return edges, [root]


def tags_of(heads: list[int], labels: list[str]) -> tuple[list[str], list[str]] | None:
    """(words' tags, gaps' tags) of a tree in which heads[i] is -1 for the root; none if it isn't one projective tree."""
    n = len(heads)
    below, root = [[] for _ in range(n)], [i for i, h in enumerate(heads) if h == -1]
    if len(root) != 1 or any(not -1 <= h < n or h == i for i, h in enumerate(heads)):
        return None
    for i, h in enumerate(heads):
        if h >= 0:
            below[h].append(i)
    order, todo = [], root[:]
    while todo:
        order.append(i := todo.pop())
        todo += below[i]
    if len(order) < n:
        return None  # a cycle
    first, last = list(range(n)), list(range(n))
    for i in reversed(order):
        spans = sorted((first[j], last[j]) for j in below[i]) + [(i, i)]
        spans.sort()
        if any(a[1] + 1 != b[0] for a, b in zip(spans, spans[1:], strict=False)):
            return None  # not projective
        first[i], last[i] = spans[0][0], spans[-1][1]
    term, gaps = [""] * n, ["eos"] * n
    for i in order:
        # the nodes over i, from the inside: left modifiers from the nearest on, then right ones
        mods = [*sorted((j for j in below[i] if j < i), reverse=True), *(j for j in sorted(below[i]) if j > i)]
        if heads[i] == -1:
            outer = "nl"
        else:
            outer = "nl" if i < heads[i] else "nr"
        sides = [*("nr" if j < i else "nl" for j in mods), outer]  # of i, then of each node: which child it is of the next
        term[i] = f"t{sides[0][1]}-{labels[i]}"
        for j, side in zip(mods, sides[1:], strict=True):
            gaps[last[j] if j < i else first[j] - 1] = f"{side}-{'R' if j < i else 'L'}"
    return term, gaps


def hexatags(trees: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, nonterm) of (keys, heads: array<int>, labels: array<string>); both null where a sentence is null or no projective tree."""
    shape = StructType([*trees.select(*keys).schema.fields, *StructType.fromDDL("term array<string>, nonterm array<string>").fields])
    kinds = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory
                part = b.slice(at, 256)
                pairs = zip(part.column("heads").to_pylist(), part.column("labels").to_pylist(), strict=True)
                found = [tags_of(h, l) if h and l and len(h) == len(l) and None not in h else None for h, l in pairs]
                made = [pa.array([f and f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *made], schema=kinds)

    return trees.select(*keys, "heads", "labels").mapInArrow(run, shape)


def decoded(scored: DataFrame, *keys: str, k: int | None = 25) -> DataFrame:
    """(keys, edges, roots) of (keys, term, nonterm), arrays of a position's arrays of (label, score); null where none of the k best is a tree, or, without k, where no tags make one."""
    shape = StructType([*scored.select(*keys).schema.fields]).add("edges", ArrayType(EDGE)).add("roots", ArrayType(IntegerType()))
    kinds = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda s: [[(x["label"], x["score"]) for x in column] for column in s or ()]
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory
                part = b.slice(at, 256)
                found = [likeliest(plain(t), plain(g)) if k is None else decode(plain(t), plain(g), k) for t, g in zip(part.column("term").to_pylist(), part.column("nonterm").to_pylist(), strict=True)]
                edges = [f and [{"source": h, "destination": w, "relation": r} for h, w, r in f[0]] for f in found]
                made = [pa.array(edges, kinds.field("edges").type), pa.array([f and f[1] for f in found], kinds.field("roots").type)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *made], schema=kinds)

    return scored.select(*keys, "term", "nonterm").mapInArrow(run, shape)
