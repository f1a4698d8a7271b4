"""Searches within graphs against plain Python."""

import random

import numpy as np

from glossa.operators import graphs, searches


def plain(edges, start):
    depth, now = {start: 0}, [start]
    while now:
        now = sorted({b for a, b in edges if a in now} - set(depth))
        d = max(depth.values()) + 1
        depth |= {n: d for n in now}
    return depth


def random_graphs(rng, n):
    return {g: {(rng.randrange(12) * 7 - 5, rng.randrange(12) * 7 - 5) for _ in range(rng.randint(1, 16))} for g in range(n)}


def test_closure_in_one_shuffle(spark):
    """One shuffle, however many steps there are, and no rounds of jobs."""
    rng = random.Random(3)
    given = random_graphs(rng, 40) | {100: {(i, i + 1) for i in range(150)}}
    edges = spark.createDataFrame([(g, a, b, "r") for g, es in given.items() for a, b in es] + [(None, 2, 3, "r")], "g int, src int, dst int, rel string")
    starts = [(g, a) for g, es in given.items() for a in {a for a, _ in es}]
    front = spark.createDataFrame([(g, a, a) for g, a in starts] + [(None, 2, 2), (1, 99, 99)], "g int, start int, node int")
    got = graphs.closure(front, edges, ["g"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    expected = {(g, a, n, d) for g, a in starts for n, d in plain(given[g], a).items()} | {(None, 2, 2, 0), (1, 99, 99, 0)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert [t for _, t in got.dtypes] == ["int", "int", "int", "int"]
    assert {tuple(r) for r in graphs.closure(front, edges, ["g"], 2).collect()} == {r for r in expected if r[3] <= 2}


def test_blocks_of_starts(monkeypatch):
    """Few marks at a time give the same."""
    rng = random.Random(4)
    given = random_graphs(rng, 30)
    rows = [(g, 0, a, b) for g, es in given.items() for a, b in sorted(es)] + [(g, 1, a, a) for g, es in given.items() for a in sorted({a for a, _ in es})]
    graph, kind, a, b = (np.array(c) for c in zip(*sorted(rows), strict=True))
    for marks in (1, 30, 1 << 22):
        monkeypatch.setattr(searches, "MARKS", marks)
        got = {(int(g), int(s), int(n), int(d)) for of, v in searches.reached(None)(searches.Graphs(graph, kind, a, b)) for g, s, n, d in zip(of, *v, strict=True)}
        assert got == {(g, s, n, d) for g, k, s, _ in rows if k for n, d in plain(given[g], s).items()}


def test_tops_and_paths_in_one_shuffle(spark):
    rng = random.Random(5)
    given = random_graphs(rng, 60)
    edges = spark.createDataFrame([(g, a, b, "r") for g, es in given.items() for a, b in es], "g int, src int, dst int, rel string")
    nodes = {(g, n) for g, es in given.items() for e in es for n in e}
    found = graphs.all_roots(spark.createDataFrame(list(nodes), "g int, node int"), edges, ["g"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    expected = set()
    for g, n in nodes:
        above = {m for h, m in nodes if h == g and n in plain(given[g], m)}
        tops = {m for m in above if all(b != m for _, b in given[g])}
        if n in tops or (not tops and n == min(above)):
            expected.add((g, n))
    assert {tuple(r) for r in found.collect()} == expected
    pairs = [(g, a, b) for g, es in given.items() for a, _ in es for _, b in es]
    paths = graphs.edge_paths(spark.createDataFrame(pairs, "g int, start int, end int"), edges, ["g"]).groupBy("g", "start", "end").count().collect()
    assert {(r.g, r.start, r.end): r["count"] for r in paths} == {(g, a, b): d for g, a, b in set(pairs) if (d := plain(given[g], a).get(b))}
