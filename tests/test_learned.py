"""Taggers, rankers, selections and resampling against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import graphs, learning, ranking, stats, tagging


def test_tagger_decodes_greedily_and_learns(spark):
    rng = random.Random(3)
    rows = []
    for s in range(60):
        before = "O"
        for t in range(rng.randint(1, 9)):
            word = rng.choice(["Ab", "Cd", "ef", "gh"])
            label = "O" if word.islower() else "I" if before != "O" else "B"
            before = label
            rows.append((s, t, label, [word, "x"] if rng.random() < 0.9 else None if word.islower() else [word]))
    tokens = spark.createDataFrame(rows, "s int, tok int, label string, features array<string>")
    tagger = tagging.train(tokens, ["s"], order=2, size=64)
    got = {(r["s"], r["tok"]): r["prediction"] for r in tagging.tag(tokens, ["s"], tagger).collect()}
    assert np.mean([got[s, t] == label for s, t, label, _ in rows]) > 0.95
    # the same by a plain loop over the model's weights
    hashed = learning.HashingTF(numFeatures=64)
    w, b, tables = tagger.model.coefficientMatrix.toArray(), tagger.model.interceptVector.toArray(), tagging.history_weights(tagger)
    k = len(tagger.labels)
    for s in range(60):
        past = [k + 1, k + 1]
        for _, t, _, features in sorted(r for r in rows if r[0] == s):
            score = b.copy()
            for f in features or ():
                score += w[:, hashed.indexOf(f)]
            score += np.array(tables[0][past[1]]) + np.array(tables[1][past[0] * (k + 2) + past[1]])
            past = [past[1], int(score.argmax())]
            assert got[s, t] == tagger.labels[past[1]]
    with pytest.raises(ValueError):
        tagging.train(tokens.where("label = 'O'"), ["s"])


def test_pair_counts_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(q, float(rng.randint(0, 2)), rng.choice([0.0, 0.5, 1.0, rng.uniform(-2, 2)]), i) for q in range(6) for i in range(rng.randint(1, 14))]
    rows.append(rows[0])
    for margin in (1.0, 0.5):
        got = ranking.pair_counts(spark.createDataFrame(rows, "qid int, label double, score double, i int"), [0.0, 1.0, 2.0], margin)
        found = sorted((r["qid"], r["label"], r["score"], r["i"], r["pull"], round(r["loss"], 6)) for r in got.collect())
        expected = []
        for q, y, s, i in rows:
            same = [(b, t) for p, b, t, _ in rows if p == q]
            won, lost = [t for b, t in same if b < y and t > s - margin], [t for b, t in same if b > y and t < s + margin]
            expected.append((q, y, s, i, len(won) - len(lost), round(sum(t - s + margin for t in won), 6)))
        assert found == sorted(expected)


def test_ranking_learns(spark):
    rng = random.Random(2)
    rows = []
    for q in range(40):
        for _ in range(5):
            x, y = rng.random(), rng.random()
            rows.append((q, float(round(2 * x - y)), {0: x, 1: y}))
    df = spark.createDataFrame(rows, "qid int, label double, features map<int, double>")
    w = ranking.train(df, rounds=12)
    assert w[0] > 0 > w[1]
    assert stats.precision_at_1(ranking.scored(df, w), "qid", "label", "score").first()["p_at_1"] > 0.85


def test_forward_selection_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    y = 3 * x[:, 2] + x[:, 0] + 0.1 * rng.normal(size=200)
    rows = spark.createDataFrame([(*map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, y double, fold int")
    groups = {"a": ["a"], "bd": ["b", "d"], "c": ["c"]}
    got = learning.forward_selection(learning.fold_sums(rows, ["a", "b", "c", "d"], "y"), ["a", "b", "c", "d"], groups)

    def error(cols):
        e = 0.0
        for f in range(4):
            held = np.arange(200) % 4 == f
            m = np.column_stack([np.ones(200), *(x[:, "abcd".index(c)] for c in cols)])
            e += ((m[held] @ np.linalg.lstsq(m[~held], y[~held], rcond=None)[0] - y[held]) ** 2).sum()
        return e / 200

    assert [g for g, _ in got][:2] == ["c", "a"]
    assert got[0][1] == pytest.approx(error("c"), rel=1e-4) and got[1][1] == pytest.approx(error("ca"), rel=1e-4)


def test_resampling_is_exact(spark):
    gains = [(g,) for g in [1.0] * 30 + [-1.0] * 22 + [0.0] * 50 + [0.25] * 4]
    df = spark.createDataFrame(gains, "gain double")
    one = stats.bootstrap_gains(df, rounds=2000, cells=1).first()["p_value"]
    groups = sorted({g for (g,) in gains})
    n = np.array([gains.count((g,)) for g in groups])
    share = stats.resampled(np.array([len(gains)]), 2000, (7, 0))[:, 0]
    draw = np.random.default_rng((7, 1, 0))
    sums = np.concatenate([draw.multinomial(share[i : i + 256], n / n.sum()) @ np.array(groups) for i in range(0, 2000, 256)])
    assert one == pytest.approx((sums <= 1e-9).mean())
    assert stats.bootstrap_gains(df, rounds=2000, cells=3).first()["p_value"] == pytest.approx(one, abs=0.04)
    assert stats.bootstrap_gains(df.where("gain > 9"), rounds=10).first()["p_value"] == 1.0


def test_paths_and_roots(spark):
    rng = random.Random(6)
    edges = [(k, *rng.sample(range(8), 2), rng.choice("xy")) for k in range(6) for _ in range(9)]
    e = spark.createDataFrame(edges, "k int, src int, dst int, rel string")
    nodes = spark.createDataFrame([(k, n) for k in range(6) for n in range(8)], "k int, node int")
    ahead = {(k, n): {b for q, a, b, _ in edges if q == k and a == n} for k in range(6) for n in range(8)}

    def reach(k, start):
        seen, front = {start}, {start}
        while front:
            front = {b for n in front for b in ahead[k, n]} - seen
            seen |= front
        return seen

    expected = []
    for k in range(6):
        own = [n for n in range(8) if not any(n in ahead[k, m] for m in range(8))]
        seen = {x for n in own for x in reach(k, n)}
        for n in range(8):
            if n not in seen:
                own.append(n)
                seen |= reach(k, n)
        expected += [(k, n) for n in own]
    assert sorted(map(tuple, graphs.all_roots(nodes, e, ["k"]).collect())) == sorted(expected)
    pairs = spark.createDataFrame([(k, 0, n) for k in range(6) for n in range(8)], "k int, start int, end int")
    found = graphs.edge_paths(pairs, e, ["k"]).collect()
    for k in range(6):
        for n in range(1, 8):
            path = sorted({(r["step"], r["src"], r["dst"]) for r in found if (r["k"], r["end"]) == (k, n)})
            if n not in reach(k, 0):
                assert path == []
                continue
            assert [s for s, *_ in path] == list(range(len(path))) and path[0][1] == 0 and path[-1][2] == n and all(a[2] == b[1] for a, b in zip(path, path[1:]))
            steps, front = 0, {0}
            while n not in front:
                front, steps = {b for m in front for b in ahead[k, m]}, steps + 1
            assert len(path) == steps
    assert all(r["mark"] == ">" for r in found)
