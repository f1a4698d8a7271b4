"""Grammars as expressions over nested tables against the kernel."""

import random

import pytest

from glossa.plans.rules import extract

LAYERS = "id long, sentences array<struct<words: array<string>, tags: array<string>, raw: array<string>, starts: array<int>, ends: array<int>, graphs: map<string, array<struct<source: int, destination: int, relation: string>>>>>"
GRAPH = "universal-enhanced"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(90):
        sentences = []
        for _ in range(rng.randint(0, 3)):
            n = rng.randint(0, 9)
            w = [rng.choice(["a", "b", "c", "d", "ab"]) for _ in range(n)]
            edges = [(rng.randrange(n), rng.randrange(n), rng.choice(["x", "y", "xy", "z:z"])) for _ in range(rng.randint(0, 2 * n))] if n else []
            graphs = rng.choice([{GRAPH: edges}, {GRAPH: edges, "stanford-basic": edges[::2]}, {GRAPH: edges + edges[:2]}])
            sentences.append((w, [rng.choice("XYZ") for _ in w], w, [3 * j for j in range(n)], [3 * j + 2 for j in range(n)], graphs if rng.random() < 0.9 else None))
        rows.append((i, sentences or None))
    rows += [(900, [(None, None, None, None, None, None), ([], [], [], [], [], {})]), (900, [(["a", "b"], ["X", "X"], None, None, None, {GRAPH: [(0, 1, "x"), (1, 1, "y")]})])]
    return spark.createDataFrame(rows, LAYERS)


def told(df):
    return sorted(str((r["id"], r["mention_id"], r["kind"], list(r["labels"]), r["sent"], r["start"], r["end"], r["text"], r["trigger_id"], r["found_by"], sorted(map(tuple, r["args"])))) for r in df.collect())


def same(docs, grammar):
    df = extract(docs, grammar, ["id"])
    assert "MapInArrow" not in df._jdf.queryExecution().toString(), grammar
    got = told(df)
    assert got == told(extract(docs, grammar, ["id"], native=False)), grammar
    return got


SEEDS = """
- {name: p, label: P, type: token, priority: 1, pattern: "a"}
- {name: q, label: [Q, R], type: token, priority: 1, pattern: "b [word=/^[abc]/]?"}
- {name: s, label: R, type: token, priority: 1, pattern: "c"}
"""

TOKEN = [
    "(?<x> a) b", "(?<x> [word=a] | [word=b] c) d?", "(?<trigger> b) (?<x> [])", "a (?<x> b)? (?<y> [] [])", "(?<x> a (?<y> b?) [])", "((?<x> a) | (?<y> b)) (?<x> c)?",
    "(?<trigger> a)? (?<x> b)", "(?<!a) (?<x> b+) (?<y> [])", "@P b", "@x:P [] (?<y> [])", "@Q @P", "@x:R @y:P", "@R [] [tag=X]", "[mention=P] [mention=/^[QR]/ & tag=X]", "[incoming=x & !outgoing=/y/]", "@x:P (?<trigger> a | b)",
    "[outgoing=z:z] (?<x> [incoming=/x/])", "(?<x> (?<x> a) [])",
]

GRAPHS = [
    "trigger = a\n x:R = x", "trigger = a\n x:R = >x", "trigger = b\n x:R = <x", "trigger = a b\n x:R = >>", "trigger = [tag=X]\n x:R = << y", "trigger = a\n x:R = x y | y x", "trigger = a\n x:R = x? y", "trigger = a\n x:R = /^x/*",
    "trigger = a\n x:R = x+", "trigger = a\n x:R = (x | <y)+", "trigger = a\n x:R = x{2}", "trigger = a\n x:R = /x|y/{1,3}", "trigger = a\n x:R = x [tag=X]", "trigger = a\n x:R = (?= y) x", "trigger = a\n x:R = (?! y x) >>", "trigger = a\n x:R? = x\n y:P = y",
    "trigger = a\n x:R = >>\n y:P = >>", "trigger = a\n x:R* = >>\n y:P? = x", "trigger = a\n x:R+ = >> >>?", "trigger = a\n x:R{2} = >>+", "trigger = a\n x:R{,2} = >>+", "trigger = a\n x:R{1,2} = >>+", "trigger = a\n x:R{2,} = >>+", "trigger = P\n x:Q = >>",
    "trigger = R\n x:P = <<", "root = P\n x:R = >>", "root = R\n x:P? = /z/ \n y:R = >>", "trigger = (?<n> a) b?\n x:R = 'z:z'", "trigger = [mention=P]\n x:R = >> [mention=R]", "trigger = a\n x:Q? = y",
]


def token_rules(patterns):
    quoted = [p.replace("'", "''") for p in patterns]
    return "".join(f"- {{name: t{k}, label: T{k}, type: token, priority: 2, pattern: '{p}'}}\n" for k, p in enumerate(quoted))


def graph_rules(patterns):
    body = lambda p: "\n".join(f"    {line.strip()}" for line in p.split("\n"))
    return "".join(f"- name: e{k}\n  label: E{k}\n  priority: 2\n  pattern: |\n{body(p)}\n" for k, p in enumerate(patterns))


@pytest.mark.parametrize("first", range(0, len(TOKEN), 6))
def test_token_rules(docs, first):
    same(docs, SEEDS + token_rules(TOKEN[first : first + 6]))


@pytest.mark.parametrize("first", range(0, len(GRAPHS), 6))
def test_graph_rules(docs, first):
    same(docs, SEEDS + graph_rules(GRAPHS[first : first + 6]))


def test_edges_beyond_the_sentence_are_none(spark):
    df = spark.createDataFrame([(1, [(["a", "c"], None, None, None, None, {GRAPH: [(0, 1, "x"), (0, 7, "x"), (-1, 1, "x"), (5, 5, "y")]})])], LAYERS)
    assert sum("event" in m for m in told(extract(df, SEEDS + graph_rules(["trigger = a\n x:R = >>+"]), ["id"]))) == 1


def test_iterations(docs):
    chain = SEEDS + """
- {name: u, label: U, type: token, priority: "2-3", pattern: "@P []"}
- {name: v, label: V, type: token, pattern: "@x:U (?<trigger> [])", keep: no}
- {name: w, label: W, type: token, priority: "[2, 4]", pattern: "@V"}
- {name: u2, label: U, type: token, priority: 3, pattern: "[mention=P] [mention=/^R/]"}
- {name: late, label: P, type: token, priority: 5, pattern: "d"}
- name: g
  label: [G, H]
  graph: stanford-basic
  pattern: |
    trigger = U
    x:R = >>
"""
    assert any("W" in m for m in same(docs, chain))


def test_rules_that_feed_themselves(docs):
    grown = """
- {name: one, label: N, type: token, priority: 1, pattern: "a"}
- {name: more, label: N, type: token, priority: "2+", pattern: "@left:N b"}
- name: link
  label: N
  priority: 2+
  pattern: |
    trigger = c
    x:N = x+
"""
    assert any(m.count("left=R:N") for m in same(docs, grown))


def test_random_paths(docs):
    rng = random.Random(11)

    def path(depth):
        if depth == 0:
            return rng.choice(["x", "<y", ">>", "<<", "/x/", "[tag=X]", "[word=/a/]"])
        a, b = path(depth - 1), path(depth - 1)
        return rng.choice([f"{a} {b}", f"({a} | {b})", f"({a})?", f"({a})*", f"({a})+", f"(?= {a}) {b}", f"(?! {a}) {b}", f"({a}){{1,2}}"])

    for _ in range(2):
        marks = [(rng.choice(["", "?", "*", "+", "{2}", "{1,2}"]), rng.choice(["", "?"])) for _ in range(6)]
        same(docs, SEEDS + graph_rules([f"trigger = [word=/a|b/]\nx:R{m} = {path(2)}\ny:P{n} = {path(1)}" for m, n in marks]))


@pytest.mark.parametrize("pattern", ["(?<x> a)+ b", "[simScore(\"a\") > 0.5]", "(a b)+", "a @P", "@P+ b", "@x:Q.y a"])
def test_left_to_the_kernel(docs, pattern):
    df = extract(docs, SEEDS + f"- {{name: t, label: T, type: token, priority: 2, pattern: '{pattern}'}}", ["id"])
    assert "MapInArrow" in df._jdf.queryExecution().toString()


def test_clashing_keys(docs):
    df = docs.withColumnRenamed("id", "sent").withColumnRenamed("sent", "start")
    got = extract(df, "[{name: r, label: L, type: token, pattern: 'a b'}]", ["start"])
    assert got.count() == extract(docs, "[{name: r, label: L, type: token, pattern: 'a b'}]", ["id"]).count()
