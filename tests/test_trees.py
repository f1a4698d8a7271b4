"""Hexatags against random trees and brute force, lemmas, and mentions as JSON."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from glossa.functions.lemmas import lemma, with_lemmas
from glossa.functions.tokenizer import with_sentences
from glossa.operators import learning, lexicon, mentions, parsing
from glossa.sources import columns


def tree(rng, a, b):
    """Random projective heads of the words a to b - 1, and the one that has none among them."""
    h, heads = rng.randrange(a, b), {}
    for low, high in ((a, h), (h + 1, b)):
        while low < high:
            m = rng.randint(low + 1, high)
            below, top = tree(rng, low, m)
            heads |= below | {top: h}
            low = m
    return heads, h


def random_tree(rng, n):
    heads, root = tree(rng, 0, n)
    heads[root] = -1
    return [heads[i] for i in range(n)], [f"l{rng.randrange(4)}" for _ in range(n)]


def edges_of(heads, labels):
    return [(h, i, l) for i, (h, l) in enumerate(zip(heads, labels, strict=True)) if h >= 0]


def test_tags_and_back():
    rng = random.Random(3)
    for _ in range(500):
        heads, labels = random_tree(rng, rng.randint(1, 15))
        term, gaps = parsing.tags_of(heads, labels)
        assert parsing.tree_of(term, gaps) == (edges_of(heads, labels), heads.index(-1), labels[heads.index(-1)])
        assert gaps[-1] == "eos" and all(g[:2] in ("nl", "nr") for g in gaps[:-1])


def test_no_trees():
    for heads in ([], [0], [-1, -1], [1, 0, -1], [2, 3, -1, 2], [-1, 7]):
        assert parsing.tags_of(heads, ["x"] * len(heads)) is None
    for term, gaps in ((["tr-x", "tr-x"], ["nl-L", "eos"]), (["tl-x", "tl-x"], ["nl-L", "eos"]), (["tl-x", "tr-x"], ["nr-L", "eos"]), (["tl-x", "tr-x"], ["nl-Q", "eos"]), (["x", "tr-x"], ["nl-L", "eos"])):
        assert parsing.tree_of(term, gaps) is None


def test_paths_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        scores = [[(f"t{j}", rng.uniform(-2, 2)) for j in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        norm = [math.log(sum(math.exp(s) for _, s in c)) for c in scores]
        every = sorted(((sum(s - n for (_, s), n in zip(p, norm, strict=True)), [t for t, _ in p]) for p in itertools.product(*scores)), key=lambda x: -x[0])
        got = parsing.best_paths(scores, 7)
        assert [p for _, p in got] == [p for _, p in every[:7]]
        assert all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(got, every, strict=False))


def test_decoding_by_brute_force():
    """The best pair of all that is a tree, where k covers all paths."""
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 4)
        term = [[(t, rng.uniform(-2, 2)) for t in ("tl-a", "tr-a", "tr-b")] for _ in range(n)]
        gaps = [[(t, rng.uniform(-2, 2)) for t in ("nl-L", "nr-R", "nr-L")] for _ in range(n)]
        norm = lambda c: math.log(sum(math.exp(s) for _, s in c))
        first = [[x for x in term[0] if x[0][:2] == "tl"], *term[1:]], [[x for x in gaps[0] if n == 1 or x[0][:2] == "nl"], *gaps[1:]]
        best = None
        for a in itertools.product(*first[0]):
            for b in itertools.product(*first[1]):
                found = parsing.tree_of([t for t, _ in a], [t for t, _ in b])
                score = sum(s - norm(c) for (_, s), c in zip((*a, *b), (*first[0], *first[1]), strict=True))
                if found and (best is None or score > best[0] + 1e-12):
                    best = (score, found[0], [found[1]])
        assert parsing.decode(term, gaps, 10_000) == (best and best[1:])


def test_best_keeps_the_first_of_equals():
    b = parsing.Best(2)
    assert [b.insert(s, x) for s, x in ((1, "a"), (2, "b"), (1, "c"), (3, "d"), (0, "e"))] == [True, True, False, True, False]
    assert b.sorted() == [(3, "d"), (2, "b")]


def test_odd_sentences(spark):
    rows = spark.createDataFrame([(1, None, None), (2, [], []), (3, [-1], ["root"]), (4, [1, 0], ["a", "b"]), (5, [-1, 0], ["a"])], "id int, heads array<int>, labels array<string>")
    got = {r.id: (r.term, r.nonterm) for r in parsing.hexatags(rows, "id").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (["tl-root"], ["eos"]), 4: (None, None), 5: (None, None)}
    scored = spark.createDataFrame([(1, None, None), (2, [], []), (3, [[("tl-x", 1.0)]], [[("eos", 1.0)]])], "id int, term array<array<struct<label: string, score: float>>>, nonterm array<array<struct<label: string, score: float>>>")
    assert {r.id: (r.edges, r.roots) for r in parsing.decoded(scored, "id").collect()} == {1: (None, None), 2: (None, None), 3: ([], [0])}


@pytest.mark.parametrize(
    "word, expected",
    [("Houses", "house"), ("stopped", "stop"), ("running", "run"), ("making", "make"), ("cities", "city"), ("tried", "try"), ("boxes", "box"), ("glass", "glass"), ("classes", "class"), ("was", "be"), ("Children", "child"), ("related", "relate"), ("-LRB-", "-lrb-"), ("...", "..."), ("", ""), ("(cats)", "cat"), ("bus", "bus"), ("red", "red"), ("sing", "sing"), (None, None)],
)
def test_lemmas(spark, word, expected):
    assert spark.createDataFrame([(word,)], "w string").select(lemma(F.col("w"))).first()[0] == expected


def test_lemmas_are_filled_where_missing(spark):
    rows = spark.createDataFrame([([(["Cats", "ran"], None), (["Cats"], ["given"])],), (None,)], "s array<struct<words: array<string>, lemmas: array<string>>>")
    assert [r[0] and [x.lemmas for x in r[0]] for r in rows.select(with_lemmas(F.col("s"))).collect()] == [[["cat", "run"], ["given"]], None]


def test_mention_lines(spark):
    kind = "doc string, mention_id string, kind string, labels array<string>, sent int, start int, end int, text string, trigger_id string, found_by string, args array<struct<role: string, mention_id: string>>"
    rows = [('a"\\', "2", "event", ["E"], 0, 1, 2, 'x "y"', "3", "r", [("who", "1"), ("what", "3"), ("who", "4")]), ('a"\\', "1", "text", ["A", "B"], 0, 0, 1, "é\n", None, "r", [])]
    found = spark.createDataFrame([*rows, rows[1], ("b", "9", "text", ["A"], 1, 0, 1, None, None, "r", [])], kind)
    lines = {r.doc: r.value for r in mentions.to_lines(found, "doc").collect()}
    made = json.loads(lines['a"\\'])
    assert made["document"] == 'a"\\' and [m["id"] for m in made["mentions"]] == ["1", "2"] and made["mentions"][1]["arguments"] == {"what": ["3"], "who": ["1", "4"]}
    back = mentions.from_lines(spark.createDataFrame([(v,) for v in lines.values()], "value string")).collect()
    assert sorted((r.document, r.id, r.text, r.trigger) for r in back) == [('a"\\', "1", "é\n", None), ('a"\\', "2", 'x "y"', "3"), ("b", "9", None, None)]
    assert mentions.to_lines(found.where("false"), "doc").count() == 0


def test_models_of_models(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("label"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("x"))
    rows = learning.class_weights(rows.withColumn("features", array_to_vector("x")).withColumn("fold", F.col("id") % 3)).cache()
    fit = lambda r: learning.logistic(r, weight="weight")
    assert learning.cross_validated(rows, fit, 3).where("prediction <> label").count() == 0
    voted = learning.ensemble(rows, learning.bagged(rows, fit, 3), "id")
    assert voted.join(rows, "id").where("prediction <> label").count() == 0 and voted.count() == 300
    gains = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "f string, gain double")
    assert [r.f for r in learning.selected(gains, 2, "f").collect()] == ["c", "a"]


def test_overrides_without_overwriting(spark):
    standard = spark.createDataFrame([("a", "S", 0), ("b", "S", 0)], "phrase string, label string, rank int")
    over = spark.createDataFrame([("a", "O")], "phrase string, label string")
    got = lambda w: sorted(map(tuple, lexicon.overridden(standard, over, w).collect()))
    assert got(True) == [("a", "O", 0), ("b", "S", 1)] and got(False) == [("a", "O", 0), ("a", "S", 1), ("b", "S", 1)]


def test_graph_json_and_lines(spark):
    kind = "id int, sentences array<struct<words: array<string>, starts: array<int>, ends: array<int>, chunks: array<string>, graphs: map<string, array<struct<source: int, destination: int, relation: string>>>>>"
    rows = spark.createDataFrame([(1, [(['a"', None], [0, 3], [2, 4], None, {"universal-basic": [(1, 0, "x"), (0, 1, "y")]})]), (2, []), (3, None)], kind)
    made = {r.id: r.json and json.loads(r.json) for r in columns.graph_json(rows, "id").collect()}
    assert made == {1: [{"Tokens": [['a"', 0], [None, 1]], "Start_character_offsets": [0, 3], "End_character_offsets": [2, 4], "Basic_syntactic_dependencies": [[0, 1, "y"], [1, 0, "x"]]}], 2: [], 3: None}
    lines = [tuple(r) for r in columns.printed(rows, "id").orderBy("id", "line").collect()]
    assert lines == [(1, 0, "Sentence #0"), (1, 1, 'words: a" _'), (1, 2, "starts: 0 3"), (1, 3, "ends: 2 4")]


def test_refused_sentences_come_without_layers(spark):
    def annotate(layers):
        layers["tags"] = ["T"] * len(layers["words"])
        assert len(layers["words"]) < 4
        return layers

    rows = spark.createDataFrame([("Short one. This one is much too long.",)], "text string")
    assert [s.tags for s in with_sentences(rows, annotate=annotate).first().sentences] == [["T"] * 3, None]
