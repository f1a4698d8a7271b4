"""Findings of the third round, looked into last."""

from glossa.plans.rules import extract


def test_rounds_of_a_fixpoint_are_read_in_one_scan(spark):
    """a task of a union carried the metrics of all rounds to the driver."""
    grammar = r"""
    - {name: first, label: N, type: token, priority: 1, pattern: "[word=/^[A-Z]/]"}
    - {name: more, label: N, type: token, priority: "2+", pattern: "@left:N [word=/^d/]"}
    """
    texts = ["A d d d d d", "b d", "C d e D", ""]
    docs = spark.createDataFrame([(i, [{"words": t.split()}]) for i, t in enumerate(texts)], "doc_id long, sentences array<struct<words: array<string>>>")
    found = extract(docs, grammar, ["doc_id"])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.doc_id, r.start, r.end) for r in found.collect()) == [(0, 0, n) for n in range(1, 7)] + [(2, 0, 1), (2, 0, 2), (2, 3, 4)]


def test_ranking_lines_are_parsed_by_several_tasks(spark):
    """a file of one row group was one task."""
    from glossa.queries_tables import svmlight_round_trip
    from glossa.sources.columns import read_svmlight

    assert "RoundRobin" in svmlight_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = ["1 qid:3 1:0.5:9 7:2 # note # more", " # none", "", "-1\t2:1 x:5"]
    rows = read_svmlight(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [(1.0, "3", {1: 0.5, 7: 2.0}, "note # more"), (-1.0, None, {2: 1.0}, None)]


def shuffles(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_mentions_are_shuffled_once(spark):
    """mentions went through one shuffle to be told apart, and through another one to their lines."""
    from glossa.operators.mentions import to_lines

    grammar = '[{name: probe, label: Probe, type: token, priority: 1, pattern: "[word=/^t/] []"}]'
    docs = spark.createDataFrame([(1, [{"words": "t a t b".split()}])], "doc_id long, sentences array<struct<words: array<string>>>")
    found = extract(docs, grammar, ["doc_id"])
    lines = to_lines(found.union(found), "doc_id")
    assert len(shuffles(lines)) == 1
    assert [r.value.count('"id"') for r in lines.collect()] == [2]


def test_texts_are_shuffled_rather_than_words(spark):
    """the words of each document with their counts went through a shuffle."""
    from glossa.queries import counter_extremes

    (only,) = shuffles(counter_extremes(spark, "/root/testdata/sf0.001"))
    assert "doc_id" in only and "word" not in only


def test_trees_go_to_several_tasks_by_few_rows(spark):
    """a file of one row group was one task, and a worker held the trees of a whole Arrow batch at once."""
    from glossa.operators.parsing import hexatags
    from glossa.queries_trees import hexatags_decoded

    assert "RoundRobin" in hexatags_decoded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(i, [-1, 0], ["root", "x"]) for i in range(700)], "id long, heads array<int>, labels array<string>").coalesce(1)
    found = hexatags(rows, "id").collect()
    assert [r.id for r in found] == list(range(700)) and {(tuple(r.term), tuple(r.nonterm)) for r in found} == {(("tl-root", "tr-x"), ("nl-L", "eos"))}
