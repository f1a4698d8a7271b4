"""What the third round's findings on work in one task, on repeated work and on closures ask for."""

import random

from pyspark.sql import functions as F

from glossa import queries
from glossa.plans.rules import extract


def test_documents_of_one_row_group_meet_several_tasks(spark, tmp_path):
    """The heavy work on a file of one row group is dealt to several tasks."""
    rows = [(i, "the station of a nation was in motion . " * 3) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.one_sentence(spark, str(tmp_path)), queries.tokenised_sentences(spark, str(tmp_path))):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert found.count() == found.select("doc_id").distinct().count() == 200


def test_closures_in_graphs_with_circles_like_the_kernel(spark):
    """rounds that look among their group's tokens only find the same tokens, in circles and long chains too."""
    grammar = r"""
    - {name: target, label: Target, type: token, priority: 1, pattern: "[word=/^t/]"}
    - name: event
      label: Event
      priority: 2
      pattern: |
        trigger = [word=/^o/]
        theme:Target = next+
    """
    rng = random.Random(7)
    rows = []
    for i in range(12):
        n = rng.choice([1, 2, 5, 17, 60])
        words = [rng.choice(["o", "t1", "t2", "x"]) for _ in range(n)]
        edges = [(a, a + 1, "next") for a in range(n - 1) if rng.random() < 0.95]
        edges += [(rng.randrange(n), rng.randrange(n), "next") for _ in range(n // 4)]
        rows.append((i, [(words, {"universal-enhanced": edges})]))
    shape = "doc_id long, sentences array<struct<words: array<string>, graphs: map<string, array<struct<source: int, destination: int, relation: string>>>>>"
    docs = spark.createDataFrame(rows, shape)
    told = [sorted(map(str, extract(docs, grammar, ["doc_id"], native=native).collect())) for native in (True, False)]
    assert told[0] == told[1] and len(told[0]) > 100


def test_tokens_of_chunks_like_those_of_whole_texts():
    """Tokens that are remembered by chunk are those of the lexer over the whole text."""
    from glossa.functions import tokenizer as t

    rng = random.Random(25)
    parts = ["won't", "Non-profit", '"', "x.5", "The", "a.b@c.de", "<b", "c>", "straße.", ":-)", "8)", "…", "e.g.", "\x1c", "　x", "l'eau", "del", "pelos", "(ab)", "1,000.5", "end...", "''", "\r", "&lt;x@y", "http://a.b/c?", "of,;", "no!"]
    for lang in ("en", "es", "pt"):
        t.tokenise("", lang)
        for _ in range(400):
            text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\t", "", " \x85"]) for _ in range(rng.randrange(30)))
            assert t._tokens(text, lang) == t._finished(text, lang)[0]
    found = {}
    real, t.lex = t.lex, lambda text, pattern: found.setdefault("asked", []).append(text) or real(text, pattern)
    try:
        t.tokenise("don't ask twice don't", "en")
    finally:
        t.lex = real
    assert found.get("asked", []).count("don't") <= 1 and len("".join(found.get("asked", []))) < 20


def test_columns_to_python_like_to_pylist():
    """Sentences reach the kernel as they were, nulls and empty ones too."""
    import pyarrow as pa

    from glossa.plans.rules import _plain

    rows = [[{"words": ["a", None, "b"], "starts": [0, 1, 2], "tags": None, "n": 1}, None, {"words": [], "starts": None, "tags": ["x"], "n": None}], None, [], [{"words": None, "starts": [None, 3], "tags": [], "n": 5}]]
    kind = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("tags", pa.list_(pa.string())), ("n", pa.int64())]))
    column = pa.array(rows, kind)
    assert _plain(column) == rows and _plain(column.slice(1, 3)) == rows[1:] and _plain(column.slice(2, 1)) == [[]]
    assert _plain(pa.array([], kind)) == []


def test_rules_without_edges_take_no_graphs_along(spark):
    """the kernel of a rule that reads no edges gets words, not the edges of each token."""
    docs = spark.createDataFrame([(1, "the end . the")], "doc_id long, text string").select("doc_id", F.split("text", " ").alias("words"))
    edges = F.expr("transform(slice(words, 2, size(words)), (w, i) -> named_struct('source', i, 'destination', i + 1, 'relation', 'next'))")
    docs = docs.withColumn("sentences", F.array(F.struct("words", F.create_map(F.lit("universal-enhanced"), edges).alias("graphs"))))
    grammar = r"""[{name: a, label: A, type: token, priority: 1, pattern: "^ [simScore(\"the\") > 0.5 | word=and]"}]"""
    found = extract(docs, grammar, ["doc_id"])
    assert [(r.start, r.end) for r in found.collect()] == [(0, 1)]
    assert "graphs" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_is_normed_once(spark):
    """rows of equal texts share one recognition; null and empty texts and repeated rows stay."""
    from glossa.functions import numbers

    said = ["5 May 2020", "12 km", "5 May 2020", "", None, "nothing here"] * 30
    rows = spark.createDataFrame(list(enumerate(said)), "id long, said string")
    found = numbers.with_norms(rows, "said")
    got = {r.id: [(x.label, x.norm) for x in r.norms] for r in found.collect()}
    plain = {r.id: [(x.label, x.norm) for x in r.norms] for r in rows.select("id", numbers.norms_of("said").alias("norms")).collect()}
    assert got == plain and len(got) == 180 and got[0] and not got[4]
    plan = found.select("id", F.inline("norms"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "norms_of" not in plan and "Aggregate [" in plan.split("MapInPandas")[-1]
