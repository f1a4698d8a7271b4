"""Token rules as Catalyst expressions against the kernel."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.plans.rules import extract

LAYERS = "id long, sentences array<struct<words: array<string>, tags: array<string>, raw: array<string>, starts: array<int>, ends: array<int>>>"
PATTERNS = [
    "[word=a] [word=b]", "a b?", "[word=/^[ab]/ & !word=b]+", "[word=a | word=/c$/]{2,}", "[word=a]{1,2}? b", "(a b | a)", "(a | a b) c?", "[]{2}", "(?<=[word=a]) b (?!c)", "(?<![word=a]) [tag=/^X/]",
    "^ [] [tag=Y]", "[tag=X] $", "(a b){2} | c", "[!(word=a | word=b)]+", "(?<=a b?) c", "\"a\" [tag=X & !word=/[bc]/]*", "[word=é]+", "a* b", "a*? b", "(?=b) [] a",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        sentences = []
        for _ in range(rng.randint(0, 4)):
            w = [rng.choice(["a", "b", "c", "ab", "é", "a.c"]) for _ in range(rng.randint(0, 12))]
            starts = [3 * j + rng.randint(0, 1) for j in range(len(w))]
            sentences.append((w, [rng.choice("XYZ") for _ in w], w, starts, [s + 1 for s in starts]))
        rows.append((i, sentences or None))
    rows.append((900, [(None, None, None, None, None), ([], [], [], [], [])]))
    return spark.createDataFrame(rows, LAYERS)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_native_equals_kernel(docs, pattern):
    grammar = "[{name: r, label: [L, M], type: token, priority: 1, pattern: '%s'}]" % pattern.replace("'", "''")
    assert sorted(map(str, extract(docs, grammar, ["id"]).collect())) == sorted(map(str, extract(docs, grammar, ["id"], native=False).collect()))
    assert "MapInArrow" not in extract(docs, grammar, ["id"])._jdf.queryExecution().toString()  # none of these needs the kernel


@pytest.mark.parametrize("pattern", ["[simScore(\"a\") > 0.5]", "(a b)+", "(?<=a+) b", "[lemma=a]", " ".join("abcdefghi")])
def test_left_to_the_kernel(docs, pattern):
    df = extract(docs, f"[{{name: r, label: L, type: token, priority: 1, pattern: '{pattern}'}}]", ["id"])
    assert "MapInArrow" in df._jdf.queryExecution().toString()


def test_native_plan_has_no_python(docs):
    plan = extract(docs, "[{name: r, label: L, type: token, priority: 1, pattern: 'a b'}]", ["id"])._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_null_words_and_graphs(spark):
    df = spark.range(1).select("id", F.expr("array(named_struct('words', cast(null as array<string>)))").alias("sentences"))
    for native in (True, False):
        assert extract(df, "[{name: r, label: L, type: token, priority: 1, pattern: 'a'}]", ["id"], native=native).count() == 0
