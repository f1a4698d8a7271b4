"""Labels of long sentences in linear time."""

import random
import time

from pyspark.sql import functions as F

from glossa.operators import lexicon


def test_cleared_before_over_a_long_sentence(spark):
    """Work grows with a sentence's tokens, not with their square."""
    n = 60_000
    tokens = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("tok"), F.when(F.col("id") == n - 1, "B-LOC").otherwise("B-LENGTH").alias("entity"))
    began = time.perf_counter()
    got = lexicon.cleared_before(tokens, "k", cleared="LENGTH$", before="B-LOC").groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in got} == {"O": n - 1, "B-LOC": 1}
    assert time.perf_counter() - began < 20


def test_bio_is_linear_and_keeps_odd_spans(spark):
    """Spans in order cost no look at each token; others give what a look at each token gives."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        n = rng.randint(1, 12)
        spans = [(a, a + rng.randint(0, 4), rng.choice(["X", "Y", None])) for a in (rng.randint(0, n + 1) for _ in range(rng.randint(0, 4)))]
        rows.append((k, n, sorted(spans, key=str) if k % 3 else spans))
    df = spark.createDataFrame(rows, "k int, n int, spans array<struct<start: int, end: int, label: string>>")

    def plain(n, spans):
        first = [next((s for s in spans if s[0] <= i < s[1]), None) for i in range(n)]
        return ["O" if s is None or s[2] is None else ("B-" if s[0] == i else "I-") + s[2] for i, s in enumerate(first)]

    got = {r.k: r.l for r in df.select("k", lexicon.bio(F.col("n"), F.col("spans")).alias("l")).collect()}
    assert got == {k: plain(n, spans) for k, n, spans in rows}
    long = spark.range(1).select(F.expr("transform(sequence(0, 29999), i -> named_struct('start', 2 * i, 'end', 2 * i + 1, 'label', 'X'))").alias("s"))
    began = time.perf_counter()
    assert long.select(F.expr("1") + F.size(lexicon.bio(F.lit(60_000), F.col("s")))).first()[0] == 60_001
    assert time.perf_counter() - began < 20


def test_matches_with_and_without_first_words(spark, monkeypatch):
    """N-grams that begin at no entry's first word are left out before they are made; the matches stay the same."""
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "A", "b", "c d", "", "É"])
    rows = spark.createDataFrame([(k, [word() for _ in range(rng.randint(0, 9))]) for k in range(200)], "k int, words array<string>")
    entries = spark.createDataFrame([("a", "X", 0), ("a b", "Y", 1), ("é a A", "Z", 0), ("c d", "W", 2), (" a", "V", 0), ("a", "U", 1)], "phrase string, label string, rank int")
    few = sorted(map(tuple, lexicon.matches(rows, entries, "k").collect()))
    monkeypatch.setattr(lexicon, "FIRST_WORDS", 0)
    assert few and few == sorted(map(tuple, lexicon.matches(rows, entries, "k").collect()))
