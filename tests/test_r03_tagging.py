"""What training and ranking do with their rows."""

from pyspark.sql import functions as F

from glossa.operators import ranking, tagging


def test_training_in_both_directions_reads_the_tokens_once(spark):
    words = "Ann Lee met the big Bob Ray in old Rome".split()
    rows = [(s, i, "O" if w.islower() else "I" if i and not words[i - 1].islower() else "B", [f"s={w[0].isupper()}", f"w={w}"]) for s in range(30) for i, w in enumerate(words)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    shape = "s int, tok int, label string, features array<string>"
    tokens = spark.createDataFrame(rows, shape)
    taggers = tagging.train_both(tokens.mapInArrow(counted, shape), ["s"], order=2, folds=2, size=64, rounds=20)
    assert read.value == len(rows)
    got = tagging.tag_both(tokens, ["s"], taggers).collect()
    assert sorted((r["s"], r["tok"], r["prediction"]) for r in got) == sorted(r[:3] for r in rows)


def test_a_round_of_ranking_takes_one_shuffle(spark):
    rows = spark.range(200).select((F.col("id") % 9).alias("qid"), (F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 7 / 4).alias("score"))
    plan = ranking.pair_counts(rows, [0.0, 1.0, 2.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
