"""What the stages of the pipeline do to whole tables, against plain Python."""

import random
from collections import Counter

import pytest

from glossa.llm import bpe, mixing, simhash


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_stage_links_by_jaccard(spark):
    """Near copies at 0.8 to 0.95 go, those below stay, whatever their fingerprints."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, gone, apart = [], set(), 0
    for i in range(60):
        first = [word() for _ in range(200)]
        changed, low, high = list(first), *((0.8, 0.96) if i % 3 else (0.6, 0.8))
        goal = rng.uniform(low, high)
        while jaccard(" ".join(first), " ".join(changed)) > goal:
            before = list(changed)
            changed[rng.randrange(200)] = word()
        changed = before if i % 3 else changed
        a, b = " ".join(first), " ".join(changed)
        docs += [(2 * i, a), (2 * i + 1, b)]
        apart += (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 4
        if jaccard(a, b) >= 0.8:
            gone.add(2 * i + 1)
    assert len(gone) == 40 and apart > 30
    kept = {r.doc_id for r in simhash.near_duplicate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert {i for i, _ in docs} - kept == gone


def test_stage_joins_a_chain(spark):
    """A class holds what a chain of links joins, and exact copies of its members."""
    rng = random.Random(12)
    text = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    docs = []
    for i in range(40):
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text).upper())]
        text[rng.randrange(120)] = f"changed{i}"
    assert [r.doc_id for r in simhash.near_duplicate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()] == [0]


def held_to_targets(got, weights):
    total, taken = sum(weights.values()), Counter()
    slots = {r.slot: r.source for r in got}
    last = min(max(r.slot for r in got if r.source == s) for s in weights)
    for t in range(last + 1):
        taken[slots[t]] += 1
        assert all(abs(taken[s] - (t + 1) * w / total) < 2 for s, w in weights.items())  # one block by order, one by rounding
    return last


def test_mixing_holds_the_target_weights(spark):
    """Over many slots, and with over 256 unequal sources, shares are those of the weights."""
    hot = {"hot": 18_100.0} | {f"s{i:02}": 1_000.0 for i in range(20)}
    many = {"hot": 300.0} | {f"s{i:03}": 1.0 + i % 4 for i in range(300)}
    for weights, rows in ((hot, lambda w: int(w / 4)), (many, lambda w: int(8 * w))):
        docs = [(i, s) for i, s in enumerate(s for s, w in weights.items() for _ in range(rows(w)))]
        docs = spark.createDataFrame(docs, "doc_id long, source string")
        given = spark.createDataFrame(list(weights.items()), "source string, weight double")
        got = mixing.mix(docs, given, block_rows=4, quanta=None).collect()
        assert len(got) == docs.count() and len({(r.slot, r.place) for r in got}) == len(got)
        assert all(r.release <= r.slot < r.deadline for r in got)
        assert held_to_targets(got, weights) > 1000


def test_run_returns_the_mixed_position(spark, tmp_path):
    """The last stage numbers the rows in the order of the schedule, however Spark packs the files."""
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i * i % 7 % 4}") for i in range(700)], "doc_id long, text string, source string")
    keys = docs.select("doc_id", "source")
    placed = mixing.mix(keys, mixing.tempered(keys), quanta=None).collect()
    expected = [r.doc_id for r in sorted(placed, key=lambda r: (r.slot, r.place))]
    mixing.mixing_stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    got = bpe.bpe_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert sorted(r.position for r in got) == list(range(700))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == expected
