"""Collocations, decontamination and the prefix trie against plain Python, and their defined results for odd input."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import collocations, decontaminate, prefixtrie

DOCS = "doc_id long, text string, lang string"
CLASH = ("c", "t", "a", "b", "row", "words", "items", "n_words", "spans", "phrase", "f", "m", "depth", "z1", "len", "cell", "turn_", "share", "rank")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


# --- phrases


def phrases(docs, least=10, longest=3, percent=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        inside = any(len(x) > len(w) and g == lang and any(x[i : i + len(w)] == w for i in range(len(x))) and 100 * b >= percent * a for (g, x), b in found.items())
        if not inside:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(2)
    vocabulary = ["New", "york", "city", "the", "of", "é", "a.b", "x", "\x00y", "bar "]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "fr", None])) for i in range(80)]
    return [*docs, docs[3], (900, None, "en"), (901, "", "de"), (None, "new york city " * 40, None), (902, "one long piece " * 30_000, "long")]


def test_phrases_equal_plain_python(spark, prose):
    assert sorted(map(tuple, collocations.collocations(clashing(spark.createDataFrame(prose, DOCS))).collect())) == phrases(prose)


def test_small_sketch_loses_nothing(spark, prose):
    few = collocations.collocations(spark.createDataFrame(prose, DOCS), top=7, most_cells=1 << 6)
    assert sorted(map(tuple, few.collect())) == phrases(prose, top=7)


def test_chunks_count_each_phrase_once():
    data = b"a b c d. a b\nc d e f " * 50
    whole = Counter()
    for size in (1, 7, 40, 10_000):
        found = Counter()
        for c in collocations.chunks("en", data.translate(collocations.BYTES), 3, size):
            for m, (key, count) in enumerate(c.grams, 1):
                for *ids, n in zip(*c.numbers(m, key), count, strict=True):
                    found[tuple(c.words[i] for i in ids)] += int(n)
        whole = whole or found
        assert found == whole


def test_sketch_never_tells_less(spark):
    docs = [(i, "p q r " * (i % 4) + f"w{i}", "en") for i in range(40)]
    counts = {(r["m"], r["phrase"]): r["f"] for r in collocations.frequent(spark.createDataFrame(docs, DOCS), least=20).collect()}
    assert counts[1, "p"] == 60 and counts[3, "p q r"] == 60 and counts[2, "r p"] == 30 and not any("w" in p for _, p in counts)


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], DOCS)).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent(spark.createDataFrame([], DOCS), longest=4)


# --- benchmark


def leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    of = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in of}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in of:
                    hit.update(range(k, k + m))
                    found |= of[tuple(w[k : k + m])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), ids))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice(["", "1", "É", "-x"]) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)]
    items = [(i, t if len(t.split()) > 2 else t + " qq zz") for i, t in items]
    items += [(100, items[0][1]), (100, items[0][1]), (None, "null id item has eleven words in it so it is long"), (101, None), (102, ""), (103, "?!"), (104, "Solo")]
    docs = [(i, prose(rng.randint(0, 50)) + " " + (rng.choice(items)[1] or "").upper() + "! " + prose(rng.randint(0, 5))) for i in range(60)]
    docs += [docs[0], (None, items[3][1]), (70, None), (71, ""), (72, "?"), (73, "solo " * 5), (74, prose(40_000) + " " + items[5][1]), (75, "null id item has eleven words in it so it is long")]
    return docs, items


@pytest.mark.parametrize(("block_words", "piece"), [(10**6, 4 << 20), (30, 4 << 20), (30, 50)])
def test_leaks_equal_plain_python(spark, texts, block_words, piece):
    docs, items = texts
    d, i = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string"))
    paths = decontaminate.write_blocks(spark, decontaminate.windows(i), f"{decontaminate.shared_dir(spark)}/test-{uuid.uuid4().hex}", block_words)
    assert (len(paths) > 2) == (block_words < 100)
    got = decontaminate.searched(d, paths, ["doc_id", "words"], portion=2000, piece=piece).select("row.doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]), "items")
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(leaks(docs, items), key=key)


def test_no_leaks(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = none.withColumnRenamed("doc_id", "item_id")
    assert decontaminate.contamination(none, items, ["doc_id"]).collect() == []
    assert [(r["n_words"], r["spans"], r["items"]) for r in decontaminate.contamination(one, items, ["doc_id"]).collect()] == [(2, [], [])]


# --- conversations

TURNS = "conv_id long, turn long, role string, text string"


def nodes(rows):
    convs = defaultdict(list)
    for i, (c, turn, role, text) in enumerate(rows):
        if c is not None:
            convs[c].append(((turn is not None, turn or 0, i), (role or "", text or "")))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(convs.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)

    def under(p):
        return [q for q in members if q[: len(p)] == p]

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in under(p)), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under(p) if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows):
    made = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(clashing(spark.createDataFrame(rows, TURNS)))))
    return sorted(map(tuple, made.collect()), key=lambda r: r[:2])


def talks(seed, n, depth, kinds=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice("xy"[:kinds]) * rng.randint(1, 2)) for c in (rng.sample(range(-150, 400), n)) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_plain_python(spark, seed):
    rows = talks(seed, 70, 8)
    assert trie(spark, rows) == nodes(rows)


def test_segments_and_unary_edges(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SEGMENT", 3)
    rows = talks(5, 60, 14, 1) + [(c, t, "u", "😀" if t < 9 else str(c % 3)) for c in range(1000, 1020) for t in range(12)]
    assert trie(spark, rows) == nodes(rows)


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 5, None, "z" * 300_000), (2, 1, "u", "one"), (2, 1, "u", "one"), (100, 0, "u", "only"), (107, 3, "u", "a"), (None, 1, "u", "lost"), (-5, -2, "u", "early"), (-5, 0, "u", "late")]
    rows += [(c, t, "u", "same") for c in range(500, 540) for t in range(3)]
    assert trie(spark, rows) == nodes(rows)
    assert trie(spark, []) == []
    one = trie(spark, [(7, 0, "u", "a")])  # its turn is one of the first that conversation 0 would give
    assert one == nodes([(7, 0, "u", "a")])


def test_many_ends_are_digested_in_pieces(spark):
    ends = spark.range(150_000).select(F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("z1"), F.lit(2).cast("long").alias("z2"), F.col("id").alias("c"))
    assert prefixtrie.digests(ends).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, range(150_000))).encode()).hexdigest()
