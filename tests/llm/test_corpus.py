"""The corpus operators against plain Python, and their defined results for odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from glossa.llm import bpe, common, kdtree, linking, mixing, paragraphs, pii, quality, simhash, suffixes, vafile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, ties and columns whose names might clash."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    base = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "b", len(long)), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (None, "null id here", "de", None, 12), (7, words(rng, 80), "de", "a", 1), (8, "é" * 300 + " 😀", "fr", "a", 302)]
    return spark.createDataFrame(base, DOCS).withColumns({c: F.lit(1) for c in ("id", "key", "n", "slot", "_n", "_fp", "component", "home", "class", "rank", "_doc", "_found", "_n_words", "_ids")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Small documents with copies, near copies and shared passages."""
    rng = random.Random(3)
    passage = words(rng, 60)
    out = []
    for i in range(120):
        text = "\n".join(words(rng, rng.randint(26, 60)) for _ in range(rng.randint(1, 4)))
        if i % 5 == 1:
            text = out[rng.randrange(len(out))][1]
        elif i % 5 == 2:
            parts = out[rng.randrange(len(out))][1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif i % 5 == 3:
            text += "\n" + passage + " " + words(rng, 3)
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    return out


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    found = dict(common.components(spark.createDataFrame(links, "a long, b long"), few=few).collect())
    expected = components_of(range(500), links)
    assert all(found.get(i, i) == expected[i] for i in range(500))


def test_number_rows(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.substring(F.md5(F.col("id").cast("string")), 1, 1).alias("c"))
    by = defaultdict(list)
    for r in common.number_rows(df, "g", "c", ["id"], "i").collect():
        by[r.g].append((r.i, r.c, r.id))
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) and sorted(v, key=lambda x: x[1:]) == sorted(v) for v in by.values())


def test_classes_of_hot_keys(spark):
    rng = random.Random(2)
    values = {i: rng.randrange(0, 4000) for i in range(150)}
    keyed = [(k, i, True) for i in values for k in (0, i % 7, 100 + values[i] // 50)]
    near = lambda a, b: abs(values[a] - values[b]) <= 30
    pos = spark.createDataFrame(list(values.items()), "i long, v long").cache()

    def verify(pairs):
        v = pairs.join(pos.withColumnsRenamed({"i": "a", "v": "x"}), "a").join(pos.withColumnsRenamed({"i": "b", "v": "y"}), "b")
        return v.where("abs(x - y) <= 30")

    found = dict(linking.classes(spark.createDataFrame(keyed, "key long, id long, home boolean"), verify).collect())
    expected = components_of(values, [(a, b) for a in values for b in values if a < b and near(a, b)])
    assert all(found.get(i, i) == expected[i] for i in values)


# 1 mixing


def test_mixing_lag_and_deadlines(spark, corpus):
    docs = spark.createDataFrame([(i, f"s{(i * i) % 7 % 4}") for i in range(3000)], "doc_id long, source string")
    weights = spark.createDataFrame([("s0", 5.0), ("s1", 2.5), ("s2", 1.0), ("s3", None)], "source string, weight double")
    got = mixing.mix(docs, weights, block_rows=8, quanta=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = {r.slot: r for r in got}
    assert len({(r.slot, r.place) for r in got}) == len(got)
    q, period = {r.source: r.q for r in got}, got[0].period
    last = min(max(r.slot for r in got if r.source == s) for s in q)
    taken = Counter()
    for t in range(last + 1):
        taken[slots[t].source] += 1
        assert all(abs(taken[s] - (t + 1) * q[s] / period) < 1 for s in q)


def test_mixing_odd(spark, odd, none):
    empty_weights = spark.createDataFrame([], "source string, weight double")
    got = mixing.mix(odd.select("doc_id", "source"), empty_weights, quanta=256)
    assert got.count() == odd.count() and got.where("q = 1").count() == odd.count()
    assert mixing.mix(none.select("doc_id", "source"), empty_weights).count() == 0
    assert sorted(map(str, mixing.mixing_stage(spark, odd, "").collect())) == sorted(map(str, odd.collect()))
    assert mixing.mixing_stage(spark, none, "").columns == none.columns


# 2 personal data


def test_pii_formats_and_coreference(spark):
    texts = ["Mail ana.34@mail7.example.com or ANA.34@mail7.example.com, +1 (017) 555-7713, 10.1.2.3.", "Mr John Smith and Mrs Mary Smith; 4111111111111111; ana.34@mail7.example.com", "token = \"269B1CEA0846965F2D3ECB5CDB87C0EDC7A7A587\" ssn 123-45-6789", "Господин Иван Петров", "version 1.2.3 in 2024, 300.1.1.1"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "k").orderBy("i").collect()]
    mail = got[0].split()[1]
    assert mail.endswith(".example.com") and mail in got[1] and got[0].split()[3].lower().rstrip(",") == mail and "ana" not in got[0].lower()
    assert len(got[0].split(", ")[1]) == len("+1 (017) 555-7713") and "555-7713" not in got[0]
    assert all(0 <= int(x) < 256 for x in got[0].split()[-1].rstrip(".").split(".")) and "10.1.2.3" not in got[0]
    man, woman = got[1].split(" and ")
    assert man.split()[2] == woman.split(";")[0].split()[2] != "Smith" and man.startswith("Mr ") and "Mary" not in woman
    card = got[1].split("; ")[1]
    digits = [int(c) for c in card[::-1]]
    assert len(card) == 16 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert "269B1CEA" not in got[2] and all(c in "0123456789ABCDEF" for c in got[2].split('"')[1]) and "123-45-6789" not in got[2]
    assert "Иван" not in got[3] and got[3].startswith("Господин ")
    assert got[4] == texts[4]


def test_pii_distinct_under_collisions(spark):
    """More addresses of one letter and digit than a draw without checks would keep apart."""
    names = [f"{a}{i}@m.org" for a in "abcdefghijklmnopqrstuvwxyz" for i in range(10)]
    docs = spark.createDataFrame([(i, f"to {n} now") for i, n in enumerate(names)], "i long, text string")
    got = [r.text.split()[1] for r in pii.pseudonymise(docs, "k").collect()]
    assert pii.redrawn(docs, "k").count() > 0
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_pii_joins_many_redrawn(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"to {a}{i % 10}@m.org now") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz" * 10)], "i long, text string")
    literal = rows(pii.pseudonymise(docs, "k"))
    monkeypatch.setattr(pii, "LITERAL_ROWS", 0)
    assert rows(pii.pseudonymise(docs, "k")) == literal


def test_pii_odd(spark, odd, none):
    assert sorted(map(str, pii.pii_stage(spark, odd, "").collect())) == sorted(map(str, odd.collect()))
    assert pii.pii_stage(spark, none, "").count() == 0


# 3 exact top-k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 500)]
    bad = [(600, None), (620, [None] * 8), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (None, [1.0] * 8), (680, [1.0] * 3), vectors[0]]
    df = vafile.integer_vectors(spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>"))
    got = rows(vafile.top_k(df.where("vec_id % 20 = 0"), df, 20), "query_id", "rank", "vec_id", "score")
    ints = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    expected = []
    for q in range(0, 500, 20):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:20]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(expected)
    assert vafile.top_k(df.where("false"), df.where("false"), 5).count() == 0


def test_scan_reads_few_exact_vectors():
    rng = np.random.default_rng(2)
    v = np.floor(64 * rng.normal(0, 0.2, (4000, 16))).astype(np.int64)
    best = [vafile.Best(5)]
    read = vafile.scan(v[:1], np.array([0]), v, np.arange(4000), best, bits=6)
    scores = v @ v[0]
    order = sorted(range(1, 4000), key=lambda i: (-scores[i], i))[:5]
    assert best[0].ids.tolist() == order and read < 400


# 4 WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    noise = bytes(rng.randrange(256) for _ in range(3000)).decode("latin-1")
    pages = [(i, f"http://x/{i}", words(rng, rng.randint(0, 300))) for i in range(40)] + [(40, None, None), (41, "http://x/\r\n", ""), (42, "u", noise), (43, "v", noise), (44, "w", noise), (44, "w", noise), (None, "n", "no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    files = warc.write_warc(warc.with_originals(df), f"file://{tmp_path}/a", file_bytes=20_000)
    assert files.count() > 1
    for split in (257, 5000, 1 << 25):
        got = warc.read_warc(files, split_bytes=split)
        assert got.count() == len(pages)
    assert rows(got.where("record_type = 'revisit'").select("record_id", "refers_to", "payload_bytes")) == [(f"<urn:page:{i}>", "<urn:page:44>", len(noise.encode())) for i in (42, 43)]
    by = {r.record_id: r for r in got.collect()}
    for i, _, html in pages[:41]:
        assert bytes(by[f"<urn:page:{i}>"].payload) == (html or "").encode() and by[f"<urn:page:{i}>"].payload_digest == hashlib.sha1((html or "").encode()).hexdigest()
    none = warc.write_warc(warc.with_originals(df.where("false")), f"file://{tmp_path}/b")
    assert warc.read_warc(none).count() == 0


def test_warc_passes_over_false_magic(tmp_path):
    import io
    import zlib

    inside = warc.MAGIC * 50 + b"\x1f\x8b\x08\x00junk"
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    body = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inside) + inside + b"\r\n\r\n"
    first = stored.compress(body) + stored.flush()
    raw = first + warc.record(1, "u", b"payload", None)
    for cut in range(1, len(raw), 7):
        got = [*warc.records_from(io.BytesIO(raw), 0, cut), *warc.records_from(io.BytesIO(raw), cut, len(raw))]
        assert [warc.parse(x)[6] for x in got] == [inside, b"payload"]


# 5 sharding


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(6)
    docs = [(i, "x" * rng.randint(0, 400), rng.choice(["en", "en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 9}", 0) for i in range(4000)]
    docs += [(i, "copies of one text", "en", "hot", 0) for i in range(4000, 4020)]
    got = kdtree.shard_documents(spark.createDataFrame(docs, DOCS), leaves=10).collect()
    assert len(got) == len(docs) and {r.shard for r in got} == set(range(10))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / 10
    assert all(abs(x - mean) < 0.06 * mean for x in sizes.values())
    assert len({r.shard for r in got if r.doc_id >= 4000}) == 1


def test_shards_odd(spark, odd, none):
    got = kdtree.shard_documents(odd, leaves=40).collect()
    assert len(got) == odd.count() and all(0 <= r.shard < 40 for r in got)
    assert {r.text_crc32 for r in got if r.doc_id in (1, 2)} == {0} and {r.size for r in got if r.doc_id == 1} == {16}
    assert kdtree.shard_documents(none, leaves=40).count() == 0


# 6 repeated passages


def passages_of(docs):
    texts = [(i, (t or "").lower().encode().split()) for i, t in docs]
    times = Counter(tuple(w[j : j + 50]) for _, w in texts for j in range(len(w) - 49))
    out = []
    for i, w in texts:
        spans = []
        for j in range(len(w) - 49):
            if times[tuple(w[j : j + 50])] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + 50
                else:
                    spans.append([j, j + 50])
        out += [(i, a, b) for a, b in spans]
    return sorted(out)


def test_repeated_passages(spark, corpus):
    docs = [(r[0], r[1]) for r in corpus] + [(900, corpus[0][1] * 3)]
    expected = passages_of(docs)
    assert len(expected) > 20 and rows(suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))) == expected


def test_repeated_passages_odd(spark, odd, none):
    assert rows(suffixes.repeated_passages(odd)) == []
    twice = suffixes.repeated_passages(odd.where("doc_id = 7").union(odd.where("doc_id = 7")))
    assert rows(twice) == [(7, 0, 80), (7, 0, 80)]
    assert suffixes.repeated_passages(none).count() == 0


# 7 SimHash


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum((2 * sum(x >> j & 1 for x in h) > len(h)) << j for j in range(64))


def test_near_duplicates(spark, corpus):
    docs = [(r[0], r[1]) for r in corpus] + [(500, None), (501, ""), (502, "  "), (503, "A b"), (504, "a B")]
    fps = {i: plain_fingerprint(t) for i, t in docs}
    expected = components_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r._fp % (1 << 64) for r in got} == fps and {r.doc_id: r.component_id for r in got} == expected


def test_fingerprint_classes_are_exact(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    expected = components_of(sorted(signed.values()), [(signed[a], signed[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    found = dict(simhash.fingerprint_classes(spark.createDataFrame([(x,) for x in signed.values()], "id long")).collect())
    assert all(found.get(i, i) == c for i, c in expected.items())


def test_near_duplicates_odd(spark, odd, none):
    got = dict(rows(simhash.near_duplicates(odd).where("doc_id is not null").select("doc_id", "component_id").distinct()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7, 8: 8}
    assert simhash.near_duplicates(none).count() == 0
    stays = simhash.near_duplicate_stage(spark, odd, "")
    assert stays.columns == odd.columns and sorted(str(r.doc_id) for r in stays.collect()) == ["1", "4", "5", "5", "7", "8", "None"]


# 8 quality


def plain_repeated(w):
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_counts():
    rng = random.Random(7)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words([x.encode() for x in w]) == plain_repeated(w)
    text = "a #b c\n \n\na #b c\n é*<"
    assert quality.counts(text)[:5] == (5, 13, 4, 1, 0)  # a no-break space is a word character
    for _ in range(300):
        text = "".join(rng.choice("ab#$é\u00a0 \t\n\n\r\x0b\x0c") for _ in range(rng.randint(0, 60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        again = sum(x in lines[:i] for i, x in enumerate(lines))
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, plain_repeated([x.encode() for x in w]))
        assert quality.counts(text)[:5] == expected
    assert quality.counts(None)[0] == 0


def test_quality_stage(spark, odd, none, tmp_path):
    spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = quality.quality_stage(spark, odd, str(tmp_path))
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.where("doc_id in (4, 7)").collect()))
    assert quality.quality_stage(spark, none, str(tmp_path)).count() == 0


def test_binomial_bound():
    for n, k, p in ((50, 0, 0.1), (200, 3, 0.05), (1000, 12, 0.03)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality.log_binomial_cdf(k, n, p), math.log(exact), rel_tol=1e-9)
    assert quality.proven(0, 500, 0.01, 0.01) and not quality.proven(0, 400, 0.01, 0.01) and not quality.proven(6, 500, 0.01, 0.5)


def test_thresholds_reject_junk_only(spark, odd, none):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(3000):
        junk = i % 4 == 0
        text = words(rng, 40)
        docs.append((i, " ".join(x + "###" for x in text.split()) if junk else text, "en", "a", 0))
        labels.append((i, int(not junk), 0))
    counted = quality.with_counts(spark.createDataFrame(docs, DOCS)).cache()
    marks = quality.one_label(spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int"))
    chosen = quality.calibrate(counted.join(marks, "doc_id"), "lang")
    assert set(chosen) == {"en"} and "symbols_per_word" in chosen["en"]
    kept = {r.doc_id for r in counted.where(quality.accepted(chosen, "lang")).collect()}
    assert kept == {i for i in range(3000) if i % 4}
    assert {r.doc_id for r in quality.with_counts(odd, keep=["doc_id", "lang"]).where(quality.accepted({}, "lang")).collect()} == {4, 7}
    assert quality.calibrate(quality.with_counts(none).withColumn("_good", F.lit(True)), "lang") == {}


# 9 paragraphs


def test_paragraph_classes(spark, corpus):
    items = [((i, p), frozenset(b" ".join(w[j : j + 5]) for j in range(len(w) - 4))) for i, t, *_ in corpus for p, _, _, w in paragraphs.paragraphs(t)]
    ids = [k for k, _ in items]
    links = [(a, b) for a, x in items for b, y in items if a < b and len(x & y) >= 0.8 * len(x | y)]
    of = components_of(ids, links)
    size = Counter(of.values())
    expected = sorted((*k, *of[k], k == of[k]) for k in ids if size[of[k]] > 1)
    docs = spark.createDataFrame(corpus, DOCS)
    assert rows(paragraphs.duplicate_paragraphs(docs), "doc_id", "para", "class_doc_id", "class_para", "kept") == expected
    left = {r.doc_id: r.text.split("\n") for r in paragraphs.remove_duplicate_paragraphs(docs).collect()}
    gone = Counter(k[0] for k in expected if not k[4])
    assert all(len(left[i]) == len(t.split("\n")) - gone[i] or left[i] == [""] for i, t, *_ in corpus)


def test_paragraphs_odd(spark, odd, none):
    assert paragraphs.duplicate_paragraphs(odd).count() == 0
    twice = odd.union(odd.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")))
    assert rows(paragraphs.duplicate_paragraphs(twice), "doc_id", "kept") == [(7, True), (70, False)]
    assert paragraphs.duplicate_paragraphs(none).count() == 0


# 10 BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return v, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_like_tiktoken(tokenizer):
    v, enc = tokenizer
    rng = random.Random(1)
    letters = "abc de'sſtTKmx1234٣½²Ⅷ  \n\t\r\x1c\x0b\x85 éÉß日本😀#$%&*!-_́‍"
    texts = ["", "a" * 3000, "ab" * 700 + " " * 500, "日本語テキスト" * 100, "hello world's it'S <|endoftext|>", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(800))]
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t) and v.decode(ids.tolist()) == t.encode()


def test_pair_table():
    rng = random.Random(2)
    pairs = {(rng.randrange(500), rng.randrange(500)): i for i in range(3000)}
    t = bpe.PairTable(pairs)
    a, b = np.array([rng.randrange(-1, 500) for _ in range(20_000)], np.int32), np.array([rng.randrange(-1, 500) for _ in range(20_000)], np.int32)
    assert t(a, b).tolist() == [pairs.get(p, int(bpe.NONE)) for p in zip(a.tolist(), b.tolist(), strict=True)]


def test_bpe_odd(spark, tokenizer, odd, none):
    _, enc = tokenizer
    assert bpe.bpe_stage(spark, odd, "").count() == odd.count()
    got = bpe.digests(odd, ["text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = enc.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.bpe_stage(spark, none, "").count() == 0


def test_periods_hold_the_targets(spark):
    """Cut into periods, every block has one slot, and no source is two blocks off its target."""
    weights = {"hot": 300.0, None: 40.0} | {f"s{i:03}": 1.0 + i % 4 for i in range(120)}
    blocks = {s: int(2 * w) for s, w in weights.items()}
    known = spark.createDataFrame([*weights.items(), ("zero", 0.0), ("none", None)], "source string, weight double")
    sizes = spark.createDataFrame([(s, 4 * n) for s, n in blocks.items()] + [("zero", 9), ("none", 9)], "source string, rows long")
    total = sum(weights.values())
    for size, most in ((1 << 16, 1 + 1e-6), (100, 2), (700, 2)):
        got = mixing.schedule(known, sizes, 4, size).collect()
        assert sorted((str(r.source), r.k) for r in got) == sorted((str(s), k) for s, n in blocks.items() for k in range(n))
        by, taken = {r.slot: r.source for r in got}, Counter()
        assert len(by) == len(got)
        for t in range(min(max(r.slot for r in got if r.source == s) for s in weights)):
            taken[by[t]] += 1
            assert all(abs(taken[s] - (t + 1) * w / total) < most for s, w in weights.items())


def test_no_weight_no_slot(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "doc_id long, source string").withColumn("slot", F.lit(1)).withColumn("_n", F.lit(2))
    got = mixing.mix(docs, spark.createDataFrame([("a", 2.0), ("b", 0.0)], "source string, weight double"), 4, None).collect()
    assert len(got) == 90 and all((r.slot is None) == (r.source != "a") and r._n == 2 for r in got)


def test_pii_mentions_without_title(spark):
    texts = ["Mr John Smith called. Later Smith paid; John Smith left, SMITH said. Smithers stayed.", "Smith alone", "Mrs O'Neil, Mr Νίκος Παπάς and Νίκος", "abcdefab" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumns({c: F.lit(1) for c in ("_names", "_found", "_new", "_map", "_row", "_first", "_doc", "_text")})
    got = [r.text for r in pii.pseudonymise(docs, "it's a \\ key").orderBy("i").collect()]
    given, last = got[0].split()[1:3]
    assert got[0] == f"Mr {given} {last} called. Later {last} paid; {given} {last} left, {last.upper()} said. Smithers stayed."
    assert got[1] == texts[1] and "O'Neil" not in got[2] and re.fullmatch(r"Mrs [A-Z][a-z]+, Mr ([Α-ώ]+) [Α-ώ]+ and \1", got[2])
    assert len(got[3]) == 40 and got[3] != texts[3]


@pytest.mark.parametrize("joined", [False, True])
def test_pii_leaves_ordinary_words(spark, monkeypatch, joined):
    """A capitalised word after a name isn't a part of it if the table has it in lower case, and isn't replaced elsewhere; nor is a name that is such a word."""
    if joined:
        monkeypatch.setattr(pii, "LITERAL_ROWS", 0)
        monkeypatch.setattr(pii, "BROADCAST_WORDS", 0)
    texts = ["We asked Mr Smith The next day. The house was red, Smith said", "in the house, the brown one", "Dr Brown left. Brown bread", "Mr Smith Mrs Jane Jones", "Prof. Dr. Miller and Miller", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [r.text for r in pii.pseudonymise(docs, "k").orderBy("i").collect()]
    name = got[0].split()[3]
    assert name != "Smith" and got[0] == f"We asked Mr {name} The next day. The house was red, {name} said"
    assert got[1] == texts[1] and got[5:] == ["", None]
    assert re.fullmatch(r"Dr (?!Brown)[A-Z][a-z]+ left. Brown bread", got[2])
    assert re.fullmatch(rf"Mr {name} Mrs (?!Jane)[A-Z][a-z]+ (?!Jones)[A-Z][a-z]+", got[3])
    assert re.fullmatch(r"Prof\. Dr\. (?!Miller)([A-Z][a-z]+) and \1", got[4])


def test_pii_keeps_scripts(spark):
    texts = ["كتاب@example.org", "שלום@example.org", "한글@example.org", "почта@example.org"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "k").orderBy("i").collect()]
    for old, new, letters in zip(texts, got, ("[\u0600-\u06ff]", "[\u0590-\u05ff]", "[\uac00-\ud7a3]", "[\u0430-\u044f]"), strict=True):
        assert new != old and re.fullmatch(rf"{letters}{{{old.index('@')}}}@[a-z]{{7}}\.org", new)


def test_pii_many_names_stay_apart(spark):
    """More entities than one draw keeps apart, in the order of thousands, with apostrophes."""
    names = [f"O'{a}{b}{c}" for a in "ABCDEFGHIJ" for b in "abcdefghij" for c in "abcdefghijklmnop"]
    docs = spark.createDataFrame([(i, f"Mr {n} came") for i, n in enumerate(names)], "i long, text string")
    got = {r.text for r in pii.pseudonymise(docs, "k").collect()}
    assert len(got) == len(names) and pii.redrawn(docs, "k").count() > 0


def test_pii_whole_result(spark):
    """Over the smallest table: what lies between the entities stays, and entities map one to one, each to its own format."""
    import os

    import regex

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found, to, back = regex.compile(pii.PATTERN), {}, {}
    shape = lambda s: regex.sub(r"\p{Ll}", "x", regex.sub(r"\p{Lu}", "X", regex.sub("[0-9]", "0", s)))
    before = {r.doc_id: r.text for r in docs.collect()}
    n = 0
    for r in pii.pseudonymise(docs, "k").collect():
        old = before[r.doc_id]
        hits = list(found.finditer(old)) if old else []
        assert r._entities == len(hits) and (hits or r.text == old)
        gaps = [old[a:b] for a, b in zip([0, *(h.end() for h in hits)], [*(h.start() for h in hits), len(old)], strict=True)] if hits else []
        m = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)), r.text, regex.S) if hits else None
        for h, new in zip(hits, m.groups() if m else (), strict=True):
            n += 1
            key, drawn = regex.sub(r"[^\p{L}\p{N}@.]", "", h[0]).lower(), regex.sub(r"[^\p{L}\p{N}@.]", "", new).lower()
            assert to.setdefault(key, drawn) == drawn and back.setdefault(drawn, key) == key and drawn not in before.values()
            if "@" not in h[0] and h[0].count(".") < 3 and not regex.fullmatch("[0-9a-fA-F]{32,}", h[0]):
                assert shape(new) == shape(h[0])
    assert n > 20


def test_warc_damage_and_archives_inside(tmp_path):
    """A damaged member is an error wherever ranges are cut, and archives stored in a record's data aren't records."""
    import io
    import zlib

    rng = random.Random(8)
    good = [warc.record(i, "u", words(rng, 200).encode(), None) for i in range(6)]
    for hurt in range(6):
        parts = list(good)
        at = len(parts[hurt]) // 2
        parts[hurt] = parts[hurt][:at] + bytes([parts[hurt][at] ^ 255]) + parts[hurt][at + 1 :]
        raw = b"".join(parts)
        for cut in range(1, len(raw), 97):
            with pytest.raises(ValueError):
                for x in [*warc.records_from(io.BytesIO(raw), 0, cut), *warc.records_from(io.BytesIO(raw), cut, len(raw))]:
                    warc.parse(x)
    inside = good[0]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    body = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inside) + inside + b"\r\n\r\n"
    raw = good[1] + stored.compress(body) + stored.flush() + good[2]
    for cut in range(1, len(raw), 5):
        got = [*warc.records_from(io.BytesIO(raw), 0, cut), *warc.records_from(io.BytesIO(raw), cut, len(raw))]
        assert len(got) == 3 and warc.parse(got[1])[6] == inside


def test_shards_beyond_a_thousand_leaves(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    got = Counter(r.shard for r in kdtree.shard_documents(docs, leaves=1500).collect())
    assert set(got) == set(range(1500)) and max(got.values()) <= 6
