"""op9 over lines of any length, against plain Python."""

import random

from glossa.llm import paragraphs


def test_query_takes_short_lines(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    lines = [[word() for _ in range(rng.randint(1, 34))] for _ in range(60)] + [["the"], ["one", "two"], ["la"] * 6, ["la"] * 9]
    docs = []
    for i in range(120):
        picked = [list(rng.choice(lines)) for _ in range(rng.randint(0, 6))]
        for p in picked:
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            elif rng.random() < 0.4:
                p[:] = [w.upper() for w in p]
        docs.append((i, "\n".join(" ".join(p) for p in picked) + rng.choice(["", "\n", "\n  \nalone"])))
    docs.append((500, None))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if w := line.lower().split():
                items[i, p] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in items.items():
        for b, y in items.items():
            if a < b and len(x & y) >= 0.8 * len(x | y):
                c, e = sorted((find(a), find(b)))
                root[e] = c
    of = {k: find(k) for k in items}
    expected = sorted((*k, *c, k == c) for k, c in of.items() if list(of.values()).count(c) > 1)
    got = paragraphs.op9_paragraph_minhash(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "para", "class_doc_id", "class_para", "kept").collect()) == expected
    assert got.where("n_words < 5").count() > 20 and got.where("n_words between 5 and 24").count() > 50
