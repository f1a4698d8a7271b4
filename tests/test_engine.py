"""Tokenizer, patterns, rules, numbers, strings, sources."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import numbers, strings, tokenizer
from glossa.operators import graphs, learning, lexicon, mentions, stats
from glossa.plans import rules
from glossa.plans.patterns import PatternError, compile_pattern
from glossa.plans.rules import DEFAULT_GRAPH, Mention, State, View, extract_from, read_rules
from glossa.sources import columns


def toks(text, lang="en"):
    return [[t.word for t in s] for s in tokenizer.tokenise(text, lang)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Mr. Smith won't go. It's ok!", [["Mr.", "Smith", "will", "not", "go", "."], ["It", "'s", "ok", "!"]]),
        ("see http://a.b/c?x=1, or <a@b.com>", [["see", "http://a.b/c?x=1", ",", "or", "<a@b.com>"]]),
        ('"Hi" (1/2) 12/5/2001', [["``", "Hi", "''", "(", "1/2", ")", "12/5/2001"]]),
        ("mid-July x-ray", [["mid", "July", "x-ray"]]),
        ("in the U.S. and", [["in", "the", "U.S.", "and"]]),
        ("word.12 The end", [["word", "."], ["12", "The", "end"]]),
        ("let's ain't don't", [["let's", "ain't", "do", "not"]]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(text, expected):
    assert toks(text) == expected


def test_other_languages():
    assert toks("Vamos al cine", "es") == [["Vamos", "a", "el", "cine"]]
    assert toks("o livro dela (no Brasil)", "pt") == [["o", "livro", "de", "ela", "-LRB-", "em", "o", "Brasil", "-RRB-"]]


def test_offsets_tile_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab. ,'é1-\n:)@#") for _ in range(rng.randint(0, 60)))
        for s in tokenizer.tokenise(text):
            for t in s:
                assert text[t.start : t.end] == t.raw or "-" in text[t.start : t.end + 1]


def view(words, **layers):
    return View({"words": words, **layers}, 0, State())


def spans(pattern, words, **layers):
    return [(m.start, m.end) for m in compile_pattern(pattern).find_all(view(words, **layers))]


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("b+", [(1, 3), (4, 5)]),
        ("b+?", [(1, 2), (2, 3), (4, 5)]),
        ("a b{2}", [(0, 3)]),
        ("a b{1,}? b | a b", [(0, 3), (3, 5)]),
        ("[word=/a|c/] b", [(0, 2), (3, 5)]),
        ("(?<=b) [!word=b]", [(3, 4)]),
        ("a (?!b b)", [(3, 4)]),
        ("^ a", [(0, 1)]),
        ("b $", [(4, 5)]),
        ("[word=a & !word=b | word=c]", [(0, 1), (3, 4)]),
        ("[1 + 2 * 3 == 7 & 7 // 2 == 3] b", [(0, 2), (3, 5)]),
    ],
)
def test_patterns(pattern, expected):
    assert spans(pattern, list("abbab")) == expected


def test_patterns_like_regexes():
    """Random patterns over one-letter words against the regex module of the library."""
    rng = random.Random(4)

    def make(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice("abc")
        kind = rng.randrange(4)
        a, b = make(depth - 1), make(depth - 1)
        return [f"{a} {b}", f"({a} | {b})", f"({a}){rng.choice(['?', '*', '+', '??', '*?', '+?', '{1,2}'])}", f"({a} {b})"][kind]

    tried = 0
    for _ in range(600):
        p = make(3)
        try:
            program = compile_pattern(p)
        except PatternError:
            continue
        tried += 1
        words = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        expected = [m.span() for m in re.finditer(p.replace(" ", ""), "".join(words)) if m[0]]
        assert [(m.start, m.end) for m in program.find_all(view(words))] == expected, (p, words)
    assert tried > 200


def test_bad_patterns():
    for p in ("a?", "[word=", "(?<=(?<x>a)) b", "[nothing=a]", "a{3,1}"):
        with pytest.raises(PatternError):
            compile_pattern(p)
    with pytest.raises(PatternError):
        spans("[lemma=x]", ["a"])


E_ = lambda a, b, r: {"source": a, "destination": b, "relation": r}
SENTENCE = {
    "words": "Kim and Pat eat fresh green apples and ripe pears".split(), "tags": "NNP CC NNP VBP JJ JJ NNS CC JJ NNS".split(), "lemmas": "kim and pat eat fresh green apple and ripe pear".split(),
    "graphs": {DEFAULT_GRAPH: [E_(3, 0, "nsubj"), E_(3, 2, "nsubj"), E_(3, 6, "dobj"), E_(3, 9, "dobj"), E_(6, 9, "conj"), E_(6, 4, "amod"), E_(6, 5, "amod"), E_(9, 8, "amod")]},
}
BASE = """
- {name: person, label: Person, type: token, priority: 1, pattern: "[tag=NNP]"}
- {name: food, label: Food, type: token, priority: 1, pattern: "[tag=NNS]"}
- {name: word, label: Adj, type: token, priority: 1, pattern: "[tag=JJ]", keep: false}
- name: eat
  label: Eat
  priority: 2
  pattern: |
    trigger = [lemma=eat]
"""


def events(arguments):
    text = BASE + "\n".join("    " + a for a in arguments)
    return sorted(tuple(sorted((r, tuple(m.start for m in ms)) for r, ms in m.args)) for m in extract_from([SENTENCE], read_rules(text)) if m.kind == "event")


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [
        (["agent:Person = nsubj"], [(("agent", (0,)),), (("agent", (2,)),)]),
        (["agent:Person+ = nsubj"], [(("agent", (0, 2)),)]),
        (["agent:Person{2} = nsubj", "theme:Food = dobj"], [(("agent", (0, 2)), ("theme", (6,))), (("agent", (0, 2)), ("theme", (9,)))]),
        (["other:Food? = iobj"], [()]),
        (["other:Food = iobj"], []),
        (["how:Adj* = dobj amod"], [(("how", (4, 5, 8)),)]),
        (["how:Adj+ = >>+ [tag=JJ]"], [(("how", (4, 5, 8)),)]),
        (["theme:Food = dobj (?= conj)"], [(("theme", (6,)),)]),
        (["theme:Food = dobj (?! conj)"], [(("theme", (9,)),)]),
        (["theme:Food = dobj conj"], [(("theme", (9,)),)]),
        (["agent:Person+ = dobj <dobj nsubj"], [(("agent", (0, 2)),)]),
        (["theme:Food+ = dobj | dobj conj"], [(("theme", (6, 9)),)]),
    ],
)
def test_graph_rules(arguments, expected):
    assert events(arguments) == expected


def test_state_and_fixpoint():
    grammar = """
    - {name: one, label: N, type: token, priority: 1, pattern: "one"}
    - {name: more, label: N, type: token, priority: "2+", pattern: "@N (?= plus) plus one"}
    """
    found = extract_from([{"words": "one plus one plus one".split()}], read_rules(grammar))
    assert sorted({(m.start, m.end) for m in found}) == [(0, 1), (0, 3), (0, 5), (2, 3), (2, 5), (4, 5)]
    grow = """
    - {name: a, label: A, type: token, priority: 1, pattern: "a"}
    - {name: b, label: B, type: token, priority: 2, pattern: "[mention=A]"}
    """
    found = extract_from([{"words": ["a", "b"]}], read_rules(grow), {"global": lambda ms, s: [m for m in ms if m.label != "A" or m.start == 0]})
    assert [(m.label, m.start) for m in found] == [("A", 0), ("B", 0)]


def test_cross_sentence_imports_taxonomy():
    master = """
    taxonomy: [{Thing: [{Animal: [Cat]}, Food]}]
    vars: {beast: [cat, dog]}
    rules:
    - import: inner.yml
      vars: {word: fish}
    - {name: c, label: Cat, type: token, priority: 1, pattern: "[word=/^(${beast})$/]"}
    - name: near
      label: Thing
      type: cross-sentence
      priority: 2
      right-window: 1
      pattern: |
        who:Cat = [word=/cat|dog/]
        what:Food = fish
    """
    files = {"inner.yml": 'vars: {word: meat}\nrules:\n- {name: f, label: Food, type: token, priority: 1, pattern: "${word}"}'}
    got = extract_from([{"words": ["dog"]}, {"words": ["a", "fish"]}, {"words": ["fish"]}], read_rules(master, files))
    cross = [m for m in got if m.kind == "cross"]
    assert [(m.of("who")[0].sent, m.of("what")[0].sent) for m in cross] == [(0, 1)]
    assert {m.labels for m in got if m.found_by == "c"} == {("Cat", "Animal", "Thing")}
    t = rules.Taxonomy([{"Thing": [{"Animal": ["Cat"]}]}])
    assert t.isa("Cat", "Thing") and sorted(t.hyponyms("Animal")) == ["Animal", "Cat"]
    for bad in ('[{name: a, label: A, type: token, pattern: "a"}, {name: a, label: A, type: token, pattern: "b"}]', "[{name: a, pattern: b}]", '[{name: a, label: A, graph: none, pattern: "trigger = a"}]'):
        with pytest.raises(PatternError):
            read_rules(bad)


def test_mention_operations():
    a, b = Mention("text", ("A",), 0, 0, 1), Mention("text", ("A",), 0, 2, 3)
    e = Mention("event", ("E",), 0, 0, 3, trigger=Mention("text", ("T",), 0, 1, 2), args=(("x", (a, b)),))
    assert [m.of("x") for m in e.scatter("x", 1)] == [(a,), (b,)] and e.without("x").args == () and e.with_argument("y", a).of("y") == (a,)
    assert a.precedes(b) and not b.precedes(a) and e.valid()
    assert not Mention("event", ("E",), 0, 0, 3, trigger=a, args=(("x", (Mention("text", ("A",), 0, 0, 2),)),)).valid()


def test_extract_over_documents(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran!"), (2, None), (3, "")], "doc_id long, text string")
    grammar = '[{name: a, label: A, type: token, priority: 1, pattern: "the? (?<what>[word=/^(cat|dog)$/])"}]'
    got = rules.extract(tokenizer.with_sentences(docs), grammar, ["doc_id"])
    assert sorted((r.doc_id, r.sent, r.text, r.args[0].role) for r in got.collect()) == [(1, 0, "cat", "what"), (1, 1, "dog", "what")]
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("words", "value"), [("two hundred and five", 205), ("forty-two", 42), ("3.5 million", 3.5e6), ("1,000", 1000), ("1 / 2", 0.5), ("minus 5", -5), ("twentieth", 20), ("cat", None), ("", None), ("and", None)])
def test_numbers(words, value):
    assert numbers.parse_number(words.split()) == value


def test_dates():
    assert numbers.make_date(5, "May", 2001) == "2001-05-05" and numbers.make_date(None, "dec", None) == "XXXX-12-XX" and numbers.make_date(1, 2, 99) == "XX99-02-01"
    assert numbers.season_range("winter", 1999) == "1999-12-21 -- 2000-03-20"
    assert numbers.part_of("2000-02-XX", 1) == "2000-02-29" and numbers.part_of("2010-XX-XX", 0.5) == "2010-06-XX"
    assert numbers.span("XXXX-05-01", "2003-06-01") == "2003-05-01 -- 2003-06-01"
    got = numbers.recognise(["on 2015-03-04 from May 5 , 2001 to June 7 , 2001 , 3.5 kilometers , before 1999".split()])
    assert [x[3:] for x in got] == [("DATE", "2015-03-04"), ("DATE-RANGE", "2001-05-05 -- 2001-06-07"), ("MEASUREMENT-LENGTH", "3.5 km"), ("DATE-RANGE", "XXXX-XX-XX -- 1999-XX-XX")]
    labels, norms = numbers.label_tokens("a b c".split(), [(1, 3, "DATE", "x")])
    assert labels == ["O", "B-DATE", "I-DATE"] and norms == ["", "x", "x"]


def test_strings(spark):
    assert strings.edits("kitten", "sitting")[0] == 3 and strings.edits("ab", "ba", transpose=True)[0] == 1 and strings.edits("Ab", "ab", capital=True)[0] == 0
    script = strings.edits("abc", "axc")[1]
    assert "".join(b for _, _, b in script) == "axc" and "".join(a for _, a, _ in script) == "abc"
    for a, b in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "happy": "happi"}.items():
        assert strings.porter(a) == b
    assert [r.s for r in spark.createDataFrame([("cats",), (None,)], "w string").select(strings.stem("w").alias("s")).collect()] == ["cat", None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.conll").write_text("Kim NNP B-PER\nran VBD O\n\n\nThe DT O\n")
    tokens = columns.read_columns(spark, str(tmp_path / "a.conll"))
    assert sorted((r.sent, r.tok, r.columns[0]) for r in tokens.collect()) == [(0, 0, "Kim"), (0, 1, "ran"), (1, 0, "The")]
    doc = columns.columns_to_documents(tokens, {"words": 0, "tags": 1, "entities": 2})
    assert [list(s.entities) for s in doc.first().sentences] == [["B-PER", "O"], ["O"]]
    lines = [r.line for r in columns.conllu_lines(doc, "file").orderBy("sent", "tok").collect()]
    assert lines[0] == "1\tKim\t_\tNNP\t_\tB-PER\t_\t_\t_\t_"
    rows = columns.read_svmlight(spark.createDataFrame([("1 qid:3 1:0.5 7:2 # note",), ("# none",), ("-1 2:1",)], "value string"))
    assert [(r.label, r.qid, r.features) for r in rows.collect()] == [(1.0, "3", {1: 0.5, 7: 2.0}), (-1.0, None, {2: 1.0})]
    assert columns.svmlight_lines(rows).first().value == "1.0 qid:3 1:0.5 7:2.0"
    (tmp_path / "d.json").write_text('{"id": "x", "sentences": [{"words": ["a", "b"], "graphs": {"universal-enhanced": {"edges": [{"source": 0, "destination": 1, "relation": "r"}], "roots": [0]}}}]}')
    read = columns.read_documents(spark, str(tmp_path / "d.json"))
    grammar = '[{name: a, label: A, type: token, priority: 1, pattern: "[outgoing=r]"}]'
    assert [r.start for r in rules.extract(read, grammar, ["id"]).collect()] == [0]


def test_lexicon_sources(spark):
    lines = spark.createDataFrame([("New York // city",), ("# skip",), ("Rome",), ("",)], "value string")
    assert sorted(r.phrase for r in lexicon.read_lexicon(lines, "CITY").collect()) == ["New York", "Rome"]
    assert [tuple(r) for r in lexicon.read_overrides(spark.createDataFrame([("a b\tx\tL",), ("alone",)], "value string")).collect()] == [("a b", "L")]
    assert [tuple(r) for r in lexicon.read_normed(spark.createDataFrame([("km // km::LENGTH",)], "value string")).collect()] == [("km", "km", "LENGTH")]
    s = spark.createDataFrame([(1, "in New York City and rome".split())], "id int, words array<string>")
    entries = spark.createDataFrame([("new york", "A", 0), ("New York City", "B", 1), ("York", "C", 0), ("Rome", "D", 2), ("rome", "E", 1)], "phrase string, label string, rank int")
    assert sorted(tuple(r) for r in lexicon.matches(s, entries, "id").collect()) == [(1, 1, 4, "B"), (1, 5, 6, "E")]


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 0, "c"), (1, 3, 4, "nmod"), (1, 4, 5, "case")], "k int, src int, dst int, rel string")
    nodes = spark.range(6).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("node"))
    assert sorted(r.node for r in graphs.roots(nodes, e, ["k"]).collect()) == [3]
    depth = {(r.start, r.node): r.depth for r in graphs.shortest_paths(nodes, e, ["k"], 6).collect()}
    assert depth[0, 2] == 1 and depth[3, 5] == 2 and (0, 3) not in depth
    words = nodes.withColumn("word", F.when(F.col("node") == 5, "Of").otherwise("x"))
    assert {r.rel for r in graphs.collapsed(e, words, ["k"]).collect()} == {"a", "b", "c", "nmod_of", "case"}
    head = graphs.heads(spark.createDataFrame([(1, 0, 4, 6)], "k int, span int, begin int, end int"), e, nodes, ["k"], 6)
    assert head.first().head == 4


def test_statistics(spark):
    rng = random.Random(3)
    spans_ = [(1, a, a + rng.randint(1, 5)) for a in (rng.randrange(40) for _ in range(30))]
    got = sorted((r.start, r.end) for r in mentions.outermost(spark.createDataFrame(spans_, "k int, start int, end int"), ["k"]).collect())
    assert got == sorted((a, b) for _, a, b in spans_ if not any(x <= a and y >= b and (x, y) != (a, b) for _, x, y in spans_))
    h = stats.histogram(spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "v double"), "v", [1.0, 5.0])
    assert sorted(tuple(r) for r in h.collect()) == [(0, 1), (1, 1), (2, 1)]
    rows = spark.createDataFrame([(i, "a", "b", "a") for i in range(50)], "id int, gold string, x string, y string")
    assert stats.bootstrap(rows, "gold", "x", "y", 200).first().p_value == 0.0
    votes = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 1)], "id int, prediction int")
    assert sorted(tuple(r) for r in learning.vote(votes, "id").collect()) == [(1, 1), (2, 0)]


def test_perceptron_separates(spark):
    rng = random.Random(5)
    rows = [(i, [y * 10 + rng.randrange(10), 20 + rng.randrange(10)], y) for i in range(600) for y in (i % 2,)]
    df = spark.createDataFrame(rows, "id long, features array<int>, label int")
    w = learning.perceptron(df.where("id < 400"), 30)
    assert learning.decide(df.where("id >= 400"), w).where("prediction = label").count() >= 195


def test_combinations_of_bundles():
    found = extract_from([{"words": "a b c".split()}], read_rules('[{name: x, label: X, type: token, priority: 1, pattern: "a b?"}, {name: y, label: X, type: token, priority: 1, pattern: "a b c"}, {name: z, label: Z, type: token, priority: 2, pattern: "@m:X c?"}]'))
    z = [m for m in found if m.label == "Z"]
    assert z and all(m.of("m") for m in z) and len(list(itertools.chain(*[m.of("m") for m in z]))) == len(z)


def test_open_entities(spark):
    from glossa.operators import openie

    assert openie.find_entities([SENTENCE]) == [(0, 0, 1), (0, 2, 3), (0, 4, 7), (0, 8, 10)]
    s = {"words": "the fall of old and new prices".split(), "tags": "DT NN IN JJ CC JJ NNS".split(), "graphs": {DEFAULT_GRAPH: [E_(1, 6, "nmod_of"), E_(6, 3, "amod"), E_(6, 5, "amod")]}}
    assert openie.find_entities([s]) == [(0, 1, 7)]
    assert openie.find_entities([s], avoid='[{name: x, label: X, type: token, pattern: "prices"}]') == [(0, 1, 2)]
    assert not openie.fit({"words": ["two"], "tags": ["CD"]}, 0, 1, 10)


@pytest.mark.parametrize(
    "text, label, norm",
    [
        ("from May to July 2001", "DATE-RANGE", "2001-05-XX -- 2001-07-XX"), ("2005-06", "DATE", "2005-06-XX"), ("06/2005", "DATE", "2005-06-XX"), ("98-05-06", "DATE", "XX98-05-06"),
        ("2005-2006", "DATE-RANGE", "2005-XX-XX -- 2006-XX-XX"), ("2011WS", "DATE-RANGE", "2011-XX-XX -- 2011-XX-XX"), ("first two weeks of May", "DATE-RANGE", "XXXX-05-01 -- XXXX-05-14"),
        ("last week of February", "DATE-RANGE", "XXXX-02-22 -- XXXX-02-28"), ("last three weeks of April", "DATE-RANGE", "XXXX-04-10 -- XXXX-04-30"),
        ("between the second and third weeks of June", "DATE-RANGE", "XXXX-06-08 -- XXXX-06-21"), ("between 3 and 12 May 2001", "DATE-RANGE", "2001-05-03 -- 2001-05-12"),
        ("after winter 1999", "DATE-RANGE", "2000-03-20 -- XXXX-XX-XX"), ("since summer 2001", "DATE-RANGE", "2001-09-22 -- ref-date"), ("until spring", "DATE-RANGE", "ref-date -- XXXX-03-20"),
        ("before summer of 1999", "DATE-RANGE", "XXXX-XX-XX -- 1999-06-21"), ("from fall 2001 to spring 2003", "DATE-RANGE", "2001-12-21 -- 2003-03-20"), ("2001 winter", "DATE-RANGE", "2001-12-21 -- 2002-03-20"),
        ("good friday 2024", "DATE", "2024-03-29"), ("thanksgiving , 2023", "DATE", "2023-11-23"), ("on Halloween", "DATE", "XXXX-10-31"), ("memorial day 2022", "DATE", "2022-05-30"), ("12 kilometers", "MEASUREMENT-LENGTH", "12.0 km"),
    ],
)
def test_norms_of_ranges_and_holidays(text, label, norm):
    from glossa.functions.numbers import recognise

    assert [r[3:] for r in recognise([text.split()])] == [(label, norm)]


def test_properties():
    from glossa.operators.text import properties

    assert properties(["-a", "1", "--b=2", "-c", "x.txt", "-d", "-a", "3", "y"]) == {"a": "3", "b": "2", "c": "x.txt", "d": "true", "": "y"}
