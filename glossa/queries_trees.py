"""Queries of trees as tags, of lemmas and of mentions as JSON, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.lemmas import BRACKETS, IRREGULAR, RULES, lemma
from glossa.operators import graphs, learning, lexicon, mentions, parsing, text
from glossa.plans.lineage import spread
from glossa.plans.rules import extract
from glossa.queries import KEYS, W, docs, one_sentence, query, table
from glossa.sources import columns

# --- hexatags: a word's head is its place without the lowest bit, which makes nested spans; every other turn is mirrored

_PLACES = r"""s AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM conversations),
p AS (SELECT conv_id, turn, n, CAST(i AS INTEGER) AS i FROM s, LATERAL (SELECT unnest(range(n)) AS i)),
h AS (SELECT *, CASE WHEN i = 0 THEN -1 ELSE i & (i - 1) END AS h, CASE WHEN i = 0 THEN 'root' ELSE 'r' || i % 7 END AS label FROM p)"""


def _trees(spark, d, mirrored: bool):
    t = spread(table(spark, d, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("n")).where("n > 0"))
    t = t.withColumn("i", F.expr("transform(sequence(0, n - 1), i -> if(turn % 2 = 1, n - 1 - i, i))" if mirrored else "sequence(0, n - 1)"))
    heads = F.expr("transform(i, x -> case when x = 0 then -1 " + ("when turn % 2 = 1 then n - 1 - (x & (x - 1)) " if mirrored else "") + "else x & (x - 1) end)")
    return t.select("conv_id", "turn", heads.alias("heads"), F.expr("transform(i, x -> if(x = 0, 'root', concat('r', x % 7)))").alias("labels"))


@query(f"""WITH {_PLACES} SELECT conv_id, turn, i, 't' || CASE WHEN i > 0 AND (i % 2 = 1 OR i + 1 >= n) THEN 'r' ELSE 'l' END || '-' || label AS term,
CASE WHEN i + 1 >= n THEN 'eos' ELSE 'n' || CASE WHEN (i + 1) & i > 0 AND (2 * (i + 1 - ((i + 1) & i)) >= ((i + 1) & i) - (((i + 1) & i) & (((i + 1) & i) - 1)) OR ((i + 1) & i) + 2 * (i + 1 - ((i + 1) & i)) >= n) THEN 'r' ELSE 'l' END || '-L' END AS nonterm FROM h""")
def hexatags(spark, d):
    """The tags of trees whose modifiers all follow."""
    found = parsing.hexatags(_trees(spark, d, False), "conv_id", "turn")
    return found.select("conv_id", "turn", F.posexplode(F.arrays_zip("term", "nonterm")).alias("i", "t")).select("conv_id", "turn", "i", "t.term", "t.nonterm")


@query(f"""WITH {_PLACES} SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN n - 1 - h ELSE h END::INTEGER AS source, CASE WHEN turn % 2 = 1 THEN n - 1 - i ELSE i END::INTEGER AS destination, label AS relation FROM h WHERE h >= 0""")
def hexatags_decoded(spark, d):
    """Trees to tags, and from scores, in which a tag that makes no tree is the likeliest of every fifth word, back."""
    t = parsing.hexatags(_trees(spark, d, True), "conv_id", "turn")
    scores = lambda c: F.transform(c, lambda x, i: F.array(F.struct(x.alias("label"), F.lit(2.0).alias("score")), F.struct(F.concat(F.lit("x"), x).alias("label"), F.when(i % 5 == 0, 2.5).otherwise(0.5).alias("score"))))
    found = parsing.decoded(t.select("conv_id", "turn", scores(F.col("term")).alias("term"), scores(F.col("nonterm")).alias("nonterm")), "conv_id", "turn", k=None)
    return found.select("conv_id", "turn", F.inline("edges"))


# --- lemmas


def _lemma_sql() -> str:
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    rules = []
    for pattern, to in RULES:
        made = f"regexp_replace(bare, '{pattern}', '{to.replace('$', chr(92))}')"
        rules.append(f"WHEN regexp_matches(bare, '{pattern}') THEN " + (f"left({made}, length({made}) - 1)" if "bb|dd" in pattern else made))
    return f"CASE WHEN regexp_matches(low, '{BRACKETS}') OR bare = '' THEN low ELSE coalesce(CASE bare {known} END, CASE {' '.join(rules)} ELSE bare END) END"


@query(rf"""WITH {W}, x AS (SELECT DISTINCT word, lower(word) AS low, trim(regexp_replace(trim(lower(word)), '[()\[\].,;:"'']', '', 'g')) AS bare FROM w) SELECT word, {_lemma_sql()} AS lemma FROM x""")
def lemmas(spark, d):
    """The English lemma of each different word."""
    w = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("word")).distinct()
    return w.select("word", lemma(F.col("word")).alias("lemma"))


@query(f"WITH {W}, x AS (SELECT DISTINCT word FROM w) SELECT word, lower(word) AS lemma FROM x")
def lemmas_lower(spark, d):
    """Lemmas of languages without rules."""
    w = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("word")).distinct()
    return w.select("word", lemma(F.col("word"), "es").alias("lemma"))


# --- mentions as JSON

_PROBES = f"""{W}, n AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY tok) AS after FROM w),
m AS (SELECT doc_id, tok, word || ' ' || after AS text FROM n WHERE regexp_matches(word, '^[Tt]h') AND after IS NOT NULL)"""


def _probes(spark, d):
    return extract(one_sentence(spark, d), '[{name: probe, label: Probe, type: token, priority: 1, pattern: "[word=/^[Tt]h/] []"}]', ["doc_id"])


@query(f"""WITH {_PROBES}, o AS (SELECT *, CASE WHEN lag(tok) OVER (PARTITION BY doc_id ORDER BY tok) = tok - 1 THEN 1 ELSE 0 END AS glued FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tok - k ORDER BY tok) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok) AS k FROM o))
SELECT doc_id, CAST(tok AS INTEGER) AS start, CAST(tok + 2 AS INTEGER) AS "end", text, 'probe' AS found_by, 'Probe' AS label FROM r WHERE nth % 2 = 1""")
def mentions_json_round_trip(spark, d):
    """Mentions to JSON, one line a document, and back."""
    lines = mentions.to_lines(_probes(spark, d), "doc_id")
    back = mentions.from_lines(lines.select("value"))
    return back.select(F.col("document").cast("long").alias("doc_id"), "start", "end", "text", F.col("foundBy").alias("found_by"), F.col("labels")[0].alias("label"))


# --- rewrites of graphs

_MORE = r"""w AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
e AS (SELECT conv_id, turn, CAST(tok // 2 AS INTEGER) AS src, CAST(tok AS INTEGER) AS dst, ['prep', 'pobj', 'conj', 'nsubj', 'acl:relcl', 'dobj', 'case', 'nmod_x'][1 + (length(word) + tok) % 8] AS rel FROM w WHERE tok > 0),
g AS (SELECT conv_id, turn, tok AS node, CASE WHEN length(word) % 2 = 0 THEN 'VB' ELSE 'NN' END AS tag FROM w)"""
_ON = "USING (conv_id, turn)"


def _more(spark, d):
    w = text.words(table(spark, d, "conversations"), "conv_id", "turn")
    rel = F.element_at(F.array(*map(F.lit, ("prep", "pobj", "conj", "nsubj", "acl:relcl", "dobj", "case", "nmod_x"))), (1 + (F.length("word") + F.col("tok")) % 8).cast("int"))
    edges = w.where("tok > 0").select(*KEYS, F.expr("cast(tok div 2 as int)").alias("src"), F.col("tok").alias("dst"), rel.alias("rel"))
    return edges, w.select(*KEYS, F.col("tok").alias("node"), "word")


@query(f"""WITH {_MORE} SELECT * FROM e WHERE rel <> 'prep' AND NOT (rel = 'pobj' AND EXISTS (SELECT 1 FROM e p WHERE p.conv_id = e.conv_id AND p.turn = e.turn AND p.dst = e.src AND p.rel = 'prep'))
UNION SELECT p.conv_id, p.turn, p.src, o.dst, 'prep_' || word FROM e p JOIN e o ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.src = p.dst AND o.rel = 'pobj' JOIN w ON w.conv_id = p.conv_id AND w.turn = p.turn AND w.tok = p.dst WHERE p.rel = 'prep'""")
def graph_stanford_prepositions(spark, d):
    return graphs.stanford_prepositions(*_more(spark, d), KEYS)


@query(f"""WITH {_MORE}, p AS (SELECT a.conv_id, a.turn, CAST(a.tok AS INTEGER) AS src, CAST(b.tok AS INTEGER) AS dst FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.tok = a.tok + 1 WHERE lower(a.word) LIKE 'of' AND lower(b.word) = 'the')
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = e.conv_id AND p.turn = e.turn AND p.dst = e.dst) UNION SELECT *, 'mwe' FROM p""")
def graph_multiwords(spark, d):
    """Two words, "of the", as one expression."""
    return graphs.with_multiwords(*_more(spark, d), KEYS, "of", "the")


@query(f"""WITH {_MORE} SELECT * FROM e UNION SELECT c.conv_id, c.turn, c.dst, c.src, r.rel FROM e c JOIN e r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.src = c.dst JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.tok = r.dst
WHERE c.rel = 'acl:relcl' AND r.rel IN ('nsubj', 'dobj') AND lower(word) IN ('the', 'of', 'and', 'to')""")
def graph_relative_clauses(spark, d):
    return graphs.relative_clauses(*_more(spark, d), KEYS, ("the", "of", "and", "to"))


@query(f"""WITH {_MORE}, c AS (SELECT e.conv_id, e.turn, src AS a, dst AS b FROM e JOIN g x ON x.conv_id = e.conv_id AND x.turn = e.turn AND x.node = src AND x.tag = 'VB' JOIN g y ON y.conv_id = e.conv_id AND y.turn = e.turn AND y.node = dst AND y.tag = 'VB' WHERE rel = 'conj'),
t AS (SELECT * FROM c UNION SELECT conv_id, turn, b, a FROM c)
SELECT * FROM e UNION SELECT t.conv_id, t.turn, t.b, e.dst, e.rel FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn = t.turn AND e.src = t.a WHERE e.rel IN ('nsubj', 'dobj', 'nmod_x')
AND NOT EXISTS (SELECT 1 FROM e o WHERE o.conv_id = t.conv_id AND o.turn = t.turn AND o.src = t.b AND o.rel = e.rel)""")
def graph_shared_by_verbs(spark, d):
    """Subjects, objects and modifiers of conjoined verbs."""
    e, w = _more(spark, d)
    return graphs.shared_by_verbs(e, w.select(*KEYS, "node", F.when(F.length("word") % 2 == 0, "VB").otherwise("NN").alias("tag")), KEYS)


@query(f"""WITH {_MORE}, r AS (SELECT conv_id, turn, src, dst, CASE WHEN dst % 3 = 0 THEN 'Ax' ELSE 'A1' END AS rel FROM e WHERE dst % 2 = 0), k AS (SELECT conv_id, turn, dst, min(src) AS o FROM e WHERE rel = 'case' GROUP BY ALL),
n AS (SELECT DISTINCT r.conv_id, r.turn, r.src, coalesce(o, r.dst) AS dst, CASE WHEN r.rel = 'Ax' AND o IS NOT NULL THEN 'Ax_' || lower(word) ELSE r.rel END AS rel FROM r LEFT JOIN k ON k.conv_id = r.conv_id AND k.turn = r.turn AND k.dst = r.dst LEFT JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.tok = r.dst),
j AS (SELECT conv_id, turn, src AS a, dst AS b FROM e WHERE rel = 'conj'), i AS (SELECT * FROM j UNION SELECT conv_id, turn, b, a FROM j),
m AS (SELECT * FROM n UNION SELECT n.conv_id, n.turn, i.b, n.dst, n.rel FROM n JOIN i ON i.conv_id = n.conv_id AND i.turn = n.turn AND i.a = n.src WHERE i.b <> n.dst)
SELECT * FROM m UNION SELECT m.conv_id, m.turn, m.src, j.b, m.rel FROM m JOIN j ON j.conv_id = m.conv_id AND j.turn = m.turn AND j.a = m.dst WHERE j.b <> m.src""")
def graph_enhanced_roles(spark, d):
    e, w = _more(spark, d)
    roles = e.where("dst % 2 = 0").select(*KEYS, "src", "dst", F.when(F.col("dst") % 3 == 0, "Ax").otherwise("A1").alias("rel"))
    return graphs.enhanced_roles(roles, e, w, KEYS)


# --- lexicons and learners


@query("""WITH s AS (SELECT n_name AS phrase, 'NATION' AS label, n_nationkey % 3 AS rank FROM nation), o AS (SELECT n_name AS phrase, 'OVER' AS label FROM nation WHERE n_nationkey % 4 = 0),
u AS (SELECT phrase, label, CAST(0 AS INTEGER) AS rank FROM o UNION ALL SELECT phrase, label, CAST(rank + 1 AS INTEGER) FROM s WHERE phrase NOT IN (SELECT phrase FROM o))
SELECT * FROM u UNION SELECT lower(phrase), label, rank FROM u UNION SELECT phrase || 's', label, rank FROM u""")
def lexicon_overridden(spark, d):
    """Overrides before the standard entries, and variations of both."""
    n = table(spark, d, "nation")
    standard = n.select(F.col("n_name").alias("phrase"), F.lit("NATION").alias("label"), (F.col("n_nationkey") % 3).cast("int").alias("rank"))
    both = lexicon.overridden(standard, n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("phrase"), F.lit("OVER").alias("label")))
    return lexicon.with_variations(both, F.array(F.lower("phrase"), F.concat("phrase", F.lit("s"))))


@query(f"""WITH {W} SELECT doc_id, CAST(tok AS INTEGER) AS start, CAST(tok + 1 AS INTEGER) AS "end", 'T' AS label FROM w WHERE lower(word) IN ('the', 'of') AND regexp_matches(word, '^[A-Z]')""")
def matches_validated(spark, d):
    """Matches that a validator accepts: those that begin with a capital."""
    found = docs(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("words"))
    entries = spark.createDataFrame([("the", "T", 0), ("of", "T", 0)], "phrase string, label string, rank int")
    return lexicon.validated(lexicon.matches(found, entries, "doc_id"), found, F.get("words", F.col("start")).rlike("^[A-Z]"), "doc_id")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def regression_line(spark, d):
    """Least squares of price on quantity."""
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "lineitem").where("l_quantity is not null and l_extendedprice is not null")
    model = learning.regression(rows.select(array_to_vector(F.array(F.col("l_quantity").cast("double"))).alias("features"), F.col("l_extendedprice").cast("double").alias("label")))
    return spark.createDataFrame([(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))], "slope double, intercept double")


@query("""WITH n AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY ALL) SELECT doc_id, label, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) AS weight FROM labels JOIN n ON n.label IS NOT DISTINCT FROM quality""")
def class_weights(spark, d):
    return learning.class_weights(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")))


# --- documents to read


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, '[{"Tokens":[' || coalesce(array_to_string(list_transform(l, lambda w, i: '["' || replace(replace(w, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '",' || (i - 1) || ']'), ','), '')
|| '],"Enhanced_syntactic_dependencies":[' || coalesce(array_to_string(list_transform(range(len(l) - 1), lambda i: '[' || i || ',' || (i + 1) || ',"' || CASE WHEN regexp_matches(l[i + 2], '[.]$') THEN 'end' ELSE 'next' END || '"]'), ','), '') || ']}]' AS json FROM d""")
def documents_graph_json(spark, d):
    """Words and their graph, in JSON."""
    return columns.graph_json(one_sentence(spark, d).where("words is not null"), "doc_id")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS line, 'Sentence #0' AS text FROM d UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'words: ' || array_to_string(l, ' ') FROM d WHERE l IS NOT NULL""")
def documents_printed(spark, d):
    """Documents as lines to read."""
    s = one_sentence(spark, d)
    return columns.printed(s, "doc_id")
