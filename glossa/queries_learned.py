"""Queries of grammars over nested tables, paths and heads in graphs, and learned taggers, rankers and selections, over whole tables, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators import graphs, kernels, learning, ranking, stats, tagging, text
from glossa.plans.lineage import spread, written
from glossa.plans.rules import extract
from glossa.queries import CHAIN, KEYS, W, chain, dealt, docs, one_sentence, query, table

# --- grammars


@query(f"""WITH {W}, n AS (SELECT *, lag(word) OVER o AS b, lead(word, 1) OVER o AS a1, lead(word, 2) OVER o AS a2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY tok)),
t AS (SELECT doc_id, tok, coalesce(regexp_matches(a1, 'tion$'), false) AS x, coalesce(regexp_matches(a2, 'tion$') AND NOT regexp_matches(a1, '[.]$'), false) AS y FROM n WHERE word = 'the' AND b = 'of')
SELECT doc_id, CAST(tok - 1 AS INTEGER) AS start, CAST(tok + k AS INTEGER) AS "end", CAST(CASE WHEN k = 1 THEN 1 ELSE 2 END AS INTEGER) AS args
FROM t, (SELECT unnest([1, 2, 3]) AS k) WHERE CASE k WHEN 1 THEN NOT x AND NOT y WHEN 2 THEN x ELSE y END""")
def graph_rule_two_roles(spark, d):
    """A required role against an edge, and one that may stay empty, one edge or two away: an event for each way to fill them."""
    grammar = r"""
    - {name: det, label: Det, type: token, priority: 1, pattern: "of"}
    - {name: noun, label: Noun, type: token, priority: 1, pattern: "[word=/tion$/]"}
    - name: event
      label: Event
      priority: 2
      pattern: |
        trigger = the
        cause:Det = <next
        theme:Noun? = next{1,2} (?! [word=/[.]$/])
    """
    found = extract(one_sentence(spark, d), grammar, ["doc_id"]).where("kind = 'event'")
    return found.select("doc_id", "start", "end", F.size("args").alias("args"))


@query(f"""WITH {W}, n AS (SELECT *, lead(word, 1) OVER o AS a1, lead(word, 2) OVER o AS a2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY tok))
SELECT doc_id, CAST(tok AS INTEGER) AS start, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT doc_id, tok, unnest([1, 2, 3]) AS k, word, a1, a2 FROM n) WHERE word IN ('of', 'in') AND CASE k WHEN 1 THEN NOT coalesce(regexp_matches(a1, '[.]$'), true) AND regexp_matches(a1, 'tion$')
  WHEN 2 THEN NOT coalesce(regexp_matches(a1, '[.]$'), true) AND NOT coalesce(regexp_matches(a2, '[.]$'), true) AND regexp_matches(a2, 'tion$') ELSE false END GROUP BY doc_id, tok""")
def graph_rule_paths(spark, d):
    """Filters, alternatives, optional steps and look-ahead in a path."""
    grammar = r"""
    - {name: noun, label: Noun, type: token, priority: 1, pattern: "[word=/tion$/]"}
    - name: event
      label: Event
      priority: 2
      pattern: |
        trigger = of | in
        theme:Noun = next (next)? [!word=/[.]$/] | (?= next) >> (?! <<{2}) /none/
    """
    found = extract(one_sentence(spark, d), grammar, ["doc_id"]).where("kind = 'event'")
    at = F.regexp_extract("trigger_id", r":(\d+)-\d+$", 1).cast("int")
    return found.groupBy("doc_id", at.alias("start")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {W}, c AS (SELECT doc_id, tok AS start, tok + 1 AS stop FROM w WHERE regexp_matches(word, '^[A-Z]') UNION ALL SELECT c.doc_id, c.start, c.stop + 1 FROM c JOIN w ON w.doc_id = c.doc_id AND w.tok = c.stop WHERE regexp_matches(word, '^d'))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM c""")
def token_rules_fed_by_themselves(spark, d):
    """A rule whose mentions are what it looks for: each round extends those of the last one by a word, until none can be."""
    grammar = r"""
    - {name: first, label: N, type: token, priority: 1, pattern: "[word=/^[A-Z]/]"}
    - {name: more, label: N, type: token, priority: "2+", pattern: "@left:N [word=/^d/]"}
    """
    return extract(one_sentence(spark, d), grammar, ["doc_id"]).select("doc_id", "start", "end")


@query(f"""WITH {W}, n AS (SELECT *, lead(word, 1) OVER o AS a, lead(word, 2) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY tok))
SELECT doc_id, CAST(tok AS INTEGER) AS start, CAST(tok + CASE WHEN regexp_matches(b, '^[a-z]+$') AND NOT regexp_matches(b, 'tion$') THEN 3 ELSE 2 END AS INTEGER) AS "end", CAST(tok + 1 AS INTEGER) AS trigger, CAST(CASE WHEN regexp_matches(b, '^[a-z]+$') AND NOT regexp_matches(b, 'tion$') THEN 2 ELSE 1 END AS INTEGER) AS args
FROM n WHERE regexp_matches(word, 'tion$') AND a IN ('of', 'in')""")
def token_rule_triggers(spark, d):
    """A captured trigger makes an event, other captures its arguments; one of them may stay empty."""
    grammar = r"""[{name: e, label: E, type: token, priority: 1, pattern: "(?<what> [word=/tion$/]) (?<trigger> of | in) (?<of> [word=/^[a-z]+$/ & !word=/tion$/])?"}]"""
    found = extract(one_sentence(spark, d), grammar, ["doc_id"])
    return found.select("doc_id", "start", "end", F.regexp_extract("trigger_id", r":(\d+)-\d+$", 1).cast("int").alias("trigger"), F.size("args").alias("args"))


# --- graphs


@query(f"""WITH RECURSIVE {CHAIN}, n AS (SELECT conv_id, turn, max(tok) AS last FROM w GROUP BY ALL HAVING max(tok) > 0),
ua AS (SELECT conv_id, turn, last AS node, 0 AS k FROM n UNION ALL SELECT conv_id, turn, node // 2, k + 1 FROM ua WHERE node > 0),
ub AS (SELECT conv_id, turn, last - 1 AS node, 0 AS k FROM n UNION ALL SELECT conv_id, turn, node // 2, k + 1 FROM ub WHERE node > 0),
l AS (SELECT ua.conv_id, ua.turn, max(ua.node) AS node FROM ua JOIN ub ON ua.conv_id = ub.conv_id AND ua.turn = ub.turn AND ua.node = ub.node GROUP BY ALL),
m AS (SELECT l.conv_id, l.turn, l.node, min(ua.k) AS ka, min(ub.k) AS kb FROM l JOIN ua ON ua.conv_id = l.conv_id AND ua.turn = l.turn AND ua.node = l.node JOIN ub ON ub.conv_id = l.conv_id AND ub.turn = l.turn AND ub.node = l.node GROUP BY ALL),
p AS (SELECT ua.conv_id, ua.turn, ua.node AS dst, k AS step, '<' AS mark FROM ua JOIN m ON m.conv_id = ua.conv_id AND m.turn = ua.turn WHERE ua.node > m.node
  UNION ALL SELECT ub.conv_id, ub.turn, ub.node, ka + kb - k - 1, '>' FROM ub JOIN m ON m.conv_id = ub.conv_id AND m.turn = ub.turn WHERE ub.node > m.node)
SELECT p.conv_id, p.turn, CAST(step AS INTEGER) AS step, e.src, e.dst, e.rel, mark FROM p JOIN e ON e.conv_id = p.conv_id AND e.turn = p.turn AND e.dst = p.dst""")
def graph_edge_paths(spark, d):
    """The edges, with their directions, between the last two words of each turn."""
    e = chain(spark, d)
    pairs = e.groupBy(*KEYS).agg(F.max("dst").alias("start")).select(*KEYS, F.col("start").cast("int").alias("start"), (F.col("start") - 1).cast("int").alias("end"))
    return graphs.edge_paths(pairs, e, KEYS, undirected=True).select(*KEYS, "step", "src", "dst", "rel", "mark")


def _walk(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("l"))
    w = t.select("conv_id", "turn", F.size("l").alias("n"), F.posexplode("l").alias("tok", "word")).where("tok % 5 <> 0")
    return w.select("conv_id", "turn", ((F.col("tok") * 3 + 1) % F.col("n")).cast("int").alias("src"), F.col("tok").alias("dst"))


@query(r"""WITH RECURSIVE w AS (SELECT conv_id, turn, len(l) AS n, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
e AS (SELECT conv_id, turn, CAST((tok * 3 + 1) % n AS INTEGER) AS src, CAST(tok AS INTEGER) AS dst FROM w WHERE tok % 5 <> 0),
v AS (SELECT conv_id, turn, src AS node FROM e UNION SELECT conv_id, turn, dst FROM e),
c AS (SELECT conv_id, turn, dst AS node, src AS up FROM e UNION SELECT c.conv_id, c.turn, c.node, e.src FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn AND e.dst = c.up),
r AS (SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = v.conv_id AND e.turn = v.turn AND e.dst = v.node)),
u AS (SELECT c.conv_id, c.turn, c.node, min(c.up) AS least FROM c WHERE NOT EXISTS (SELECT 1 FROM c x JOIN r ON r.conv_id = x.conv_id AND r.turn = x.turn AND r.node = x.up WHERE x.conv_id = c.conv_id AND x.turn = c.turn AND x.node = c.node) GROUP BY ALL)
SELECT * FROM r UNION ALL SELECT conv_id, turn, node FROM u WHERE least >= node""")
def graph_all_roots(spark, d):
    """Nodes that no edge leads to, and the smallest ones of circles that none of these leads to."""
    e = _walk(spark, d).withColumn("rel", F.lit("r"))
    nodes = e.select(*KEYS, F.col("src").alias("node")).union(e.select(*KEYS, F.col("dst").alias("node")))
    return graphs.all_roots(nodes, e, KEYS)


@query(r"""WITH RECURSIVE w AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
c AS (SELECT conv_id, turn, tok // 7 AS span, tok AS node FROM w UNION SELECT conv_id, turn, span, node - 1 - node % 3 FROM c WHERE node - 1 - node % 3 >= 7 * span)
SELECT conv_id, turn, CAST(span AS INTEGER) AS span, CAST(node AS INTEGER) AS node FROM c WHERE node - 1 - node % 3 < 7 * span""")
def graph_local_heads(spark, d):
    """Heads of runs of seven tokens, by the edges inside of them."""
    w = text.words(table(spark, d, "conversations"), "conv_id", "turn").select(*KEYS, F.col("tok").cast("int").alias("node"))
    e = w.where("node > 0 and node - 1 - node % 3 >= 0").select(*KEYS, F.expr("node - 1 - node % 3").alias("src"), F.col("node").alias("dst"), F.lit("r").alias("rel"))
    spans = w.select(*KEYS, F.expr("cast(node div 7 as int)").alias("span")).distinct().select(*KEYS, "span", (F.col("span") * 7).alias("begin"), (F.col("span") * 7 + 7).alias("end"))
    return graphs.local_heads(spans, e, w, KEYS)


@query(f"""WITH {CHAIN}, t AS (SELECT conv_id, turn, tok AS node, word, tok // 5 AS span, CASE WHEN tok = 0 THEN 0 ELSE floor(log2(tok)) + 1 END AS depth FROM w),
m AS (SELECT *, min(depth) OVER (PARTITION BY conv_id, turn, span) AS least FROM t)
SELECT conv_id, turn, CAST(span AS INTEGER) AS span, CAST(min(node) AS INTEGER) AS head FROM m WHERE depth = least AND NOT regexp_matches(word, '^(the|of|and|de|la)$') GROUP BY conv_id, turn, span""")
def graph_strict_heads(spark, d):
    """The first of the heads of each run of five tokens that is no word of a list."""
    w = text.words(table(spark, d, "conversations"), "conv_id", "turn").select(*KEYS, F.col("tok").cast("int").alias("node"), "word")
    spans = w.select(*KEYS, F.expr("cast(node div 5 as int)").alias("span")).distinct().select(*KEYS, "span", (F.col("span") * 5).alias("begin"), (F.col("span") * 5 + 5).alias("end"))
    found = graphs.all_heads(spans, chain(spark, d), w.select(*KEYS, "node"), KEYS)
    strict = graphs.strict_heads(found, w.withColumnRenamed("word", "tag"), KEYS, "^(the|of|and|de|la)$")
    return graphs.chosen(strict, KEYS, "first")


# --- learning


def tagged(spark, d):
    """Words of the documents with a label that depends on the one before: B and I of runs of words with a capital, O of others."""
    w = dealt(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("w"))
    w = w.withColumn("_cap", F.transform("w", lambda x: x.rlike("^[A-ZÀ-Þ]")))
    w = w.select("doc_id", "_cap", F.posexplode("w").alias("tok", "word"))
    before = (F.col("tok") % 40 > 0) & F.get("_cap", F.col("tok") - 1)
    label = F.when(~F.get("_cap", F.col("tok")), "O").otherwise(F.when(F.coalesce(before, F.lit(False)), "I").otherwise("B"))
    return w.select("doc_id", F.expr("tok div 40").alias("part"), "tok", label.alias("label"), tagging.word_features("word").alias("features"))


@query()
def sequence_tagger(spark, d):
    """Documents that training leaves out, tagged in both directions: right labels and tokens."""
    rows = tagged(spark, d)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    taggers = tagging.train_both(rows.where(~held), ["doc_id", "part"], order=2, folds=2, size=1 << 10, rounds=10)
    got = tagging.tag_both(rows.where(held), ["doc_id", "part"], taggers)
    joined = rows.where(held).join(got, ["doc_id", "part", "tok"])
    return joined.groupBy("doc_id").agg(F.count_if(F.col("label") == F.col("prediction")).alias("right"), F.count("*").alias("n"))


@query()
def ranking_pairwise(spark, d):
    """Lines of an order ranked by price from quantity, discount and tax: how often the dearest comes first, of orders that training leaves out."""
    lines = table(spark, d, "lineitem")
    dear = F.when(F.col("l_extendedprice") > 50_000, 2).when(F.col("l_extendedprice") > 20_000, 1).otherwise(0)
    features = F.create_map(F.lit(0), F.col("l_quantity") / 50, F.lit(1), F.col("l_discount") * 10, F.lit(2), F.col("l_tax") * 10)
    rows = lines.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("line"), dear.cast("double").alias("label"), features.alias("features"))
    held = F.pmod(F.xxhash64("qid"), F.lit(5)) == 0
    found = ranking.scored(rows.where(held), ranking.train(rows.where(~held), rounds=8))
    return stats.precision_at_1(found, "qid", "label", "score").select(F.round("p_at_1", 2).alias("p_at_1"))


@query()
def forward_selection(spark, d):
    """Groups of features of a line's price, in the order in which they lower the held-out error."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    features = {"quantity": ["l_quantity"], "rates": ["l_discount", "l_tax"], "retail": ["p_retailprice"], "both": ["_both"], "size": ["p_size"]}
    rows = lines.withColumn("_both", F.col("l_quantity") * F.col("p_retailprice")).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)))
    names = [c for g in features.values() for c in g]
    taken = learning.forward_selection(learning.fold_sums(rows, names, "l_extendedprice"), names, features)
    return spark.createDataFrame([(i, g) for i, (g, _) in enumerate(taken)], "step int, feature string")


def _crossed(rows, fit):
    """All rows, each predicted by the machine that was fitted on the half that it isn't in."""
    half = F.pmod(F.xxhash64("key"), F.lit(2))
    rows = written(spread(rows))  # features are made once, for landmarks, classes, training and predictions of both halves
    parts = [kernels.predicted(rows.where(half == i), fit(rows.where(half == 1 - i))) for i in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("""SELECT l_returnflag, count(*) AS n, true AS over_floor FROM lineitem GROUP BY l_returnflag""")
def kernel_machine(spark, d):
    """Lines whose discount and tax lie within a ring, which no line parts from the others: counts by flag, and whether nine in ten are told right by the machine of the other half."""
    place = [(F.col("l_discount") - 0.05) * 20, (F.col("l_tax") - 0.04) * 25]
    ring = place[0] * place[0] + place[1] * place[1]
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("key"), F.array(*place).alias("features"), F.when((ring > 0.2) & (ring < 1), 1).otherwise(0).alias("label"))
    got = _crossed(rows, lambda half: kernels.classifier(half, kernels.Kernel("rbf", 4.0), "key", 1e-4, rounds=8))
    return got.groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.avg((F.col("label") == F.col("prediction")).cast("int")) > 0.9).alias("over_floor"))


#: Letters whose shares in a text tell its language.
LETTERS = "abcdefghijklmnopqrstuvwxyzäößüáéíñóúàâçèêôœ"


def letter_shares(texts):
    """(key, features, label) of (key, text, label): each letter's share of a text's characters, counted by columns of texts."""
    shape = T.StructType([texts.schema["key"], T.StructField("features", T.ArrayType(T.DoubleType())), texts.schema["label"]])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory
                part = b.slice(at, 256)
                found = part.column("text")
                counts = np.column_stack([pc.count_substring(found, c).to_numpy(zero_copy_only=False) for c in LETTERS])
                shares = counts / np.maximum(pc.utf8_length(found).to_numpy(zero_copy_only=False), 1)[:, None]
                ends = pa.array(np.arange(len(shares) + 1, dtype=np.int32) * len(LETTERS))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(ends, pa.array(shares.ravel())), part.column("label")], ["key", "features", "label"])

    return texts.mapInArrow(run, shape)


@query("""SELECT lang, count(*) AS n, true AS over_floor FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang""")
def kernel_machine_languages(spark, d):
    """The languages of whole texts from their letters' shares, a machine for each language: texts by language, and whether over six in ten of them are told right by the machine of the other half."""
    texts = spread(docs(spark, d).where("lang is not null and text is not null").select("doc_id", "text", "lang"))
    rows = letter_shares(texts.select(F.col("doc_id").alias("key"), F.lower("text").alias("text"), F.col("lang").alias("label")))
    got = _crossed(rows, lambda half: kernels.classifier(half, kernels.Kernel("rbf", 20.0), "key", 1e-4, rounds=8))
    return got.groupBy(F.col("label").alias("lang")).agg(F.count("*").alias("n"), (F.avg((F.col("label") == F.col("prediction")).cast("int")) > 0.6).alias("over_floor"))


@query("""SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem GROUP BY l_returnflag""")
def epsilon_regression(spark, d):
    """Quantity after discount and tax, a product of three columns, by a cubic kernel: lines by flag, and whether 99 in 100 lie within the margin, or nearly, for the machine of the other half."""
    features = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5]
    label = F.col("l_quantity") / 50 * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("key"), F.array(*features).alias("features"), label.alias("label"))
    got = _crossed(rows, lambda half: kernels.regression(half, kernels.Kernel("polynomial", 1.0, 3, 1.0), "key", 0.01, 1e-6, landmarks=64, rounds=8))
    near = F.abs(F.col("prediction") - F.col("label")) < 0.012
    return got.groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.avg(near.cast("int")) > 0.99).alias("within"))
