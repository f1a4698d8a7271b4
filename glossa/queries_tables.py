"""More queries of native operators, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.numbers import numbers_of, with_norms
from glossa.functions.strings import day_replaced, last_weeks
from glossa.operators import graphs, lexicon, mentions, stats, text
from glossa.plans.lineage import spread
from glossa.queries import CHAIN, KEYS, W, chain, docs, query, table, words

_SPANS = f"""{W}, a AS (SELECT DISTINCT doc_id, CAST(tok AS INTEGER) AS start, CAST(tok + 1 + tok % 4 AS INTEGER) AS "end" FROM w WHERE word = 'the')"""


def _spans(spark, d):
    return words(spark, d).where("word = 'the'").select("doc_id", F.col("tok").alias("start"), (F.col("tok") + 1 + F.col("tok") % 4).alias("end"))


# --- documents and sentences


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, sent, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l)
SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(a AS INTEGER) AS "begin", CAST(a + n AS INTEGER) AS "end" FROM o""")
def documents_of_sentences(spark, d):
    """Lines as given sentences, whose offsets go on through the document."""
    return text.lines_as_sentences(docs(spark, d), "doc_id")


@query(f"""WITH {W}, o AS (SELECT doc_id, tok, length(word) AS n, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM w)
SELECT doc_id, CAST(tok AS INTEGER) AS tok, CAST(a AS INTEGER) AS start, CAST(a + n AS INTEGER) AS "end" FROM o""")
def documents_of_tokens(spark, d):
    """Offsets made for tokens that come without."""
    return text.made_offsets(words(spark, d), "doc_id")


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM documents)
SELECT doc_id, array_to_string(list_reverse(l), ' ') AS backwards, md5(array_to_string(l, chr(31))) AS ordered, md5(array_to_string(list_sort(l), chr(31))) AS unordered FROM l""")
def reversed_and_hashed(spark, d):
    """Sentences from right to left, and hashes with and without regard to order."""
    l = docs(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("l"))  # noqa: E741
    s = l.withColumn("s", text.reversed_layers(F.struct(F.col("l").alias("words")), ["words"]))
    return s.select("doc_id", F.array_join("s.words", " ").alias("backwards"), text.ordered_hash(F.col("l")).alias("ordered"), text.unordered_hash(F.col("l")).alias("unordered"))


@query(f"WITH {W} SELECT doc_id, CAST(tok - 5 AS INTEGER) AS tok, word FROM w WHERE tok >= 5 AND tok < 25")
def token_ranges(spark, d):
    """Tokens 5 to 24 of each document, numbered anew."""
    return text.tokens_between(words(spark, d), "doc_id", first=5, last=25)


# --- counters and selections


@query(r"""WITH c AS (SELECT source, word, count(*)::DOUBLE AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[^ \t\n\r]+')) AS word FROM documents) GROUP BY ALL)
SELECT source, sum(n) AS l1, round(sqrt(sum(n * n)), 6) AS l2 FROM c GROUP BY source""")
def counter_norms(spark, d):
    c = docs(spark, d).select("source", F.explode(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("word")).groupBy("source", "word").agg(F.count("*").cast("double").alias("n"))
    return stats.norms(c, "source").withColumn("l2", F.round("l2", 6))


@query("""WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents), b AS (SELECT greatest(0, least(11, ceil((n_chars - lo) * 12 / (hi - lo)) - 1))::INTEGER AS bucket FROM documents, e WHERE n_chars IS NOT NULL)
SELECT CAST(r.range AS INTEGER) AS bucket, CAST(count(b.bucket) AS BIGINT) AS n FROM range(12) r LEFT JOIN b ON b.bucket = r.range GROUP BY r.range""")
def histogram_equal(spark, d):
    return stats.equal_histogram(docs(spark, d), "n_chars", 12)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def n_best_documents(spark, d):
    return stats.n_best(docs(spark, d).select("doc_id", "n_chars"), 25, "n_chars", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 40")
def n_random_documents(spark, d):
    return stats.n_sampled(docs(spark, d).select("doc_id"), 40, "doc_id", 7)


_BY_LANG = r"c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^ \t\n\r]+')) AS word FROM documents) GROUP BY ALL)"


def _by_lang(spark, d):
    return docs(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(f"WITH {_BY_LANG}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) SELECT lang, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def top_words_by_language(spark, d):
    """The ten most frequent words of each language, by heaps of ten a task."""
    return stats.top_per_group(_by_lang(spark, d), 10, "lang", "n", "word")


@query(f"""WITH {W}, f AS (SELECT lang, word, min((w.doc_id, tok)) AS place FROM w JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE NOT regexp_matches(word, '^x') GROUP BY ALL)
SELECT lang, word, CAST(row_number() OVER (PARTITION BY lang ORDER BY place, word) - 1 AS INTEGER) AS index FROM f""")
def lexicon_of_indices(spark, d):
    """Words numbered as they come first in a language; those that begin with x are taken out."""
    l = docs(spark, d).select("doc_id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0))).alias("tok", "word"))  # noqa: E741
    return stats.indexed(l.where("not word rlike '^x'"), "lang", "word", "doc_id", "tok")


@query(f"""WITH {W}, g AS (SELECT doc_id, tok, word FROM w WHERE regexp_matches(word, '^[0-9]')), p AS (SELECT doc_id, tok, word FROM w WHERE regexp_matches(word, '[0-9]$')),
c AS (SELECT (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM g JOIN p USING (doc_id, tok, word)) AS hit),
s AS (SELECT CASE WHEN p > 0 THEN hit / p ELSE 0.0 END AS precision, CASE WHEN g > 0 THEN hit / g ELSE 0.0 END AS recall FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM s""")
def time_span_scores(spark, d):
    """Micro scores of exact spans: words that begin with a digit against words that end with one."""
    w = words(spark, d)
    found = stats.micro_scores(w.where("word rlike '^[0-9]'"), w.where("word rlike '[0-9]$'"), ["doc_id", "tok", "word"])
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


# --- spans


@query(rf"""WITH {W} SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM w WHERE regexp_matches(word, '\p{{L}}') AND (length(word) > 3 OR regexp_matches(word, '[0-9]') OR regexp_matches(word, '\p{{Lu}}') OR word IN ('of', 'the')) GROUP BY doc_id""")
def contentful_words(spark, d):
    known = F.array(F.lit("of"), F.lit("the"))
    return words(spark, d).where(lexicon.contentful(F.array("word"), known)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_SPANS}, g AS (SELECT doc_id, start, "end" FROM a WHERE start % 4 > 0), c AS (SELECT doc_id, start + 1 AS start, "end" + 1 AS "end" FROM a)
SELECT doc_id, start, "end", 'X' AS label FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id AND ((g.start < c.start AND c.start < g."end") OR (g.start < c."end" AND c."end" < g."end")))""")
def entities_merged(spark, d):
    """Entities of a lexicon that don't cut through those found before."""
    a = _spans(spark, d)
    custom = a.select("doc_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.lit("X").alias("label"))
    return lexicon.accepted(custom, a.where("start % 4 > 0"), "doc_id")


@query(f"""WITH {W}, e AS (SELECT doc_id, tok, CASE WHEN regexp_matches(word, '^[Tt]') THEN 'B-MEASUREMENT-LENGTH' WHEN regexp_matches(word, '^[aA]') THEN 'B-LOC' ELSE 'O' END AS entity FROM w),
f AS (SELECT *, first_value(CASE WHEN entity <> 'B-MEASUREMENT-LENGTH' THEN entity END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e)
SELECT doc_id, CAST(tok AS INTEGER) AS tok, CASE WHEN entity = 'B-MEASUREMENT-LENGTH' AND next = 'B-LOC' THEN 'O' ELSE entity END AS entity FROM f""")
def lengths_before_places(spark, d):
    """Lengths right before a place aren't lengths."""
    w = F.col("word")
    e = words(spark, d).select("doc_id", "tok", F.when(w.rlike("^[Tt]"), "B-MEASUREMENT-LENGTH").when(w.rlike("^[aA]"), "B-LOC").otherwise("O").alias("entity"))
    return lexicon.cleared_before(e, "doc_id", cleared="MEASUREMENT-LENGTH$", before="B-LOC")


@query(f"""WITH {_SPANS}, b AS (SELECT DISTINCT doc_id, start - start % 3 AS start, "end" FROM a)
SELECT doc_id, CAST(start AS INTEGER) AS start, "end" FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND x.start < y."end" AND (y.start, y."end") <> (x.start, x."end")
AND (y."end" - y.start > x."end" - x.start OR (y."end" - y.start = x."end" - x.start AND y.start < x.start)))""")
def longest_overlapping(spark, d):
    """Of overlapping spans those that no other beats."""
    b = _spans(spark, d).select("doc_id", (F.col("start") - F.col("start") % 3).alias("start"), "end")
    return mentions.longest_of_overlapping(b, ["doc_id"])


_COREF = f"""{W}, m AS (SELECT doc_id, lower(word) AS chain, CAST(tok // 2 AS INTEGER) AS head, CAST(tok AS INTEGER) AS start, CAST(tok + 1 + length(word) % 3 AS INTEGER) AS "end" FROM w WHERE regexp_matches(word, '^[A-Z]')),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, head ORDER BY "end" - start DESC, start) = 1)"""


def _coref(spark, d):
    w = words(spark, d).where("word rlike '^[A-Z]'")
    return w.select("doc_id", F.lower("word").alias("chain"), F.expr("cast(tok div 2 as int)").alias("head"), F.col("tok").alias("start"), (F.col("tok") + 1 + F.length("word") % 3).alias("end"))


@query(f'WITH {_COREF} SELECT doc_id, chain, head, start, "end" FROM t')
def coref_top_mentions(spark, d):
    return mentions.top_of_head(_coref(spark, d), ["doc_id"])


@query(f'WITH {_COREF} SELECT doc_id, chain, head, start, "end" FROM t WHERE (doc_id, chain) IN (SELECT doc_id, chain FROM t WHERE head < 10)')
def coref_chains(spark, d):
    """All mentions of the chains that a head among the first ten belongs to."""
    top = mentions.top_of_head(_coref(spark, d), ["doc_id"])
    return mentions.chain_of(top.where("head < 10").select("doc_id", "head"), top, ["doc_id"])


# --- dates


@query("""SELECT o_orderkey, regexp_replace(strftime(o_orderdate, '%Y-%m-%d'), '[^-]*$', lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0')) AS date FROM orders""")
def days_replaced(spark, d):
    return table(spark, d, "orders").select("o_orderkey", day_replaced(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 28 + 1).alias("date"))


@query("""WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') AS head, CASE WHEN month(o_orderdate) = 2 THEN 28 WHEN month(o_orderdate) IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS n FROM orders)
SELECT o_orderkey, head || (n - 6) || ' -- ' || head || n AS last, head || (n - 13) || ' -- ' || head || n AS last_two, head || lpad(CAST(n - 20 AS VARCHAR), 2, '0') || ' -- ' || head || n AS last_three FROM m""")
def week_ranges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    y, m = F.col("y"), F.col("m")
    return o.select("o_orderkey", last_weeks(y, m, 1).alias("last"), last_weeks(y, m, 2).alias("last_two"), last_weeks(y, m, 3).alias("last_three"))


# --- graphs

#: A word's head is another by a rule of its own, so that some walks end at a root and others in a circle.
_WALK = r"""w AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS tok, len(l) AS n FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
e AS (SELECT conv_id, turn, CAST((tok * 3 + 1) % n AS INTEGER) AS src, CAST(tok AS INTEGER) AS dst FROM w WHERE tok % 5 <> 0)"""


@query(f"""WITH RECURSIVE {_WALK}, c AS (SELECT conv_id, turn, dst AS node, src AS up FROM e UNION SELECT c.conv_id, c.turn, c.node, e.src FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn AND e.dst = c.up),
round AS (SELECT conv_id, turn, node FROM c WHERE node = up) SELECT DISTINCT c.conv_id, c.turn, c.node FROM c JOIN round r ON r.conv_id = c.conv_id AND r.turn = c.turn AND (r.node = c.up OR r.node = c.node)""")
def graph_cycles(spark, d):
    """Nodes whose walk upwards runs into a circle."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("l"))
    w = t.select("conv_id", "turn", F.size("l").alias("n"), F.posexplode("l").alias("tok", "word")).where("tok % 5 <> 0")
    e = w.select("conv_id", "turn", ((F.col("tok") * 3 + 1) % F.col("n")).cast("int").alias("src"), F.col("tok").alias("dst"))
    return graphs.endless(e, KEYS)


@query(f"""WITH RECURSIVE {CHAIN}, c AS (SELECT DISTINCT conv_id, turn, src AS start, src AS node FROM e UNION SELECT c.conv_id, c.turn, c.start, e.dst FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn AND e.src = c.node)
SELECT conv_id, turn, start, CAST(min(node) AS INTEGER) AS first, CAST(max(node) AS INTEGER) AS last FROM c GROUP BY ALL""")
def graph_extents(spark, d):
    """The interval that a node's descendants span."""
    e = chain(spark, d)
    return graphs.extents(e.select(*KEYS, F.col("src").alias("start"), F.col("src").alias("node")).distinct(), e, KEYS, 24)


@query(f"""WITH {CHAIN}, t AS (SELECT conv_id, turn, tok AS node, floor(log2(tok + 1)) AS x, CASE WHEN tok = 0 THEN 0 ELSE floor(log2(tok)) + 1 END AS depth FROM w),
s AS (SELECT *, node // 5 AS span FROM t) SELECT conv_id, turn, CAST(span AS INTEGER) AS span, CAST(arg_min(node, (depth, -node)) AS INTEGER) AS head FROM s GROUP BY conv_id, turn, span""")
def graph_heads(spark, d):
    """The head of each run of five tokens: the last of those nearest to the root."""
    w = text.words(table(spark, d, "conversations"), "conv_id", "turn").select(*KEYS, F.col("tok").alias("node"))
    spans = w.select(*KEYS, F.expr("cast(node div 5 as int)").alias("span")).distinct().select(*KEYS, "span", (F.col("span") * 5).alias("begin"), (F.col("span") * 5 + 5).alias("end"))
    return graphs.heads(spans, chain(spark, d), w, KEYS, 24)


_RELS = r"""w AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
e AS (SELECT conv_id, turn, CAST(tok // 2 AS INTEGER) AS src, CAST(tok AS INTEGER) AS dst, ['nmod', 'case', 'conj', 'cc', 'nsubj', 'xcomp', 'cop'][1 + (length(word) + tok) % 7] AS rel FROM w WHERE tok > 0)"""


def _rels(spark, d):
    w = text.words(table(spark, d, "conversations"), "conv_id", "turn")
    rel = F.element_at(F.array(*map(F.lit, ("nmod", "case", "conj", "cc", "nsubj", "xcomp", "cop"))), (1 + (F.length("word") + F.col("tok")) % 7).cast("int"))
    return w.where("tok > 0").select(*KEYS, F.expr("cast(tok div 2 as int)").alias("src"), F.col("tok").alias("dst"), rel.alias("rel")), w.select(*KEYS, F.col("tok").alias("node"), "word")


@query(f"""WITH {_RELS}, k AS (SELECT e.conv_id, e.turn, e.src AS dst, arg_min(word, e.dst) AS mark FROM e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn AND w.tok = e.dst WHERE rel = 'case' GROUP BY ALL)
SELECT e.conv_id, e.turn, e.src, e.dst, CASE WHEN rel = 'nmod' AND mark IS NOT NULL THEN 'nmod_' || lower(mark) ELSE rel END AS rel FROM e LEFT JOIN k ON k.conv_id = e.conv_id AND k.turn = e.turn AND k.dst = e.dst""")
def graph_collapsed(spark, d):
    """Prepositions in the labels of what they mark."""
    e, w = _rels(spark, d)
    return graphs.collapsed(e, w, KEYS)


@query(f"""WITH {_RELS}, k AS (SELECT e.conv_id, e.turn, e.src, arg_min(lower(word), e.dst) AS mark FROM e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn AND w.tok = e.dst WHERE rel = 'cc' GROUP BY ALL)
SELECT e.conv_id, e.turn, e.src, e.dst, CASE WHEN rel = 'conj' AND coalesce(o.mark, h.mark) IS NOT NULL THEN 'conj_' || coalesce(o.mark, h.mark) ELSE rel END AS rel FROM e
LEFT JOIN k o ON o.conv_id = e.conv_id AND o.turn = e.turn AND o.src = e.dst LEFT JOIN k h ON h.conv_id = e.conv_id AND h.turn = e.turn AND h.src = e.src""")
def graph_conjunctions(spark, d):
    """Conjunctions in the labels of conjuncts."""
    e, w = _rels(spark, d)
    return graphs.with_conjunctions(e, w, KEYS)


@query(f"""WITH {_RELS} SELECT * FROM e UNION SELECT x.conv_id, x.turn, x.dst, s.dst, 'nsubj:xsubj' FROM e x JOIN e s ON s.conv_id = x.conv_id AND s.turn = x.turn AND s.src = x.src AND s.rel = 'nsubj' WHERE x.rel = 'xcomp'
UNION SELECT x.conv_id, x.turn, x.dst, s.dst, 'nsubj' FROM e x JOIN e s ON s.conv_id = x.conv_id AND s.turn = x.turn AND s.src = x.src AND s.rel = 'nsubj' WHERE x.rel = 'cop'""")
def graph_subjects(spark, d):
    """Subjects of complements and of copulas."""
    e, _ = _rels(spark, d)
    return graphs.merged([graphs.subjects_of_complements(e, KEYS), graphs.copular_subjects(e, KEYS)], KEYS)


# --- numbers, labels and words

_UNITS, _TENS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN (l_partkey % 9 + 1) * 100 + (l_suppkey % 8 + 2) * 10 WHEN 2 THEN -l_quantity ELSE l_quantity / 4 END::DOUBLE AS value FROM lineitem""")
def number_words(spark, d):
    """Numbers in digits and words, made of each line's figures."""
    q = F.col("l_quantity").cast("int").cast("string")
    word = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int"))
    spoken = F.concat(word(_UNITS, F.col("l_partkey") % 9 + 1), F.lit(" hundred and "), word(_TENS, F.col("l_suppkey") % 8 + 1))
    kind = F.col("l_orderkey") % 4
    said = F.when(kind == 0, F.concat(q, F.lit(" thousand"))).when(kind == 1, spoken).when(kind == 2, F.concat(F.lit("minus "), q)).otherwise(F.concat(q, F.lit("/4")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers_of(said).alias("value"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t, o_orderdate + INTERVAL 65 DAY AS u, o_orderkey % 97 + 2 AS n, o_orderkey % 18 AS kind FROM orders),
e AS (SELECT *, CASE WHEN month(t) = 2 THEN 28 WHEN month(t) IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS days FROM o)
SELECT k AS o_orderkey, CASE WHEN kind IN (0, 5, 9, 10) THEN 'DATE' WHEN kind = 3 THEN 'MEASUREMENT-LENGTH' WHEN kind = 4 THEN 'PERCENTAGE' WHEN kind = 7 THEN 'MEASUREMENT-AREA' ELSE 'DATE-RANGE' END AS label, CASE kind
WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%Y-%m-%d') || ' -- ' || strftime(u, '%Y-%m-%d') WHEN 2 THEN strftime(t, '%Y-XX-XX -- ref-date') WHEN 3 THEN n || '.0 km' WHEN 4 THEN n || '.0 %' WHEN 5 THEN strftime(t, '%Y-%m-%d')
WHEN 6 THEN strftime(t, 'XXXX-XX-XX -- %Y-%m-XX') WHEN 7 THEN n || '.0 -- ' || (n + 5) || '.0 ha' WHEN 8 THEN strftime(t, '%Y-06-21 -- %Y-09-22') WHEN 9 THEN strftime(t, '%Y-%m-XX') WHEN 10 THEN strftime(t, '%Y-%m-XX')
WHEN 11 THEN strftime(u, '%Y-') || strftime(t, '%m-XX -- ') || strftime(u, '%Y-%m-XX') WHEN 12 THEN strftime(t, 'XXXX-%m-01 -- XXXX-%m-14') WHEN 13 THEN strftime(t, 'XXXX-%m-') || (days - 6) || strftime(t, ' -- XXXX-%m-') || days
WHEN 14 THEN (year(t) + 1) || '-03-20 -- XXXX-XX-XX' WHEN 15 THEN strftime(t, '%Y-%m-02 -- %Y-%m-09') WHEN 16 THEN strftime(t, 'ref-date -- %Y-09-22') ELSE year(t) || '-06-21 -- ' || (year(t) + 1) || '-09-22' END AS norm FROM e""")
def numeric_norms(spark, d):
    """Dates, ranges of many kinds and measurements, made of each order's date and key, normed by the rule engine."""
    t, u, n = F.col("o_orderdate"), F.date_add("o_orderdate", 65), (F.col("o_orderkey") % 97 + 2).cast("string")
    f = F.date_format
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kinds = [
        f(t, "MMMM d , yyyy"), say("from ", f(t, "MMMM d , yyyy"), " to ", f(u, "MMMM d , yyyy")), say("since ", f(t, "yyyy")), say("it was ", n, " km"), say(n, " percent"), f(t, "d MMMM yyyy"),
        say("before ", f(t, "MMMM yyyy")), say(n, " - ", (F.col("o_orderkey") % 97 + 7).cast("string"), " ha"), say("summer of ", f(t, "yyyy")), f(t, "yyyy-MM"), f(t, "MM/yyyy"),
        say("from ", f(t, "MMMM"), " to ", f(u, "MMMM yyyy")), say("first two weeks of ", f(t, "MMMM")), say("last week of ", f(t, "MMMM")), say("after winter ", f(t, "yyyy")), say("between 2 and 9 ", f(t, "MMMM yyyy")),
        say("until fall ", f(t, "yyyy")), say("from spring ", f(t, "yyyy"), " to autumn ", (F.year(t) + 1).cast("string")),
    ]
    said = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 18 + 1).cast("int"))
    found = with_norms(table(spark, d, "orders").select("o_orderkey", said.alias("said")), "said")
    return found.select("o_orderkey", F.inline("norms"))


_DISTINCT = f"{W}, x AS (SELECT DISTINCT word FROM w)"
_ENDINGS = ("'s", "'d", "n't", "'m", "'ll", "'ve", "'re", "")


@query(f"""WITH {_DISTINCT}, e AS (SELECT word || ['''s', '''d', 'n''t', '''m', '''ll', '''ve', '''re', ''][length(word) % 8 + 1] AS word FROM x UNION SELECT unnest(['won''t', 'Can''t', 'shan''t', 'let''s', 'ain''t'])), l AS (SELECT DISTINCT word, lower(word) AS low FROM e)
SELECT word, CASE WHEN low = 'won''t' THEN ['will', 'not'] WHEN low = 'can''t' THEN ['can', 'not'] WHEN low = 'shan''t' THEN ['shall', 'not'] WHEN low IN ('let''s', 'cont''d', 'ain''t') THEN [word]
WHEN ends_with(low, '''s') THEN [left(word, length(word) - 2), '''s'] WHEN ends_with(low, '''d') THEN [left(word, length(word) - 2), '''d'] WHEN ends_with(low, 'n''t') THEN [left(word, length(word) - 3), 'not'] WHEN ends_with(low, '''m') THEN [left(word, length(word) - 2), 'am']
WHEN ends_with(low, '''ll') THEN [left(word, length(word) - 3), 'will'] WHEN ends_with(low, '''ve') THEN [left(word, length(word) - 3), 'have'] WHEN ends_with(low, '''re') THEN [left(word, length(word) - 3), 'are'] ELSE [word] END AS parts FROM l""")
def contractions(spark, d):
    """Parts of each word of the documents with an ending of contractions, and of the irregular ones."""
    x = words(spark, d).select("word").distinct()
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), F.length("word") % 8 + 1)
    few = spark.createDataFrame([(w,) for w in ("won't", "Can't", "shan't", "let's", "ain't")], "word string")
    each = x.select(F.concat("word", ending).alias("word")).union(few).distinct()
    return each.select("word", text.contraction_parts(F.col("word")).alias("parts"))


@query(rf"""WITH {_DISTINCT}, e AS (SELECT ['mid-', 'bi-', 'semi-', 'non-', 'all-', 'x-', ''][length(word) % 7 + 1] || word AS word FROM x)
SELECT DISTINCT word, CASE WHEN regexp_matches(word, '^(mid|bi|semi|non|all)-[A-Za-z0-9_]+$') THEN [split_part(word, '-', 1), split_part(word, '-', 2)] ELSE [word] END AS parts FROM e""")
def hyphens(spark, d):
    """Parts of each word of the documents behind a prefix."""
    prefix = F.element_at(F.array(*map(F.lit, ("mid-", "bi-", "semi-", "non-", "all-", "x-", ""))), F.length("word") % 7 + 1)
    each = words(spark, d).select("word").distinct().select(F.concat(prefix, "word").alias("word")).distinct()
    return each.select("word", text.hyphen_parts(F.col("word")).alias("parts"))


@query(r"""WITH t AS (SELECT doc_id, '[' || doc_id || ',3-5] ' || text || ' [7].' AS text FROM documents),
p AS (SELECT doc_id, string_split_regex(text, '\[[0-9]+(?:[,-] ?[0-9]+)*\]') AS parts, regexp_extract_all(text, '\[[0-9]+(?:[,-] ?[0-9]+)*\]') AS found FROM t)
SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(repeat(' ', length(found[i])), '')), '') AS text FROM p""")
def references_removed(spark, d):
    """References blanked in each document, which gets two more."""
    t = F.concat(F.lit("["), F.col("doc_id"), F.lit(",3-5] "), F.col("text"), F.lit(" [7]."))
    return docs(spark, d).select("doc_id", text.without_references(t).alias("text"))


_LOOSE = f"{W}, t AS (SELECT doc_id, CAST(tok AS INTEGER) AS tok, CASE WHEN tok % 7 < 3 THEN 'I-A' WHEN tok % 7 = 3 THEN 'I-B' WHEN tok % 7 = 5 THEN 'B-C' ELSE 'O' END AS entity FROM w)"


@query(f"""WITH {_LOOSE}, b AS (SELECT *, lag(entity) OVER (PARTITION BY doc_id ORDER BY tok) AS before FROM t)
SELECT doc_id, tok, CASE WHEN entity LIKE 'I-%' AND (before IS NULL OR before = 'O' OR substr(before, 3) <> substr(entity, 3)) THEN 'B-' || substr(entity, 3) ELSE entity END AS entity FROM b""")
def bio_patched(spark, d):
    """Labels of each word that continue nothing."""
    place = F.col("tok") % 7
    loose = words(spark, d).select("doc_id", "tok", F.when(place < 3, "I-A").when(place == 3, "I-B").when(place == 5, "B-C").otherwise("O").alias("entity"))
    return lexicon.patched(loose, "doc_id").select("doc_id", "tok", "entity")


@query(f"""WITH {W}, t AS (SELECT doc_id, CAST(tok AS INTEGER) AS tok, CASE WHEN regexp_matches(word, '^[Tt]') THEN 'B-X' ELSE 'O' END AS into_, CASE tok % 7 WHEN 0 THEN 'B-A' WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-A' ELSE 'O' END AS source FROM w),
r AS (SELECT doc_id, tok // 7 AS run FROM t WHERE source <> 'O' GROUP BY ALL HAVING count(*) FILTER (into_ <> 'O') = 0)
SELECT t.doc_id, t.tok, CASE WHEN r.run IS NOT NULL AND source <> 'O' THEN source ELSE into_ END AS labels FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.run = t.tok // 7""")
def labels_merged(spark, d):
    """Entities every seven words, copied where no word begins with a t."""
    place = F.col("tok") % 7
    t = words(spark, d).select("doc_id", "tok", F.when(F.col("word").rlike("^[Tt]"), "B-X").otherwise("O").alias("into_"), F.when(place == 0, "B-A").when(place < 3, "I-A").otherwise("O").alias("source"))
    return mentions.with_merged_labels(t, ["doc_id"], "into_", "source").select("doc_id", "tok", "labels")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber::INTEGER AS a, (l_linenumber + l_quantity % 6)::INTEGER AS b, (l_partkey % 9)::INTEGER AS x, (l_partkey % 9 + l_suppkey % 4)::INTEGER AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, a <= x AND b >= y AS holds, a < y AND x < b AND a < b AND x < y AS meets FROM t""")
def interval_predicates(spark, d):
    """Two intervals made of each line's figures."""
    a, x = F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 9).cast("int")
    b, y = (a + F.col("l_quantity") % 6).cast("int"), (x + F.col("l_suppkey") % 4).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mentions.contains(a, b, x, y).alias("holds"), mentions.overlaps(a, b, x, y).alias("meets"))


@query("""WITH RECURSIVE t AS (SELECT 'all' AS name, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders), c AS (SELECT name, name AS above, 0 AS depth FROM t UNION ALL SELECT c.name, t.parent, depth + 1 FROM c JOIN t ON t.name = c.above WHERE t.parent IS NOT NULL) SELECT name, above, depth FROM c""")
def taxonomy_closure(spark, d):
    """Orders, customers, nations and regions as labels, with all that they are a kind of."""
    of = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), F.col(x)).alias("name"), F.concat(F.lit(b), F.col(y)).alias("parent"))
    top = spark.createDataFrame([("all", None)], "name string, parent string").union(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")), F.lit("all")))
    nodes = top.union(of("nation", "n", "n_nationkey", "r", "n_regionkey")).union(of("customer", "c", "c_custkey", "n", "c_nationkey")).union(of("orders", "o", "o_orderkey", "c", "o_custkey"))
    return mentions.hypernyms(nodes)


# --- sources and open entities


@query(f"""WITH {_DISTINCT} SELECT word AS phrase, 'WORD' AS label FROM x WHERE length(word) % 3 <> 0 AND word NOT LIKE '#%' AND word NOT LIKE '//%' AND word NOT LIKE '%//%'""")
def lexicon_lines(spark, d):
    """A lexicon's lines, made of all words: some with a comment behind, some commented out."""
    w = words(spark, d).select("word").distinct().where("word not like '%//%' and word not like '#%'")
    lines = w.select(F.when(F.length("word") % 3 == 0, F.concat(F.lit("# "), "word")).when(F.length("word") % 3 == 1, F.concat("word", F.lit("  // said twice"))).otherwise(F.col("word")).alias("value"))
    return lexicon.read_lexicon(lines, "WORD")


@query("""SELECT 'c' || c_custkey AS phrase, CAST(c_nationkey AS VARCHAR) AS label FROM customer WHERE c_custkey % 4 <> 0""")
def override_lines(spark, d):
    """Lines of two or three columns; those without a tab are passed over."""
    k = F.concat(F.lit("c"), "c_custkey")
    value = F.when(F.col("c_custkey") % 4 == 0, k).when(F.col("c_custkey") % 4 == 1, F.concat_ws("\t", k, F.lit("old"), "c_nationkey")).otherwise(F.concat_ws("\t", k, "c_nationkey"))
    return lexicon.read_overrides(table(spark, d, "customer").select(value.alias("value")))


@query("""SELECT 'p' || p_partkey AS phrase, 'n' || p_partkey % 50 AS norm, CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey % 5 ELSE '' END AS unit_class FROM part""")
def normed_lines(spark, d):
    """Lines of a phrase with its norm, and its class or none."""
    k = F.col("p_partkey")
    value = F.concat(F.lit("p"), k, F.lit(" // n"), k % 50, F.when(k % 2 == 0, F.concat(F.lit("::K"), k % 5)).otherwise(F.lit("")))
    return lexicon.read_normed(table(spark, d, "part").select(value.alias("value")))


@query("""SELECT l_orderkey AS qid, (l_linenumber % 2)::DOUBLE AS label, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity + l_discount), 4) AS total FROM lineitem GROUP BY ALL""")
def svmlight_round_trip(spark, d):
    """Ranking lines of each order's items, written and read again."""
    from glossa.sources.columns import read_svmlight, svmlight_lines

    items = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))
    rows = items.select((F.col("l_linenumber") % 2).cast("double").alias("label"), F.col("l_orderkey").cast("string").alias("qid"), F.create_map(F.lit(3), F.col("l_quantity"), F.lit(1), F.col("l_discount")).alias("features"))
    read = read_svmlight(svmlight_lines(rows)).select(F.col("qid").cast("long").alias("qid"), "label", (F.col("features")[1] + F.col("features")[3]).alias("x"))
    return read.groupBy("qid", "label").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations))
SELECT conv_id, turn, CAST(tok AS INTEGER) AS tok, concat_ws(chr(9), (tok + 1)::VARCHAR, word, lower(word), '_', '_', 'O', tok::VARCHAR, CASE WHEN tok = 0 THEN 'root' ELSE 'next' END, '_', '_') AS line FROM w""")
def conllu_columns(spark, d):
    """Each turn in ten columns, its words a chain."""
    from glossa.sources.columns import conllu_lines

    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("w"))
    edges = F.expr("transform(slice(w, 2, size(w)), (x, i) -> named_struct('source', i, 'destination', i + 1, 'relation', 'next'))")
    none = F.lit(None).cast("array<string>")
    s = F.struct(F.col("w").alias("words"), F.transform("w", F.lower).alias("lemmas"), none.alias("tags"), none.alias("chunks"), F.transform("w", lambda x: F.lit("O")).alias("entities"), none.alias("norms"), F.create_map(F.lit("universal-enhanced"), edges).alias("graphs"))
    return conllu_lines(t.select("conv_id", "turn", F.array(s).alias("sentences")), "conv_id", "turn").drop("sent")


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS tok FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
t AS (SELECT *, ['JJ', 'NN', 'NNS', 'VB'][1 + (length(word) + tok) % 4] AS tag FROM w), p AS (SELECT *, lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY tok) AS before FROM t),
r AS (SELECT *, sum(CASE WHEN tag = 'VB' OR before IS NULL OR before = 'VB' OR (tag = 'JJ' AND before LIKE 'NN%') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY tok) AS run FROM p)
SELECT conv_id, turn, CAST(min(tok) AS INTEGER) AS start, CAST(max(tok) + 1 AS INTEGER) AS "end" FROM r WHERE tag <> 'VB' GROUP BY conv_id, turn, run
HAVING bool_or(tag LIKE 'NN%') AND count(*) <= 10 AND bool_or(length(word) > 1) AND count(*) FILTER (word = '(') = count(*) FILTER (word = ')')""")
def open_entities(spark, d):
    """Noun phrases by tags, cut and filtered."""
    from glossa.operators import openie

    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(text.BLANKS), F.lit(0)).alias("w"))
    tag = F.transform("w", lambda x, i: F.element_at(F.array(*map(F.lit, ("JJ", "NN", "NNS", "VB"))), 1 + (F.length(x) + i) % 4))
    found = openie.entities(t.select("conv_id", "turn", F.array(F.struct(F.col("w").alias("words"), tag.alias("tags"))).alias("sentences")), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "start", "end")
