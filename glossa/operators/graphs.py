"""Graphs of sentences: edges (keys, src, dst, rel), keyed by document and sentence, which bound every iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import searches
from glossa.plans.lineage import cut


def closure(front: DataFrame, edges: DataFrame, keys: list[str], hops: int | None = None, back: bool = False, rel: str | None = None) -> DataFrame:
    """(keys, start, node, depth): what can be reached, within `hops` or, without a number, at all, along labels that fit the regex `rel`, with the least depth, the start itself at 0."""
    a, b = ("dst", "src") if back else ("src", "dst")
    e = edges.where(F.col("rel").rlike(rel)) if rel else edges
    kinds = front.select("start", "node").union(e.select(a, b)).schema
    rows = searches.rows_of(e, keys, searches.EDGE, a, b).union(searches.rows_of(front, keys, searches.START, "start", "node"))
    found = searches.searched(rows, keys, searches.reached(hops), "start long, node long, depth int")
    return found.select(*keys, searches.given_back("start", front.schema["start"].dataType.simpleString()), searches.given_back("node", kinds["node"].dataType.simpleString()), "depth")


def roots(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node) that no edge leads to."""
    return nodes.join(edges.select(*keys, F.col("dst").alias("node")), [*keys, "node"], "left_anti").select(*keys, "node")


def all_roots(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): nodes without incoming edges, and, of nodes that none of these leads to, those that no smaller one leads to: the smallest of each such circle."""
    rows = searches.rows_of(edges, keys, searches.EDGE, "src", "dst").union(searches.rows_of(nodes, keys, searches.START, "node", "node"))
    return searches.searched(rows, keys, searches.tops, "node long").select(*keys, searches.given_back("node", nodes.schema["node"].dataType.simpleString()))


def edge_paths(pairs: DataFrame, edges: DataFrame, keys: list[str], undirected: bool = False) -> DataFrame:
    """(keys, start, end, step, src, dst, rel, mark): the edges of a shortest path between each pair (keys, start, end), from step 0; mark is > along an edge and < against it.

    Of nodes that lead on equally fast the smallest is taken, and all edges between two nodes of the path are listed at the same step. Pairs without a path give no rows.
    """
    pairs = pairs.select(*keys, "start", "end").distinct()
    ahead = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"), F.col("src").alias("src"), F.col("dst").alias("dst"), "rel", F.lit(">").alias("mark"))
    back = edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("next"), F.col("src").alias("src"), F.col("dst").alias("dst"), "rel", F.lit("<").alias("mark"))
    links = ahead.union(back) if undirected else ahead
    rows = searches.rows_of(links, keys, searches.EDGE, "node", "next").union(searches.rows_of(pairs, keys, searches.START, "start", "end"))
    steps = searches.searched(rows, keys, searches.paths, "start long, end long, step int, node long, next long")
    kind = lambda c: pairs.schema[c].dataType.simpleString()
    steps = steps.select(*keys, searches.given_back("start", kind("start")), searches.given_back("end", kind("end")), "step", "node", "next")
    return steps.join(links, [*keys, "node", "next"]).select(*keys, "start", "end", "step", "src", "dst", "rel", "mark").distinct()


def shortest_paths(nodes: DataFrame, edges: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """(keys, start, node, depth) over edges in both directions."""
    both = edges.select(*keys, "src", "dst", "rel").union(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))
    return closure(nodes.select(*keys, F.col("node").alias("start"), "node"), both, keys, hops)


# Tags of tokens that are no heads in the strict sense.
STOP_TAGS = r"^(\.|,|\(|\)|:|''|``|#|CC|TO|IN)$"
CHOICES = {"last": lambda: -F.col("node"), "first": lambda: F.col("node")}


def all_heads(spans: DataFrame, edges: DataFrame, tokens: DataFrame, keys: list[str], hops: int | None = None) -> DataFrame:
    """(keys, span, node): of a span's tokens, all of those nearest to a root."""
    depth = closure(roots(tokens, edges, keys).select(*keys, F.col("node").alias("start"), "node"), edges, keys, hops).groupBy(*keys, "node").agg(F.min("depth").alias("depth"))
    inside = spans.join(tokens, keys).where((F.col("node") >= F.col("begin")) & (F.col("node") < F.col("end")))
    near = inside.join(depth, [*keys, "node"], "left").select(*keys, "span", "node", F.coalesce("depth", F.lit(1 << 20)).alias("depth"))
    least = near.groupBy(*keys, "span").agg(F.min("depth").alias("depth"))
    return near.join(least, [*keys, "span", "depth"]).select(*keys, "span", "node")


def strict_heads(heads: DataFrame, tags: DataFrame, keys: list[str], stop: str = STOP_TAGS) -> DataFrame:
    """The heads (keys, span, node) whose tag, of tags (keys, node, tag), is none of punctuation, conjunctions and prepositions."""
    return heads.join(tags.select(*keys, "node", "tag"), [*keys, "node"], "left").where(~F.coalesce(F.col("tag").rlike(stop), F.lit(False))).select(*keys, "span", "node")


def local_heads(spans: DataFrame, edges: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span, node): heads by the edges inside of a span only. From each token the walk goes to the first of those it depends on, until there are none or one lies outside;
    walks that turn in a circle give the circle's tokens. Steps are doubled until they are as many as the longest span's tokens."""
    inside = spans.join(tokens, keys).where((F.col("node") >= F.col("begin")) & (F.col("node") < F.col("end"))).select(*keys, "span", "begin", "end", "node")
    up = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("lo"), F.max("src").alias("hi"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("self"))
    stays = F.col("lo").isNull() | (F.col("lo") < F.col("begin")) | (F.col("hi") > F.col("end") - 1) | (F.col("self") == 1)
    now = cut(inside.join(up, [*keys, "node"], "left").select(*keys, "span", "node", F.when(stays, F.col("node")).otherwise(F.col("lo")).alias("to")))
    longest, steps = now.groupBy(*keys, "span").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while steps < longest:
        now = cut(now.join(now.select(*keys, "span", F.col("node").alias("to"), F.col("to").alias("next")), [*keys, "span", "to"]).select(*keys, "span", "node", F.col("next").alias("to")))
        steps *= 2
    return now.select(*keys, "span", F.col("to").alias("node")).distinct()


def chosen(heads: DataFrame, keys: list[str], choose: str = "last") -> DataFrame:
    """(keys, span, head): one of the heads (keys, span, node) of each span, by CHOICES."""
    return heads.groupBy(*keys, "span").agg(F.min_by("node", CHOICES[choose]()).alias("head"))


def heads(spans: DataFrame, edges: DataFrame, tokens: DataFrame, keys: list[str], hops: int | None = None, choose: str = "last") -> DataFrame:
    """(keys, span, head): of a span's tokens, the last (or first) of those nearest to a root."""
    return chosen(all_heads(spans, edges, tokens, keys, hops), keys, choose)


def collapsed(edges: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with prepositions in the label: nmod with a case mark becomes nmod_<word>."""
    case = edges.where("rel = 'case'").join(words.select(*keys, F.col("node").alias("dst"), "word"), [*keys, "dst"])
    case = case.groupBy(*keys, F.col("src").alias("dst")).agg(F.min_by("word", "dst").alias("mark"))
    joined = edges.join(case, [*keys, "dst"], "left")
    rel = F.when((F.col("rel") == "nmod") & F.col("mark").isNotNull(), F.concat(F.lit("nmod_"), F.lower("mark"))).otherwise(F.col("rel"))
    return joined.select(*keys, "src", "dst", rel.alias("rel"))


def propagated(edges: DataFrame, keys: list[str], rel: str = "nsubj", over: str = "conj") -> DataFrame:
    """Edges with those of label `rel` copied along `over` to nodes that have none of their own: subjects
    to other conjuncts, or, over xcomp, raised to the verb below."""
    conj = edges.where(F.col("rel") == over).select(*keys, F.col("src").alias("first"), F.col("dst").alias("other"))
    own = edges.where(F.col("rel") == rel).select(*keys, F.col("src").alias("other"))
    new = conj.join(own, [*keys, "other"], "left_anti").join(edges.where(F.col("rel") == rel).select(*keys, F.col("src").alias("first"), "dst", "rel"), [*keys, "first"])
    return edges.select(*keys, "src", "dst", "rel").union(new.select(*keys, F.col("other").alias("src"), "dst", "rel")).distinct()


def attachment_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: shares of tokens whose head, and whose head and label, are right."""
    g = gold.select(*keys, "dst", F.col("src").alias("gs"), F.col("rel").alias("gr"))
    p = predicted.select(*keys, "dst", F.col("src").alias("ps"), F.col("rel").alias("pr"))
    right = F.coalesce(F.col("gs") == F.col("ps"), F.lit(False))
    both = right & F.coalesce(F.col("gr") == F.col("pr"), F.lit(False))
    return g.join(p, [*keys, "dst"], "left").agg(F.avg(right.cast("double")).alias("uas"), F.avg(both.cast("double")).alias("las"))


def endless(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): nodes whose walk along the first incoming edge never ends, as it runs into a cycle.

    Steps are doubled: after k rounds a node has walked 2^k, which is over the nodes of the largest graph at last.
    """
    up = cut(edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("to")))
    most = up.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps <= most:
        up = cut(up.join(up.select(*keys, F.col("node").alias("to"), F.col("to").alias("next")), [*keys, "to"]).select(*keys, "node", F.col("next").alias("to")))
        steps *= 2
    return up.select(*keys, "node")


def extents(front: DataFrame, edges: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """(keys, start, first, last): the least and the largest node that can be reached from each start, itself included."""
    return closure(front, edges, keys, hops).groupBy(*keys, "start").agg(F.min("node").alias("first"), F.max("node").alias("last"))


def merged(graphs: list[DataFrame], keys: list[str]) -> DataFrame:
    """The edges of all graphs, with those that several have once."""
    out = graphs[0].select(*keys, "src", "dst", "rel")
    for g in graphs[1:]:
        out = out.union(g.select(*keys, "src", "dst", "rel"))
    return out.distinct()


def with_conjunctions(edges: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Edges whose label conj gets the conjunction: conj_<word>, by the first cc of the conjunct, or else of the head."""
    cc = edges.where("rel = 'cc'").join(words.select(*keys, F.col("node").alias("dst"), "word"), [*keys, "dst"])
    cc = cc.groupBy(*keys, "src").agg(F.min_by(F.lower("word"), "dst").alias("word"))
    of = lambda end, name: cc.select(*keys, F.col("src").alias(end), F.col("word").alias(name))
    both = edges.join(of("dst", "_own"), [*keys, "dst"], "left").join(of("src", "_head"), [*keys, "src"], "left")
    mark = F.coalesce("_own", "_head")
    return both.select(*keys, "src", "dst", F.when((F.col("rel") == "conj") & mark.isNotNull(), F.concat(F.lit("conj_"), mark)).otherwise(F.col("rel")).alias("rel"))


def subjects_of_complements(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges and, for a verb with nsubj and xcomp, an edge nsubj:xsubj from the complement to the subject."""
    subject = edges.where("rel = 'nsubj'").select(*keys, "src", F.col("dst").alias("who"))
    new = edges.where("rel = 'xcomp'").select(*keys, "src", F.col("dst").alias("what")).join(subject, [*keys, "src"])
    return merged([edges, new.select(*keys, F.col("what").alias("src"), F.col("who").alias("dst"), F.lit("nsubj:xsubj").alias("rel"))], keys)


def copular_subjects(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges and, for a predicate with cop and nsubj, the subject's edge from the copula as well."""
    subject = edges.where("rel = 'nsubj'").select(*keys, "src", F.col("dst").alias("who"))
    new = edges.where("rel = 'cop'").select(*keys, "src", F.col("dst").alias("verb")).join(subject, [*keys, "src"])
    return merged([edges, new.select(*keys, F.col("verb").alias("src"), F.col("who").alias("dst"), F.lit("nsubj").alias("rel"))], keys)


def stanford_prepositions(edges: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Edges in which prep and the pobj below it are one edge prep_<word>; a prep without pobj goes as well."""
    word = words.select(*keys, F.col("node").alias("mid"), "word")
    prep = edges.where("rel = 'prep'").select(*keys, "src", F.col("dst").alias("mid"))
    pobj = edges.where("rel = 'pobj'").select(*keys, F.col("src").alias("mid"), "dst")
    new = prep.join(pobj, [*keys, "mid"]).join(word, [*keys, "mid"]).select(*keys, "src", "dst", F.concat(F.lit("prep_"), "word").alias("rel"))
    gone = prep.select(*keys, F.col("mid").alias("src"), F.lit("pobj").alias("rel")).distinct()
    rest = edges.where("rel <> 'prep'").join(gone, [*keys, "src", "rel"], "left_anti")
    return merged([rest, new], keys)


def with_multiwords(edges: DataFrame, words: DataFrame, keys: list[str], first: str = "due", second: str = "to") -> DataFrame:
    """Edges in which the word `second` right after `first` hangs on it by mwe alone."""
    low = words.select(*keys, "node", F.lower("word").alias("word"))
    pairs = low.where(F.col("word") == first).select(*keys, "node", (F.col("node") + 1).alias("dst")).join(low.where(F.col("word") == second).select(*keys, F.col("node").alias("dst")), [*keys, "dst"])
    rest = edges.join(pairs.select(*keys, "dst").distinct(), [*keys, "dst"], "left_anti")
    return merged([rest, pairs.select(*keys, F.col("node").alias("src"), "dst", F.lit("mwe").alias("rel"))], keys)


def relative_clauses(edges: DataFrame, words: DataFrame, keys: list[str], pronouns: tuple[str, ...] = ("who", "which", "that", "whom")) -> DataFrame:
    """Edges and, for a clause acl:relcl whose subject or object is a relative pronoun, that edge to the noun which the clause is of."""
    clause = edges.where("rel = 'acl:relcl'").select(*keys, F.col("src").alias("noun"), F.col("dst").alias("verb"))
    role = edges.where("rel in ('nsubj', 'nsubjpass', 'dobj')").select(*keys, F.col("src").alias("verb"), F.col("dst").alias("node"), "rel")
    pronoun = words.where(F.lower("word").isin(*pronouns)).select(*keys, "node")
    new = clause.join(role, [*keys, "verb"]).join(pronoun, [*keys, "node"], "left_semi")
    return merged([edges, new.select(*keys, F.col("verb").alias("src"), F.col("noun").alias("dst"), "rel")], keys)


def shared_by_verbs(edges: DataFrame, tags: DataFrame, keys: list[str], labels: tuple[str, ...] = ("nsubj", "nsubjpass", "agent", "dobj"), pattern: str = "^(nmod|prep)_") -> DataFrame:
    """Edges and, for two verbs joined by conj, those of the one which the other has none of: by these labels, and by labels that fit the pattern.

    tags: (keys, node, tag). Both ways read the edges as given, so that nothing goes on from verb to verb beyond one step.
    """
    verbs = tags.where("tag like 'VB%'")
    of = lambda end: verbs.select(*keys, F.col("node").alias(end))
    conj = edges.where("rel = 'conj'").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).join(of("a"), [*keys, "a"], "left_semi").join(of("b"), [*keys, "b"], "left_semi")
    both = conj.unionByName(conj.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    moved = edges.where(F.col("rel").isin(*labels) | F.col("rel").rlike(pattern)).select(*keys, F.col("src").alias("a"), "dst", "rel")
    new = both.join(moved, [*keys, "a"]).select(*keys, F.col("b").alias("src"), "dst", "rel")
    return merged([edges, new.join(edges.select(*keys, "src", "rel").distinct(), [*keys, "src", "rel"], "left_anti")], keys)


def enhanced_roles(roles: DataFrame, edges: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Semantic roles over basic dependencies: a role that ends on a preposition goes to what this marks (Ax becomes Ax_<word>), conjoined predicates share their roles,
    and conjoined arguments have the same role."""
    mark = edges.where(F.col("rel").rlike("case|mark")).groupBy(*keys, F.col("dst")).agg(F.min("src").alias("object"))
    word = words.select(*keys, F.col("node").alias("dst"), F.lower("word").alias("word"))
    met = roles.select(*keys, "src", "dst", "rel").join(mark, [*keys, "dst"], "left").join(word, [*keys, "dst"], "left")
    label = F.when((F.col("rel") == "Ax") & F.col("object").isNotNull(), F.concat(F.lit("Ax_"), "word")).otherwise(F.col("rel"))
    now = met.select(*keys, "src", F.coalesce("object", "dst").alias("dst"), label.alias("rel")).distinct()
    conj = edges.where("rel = 'conj'").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"))
    either = conj.unionByName(conj.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    shared = now.withColumnRenamed("src", "a").join(either, [*keys, "a"]).where("b <> dst").select(*keys, F.col("b").alias("src"), "dst", "rel")
    now = merged([now, shared], keys)
    arguments = now.withColumnRenamed("dst", "a").join(conj, [*keys, "a"]).where("b <> src").select(*keys, "src", F.col("b").alias("dst"), "rel")
    return merged([now, arguments], keys)
