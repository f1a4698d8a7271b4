"""Spans and mentions as tables: overlap, containment, nearness, label hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(a: Column, b: Column, x: Column, y: Column) -> Column:
    """[a, b) holds [x, y)."""
    return (a <= x) & (b >= y)


def overlaps(a: Column, b: Column, x: Column, y: Column) -> Column:
    """[a, b) and [x, y) share a place; empty spans share none."""
    return (a < y) & (x < b) & (a < b) & (x < y)


def near(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, start, end, start_2, end_2): spans of b that begin at most `most` places after the end of one of a.

    An equality join on the place: each span of a looks at most + 1 places, so work grows with spans, not with their pairs.
    """
    asked = a.select(*keys, "start", "end", F.explode(F.sequence(F.col("end"), F.col("end") + most)).alias("start_2"))
    return asked.join(b.select(*keys, F.col("start").alias("start_2"), F.col("end").alias("end_2")), [*keys, "start_2"])


def outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, end) that no other span of the key contains; of equal spans, all stay.

    One sort within the key: in order of start, then of falling end, a span is contained if an end before it reaches its own.
    """
    each = spans.groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = each.withColumn("_reach", F.max("end").over(before)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    return kept.select(*keys, "start", "end", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")


def hypernyms(nodes: DataFrame, most: int = 32) -> DataFrame:
    """(name, above, depth) of (name, parent): each label and all that it is a kind of. Deeper than `most`, or in a circle, is an error."""
    now = nodes.select("name", F.col("name").alias("above"), F.lit(0).alias("depth"))
    links = nodes.where("parent is not null").select(F.col("name").alias("above"), "parent")
    out = now
    for d in range(1, most + 1):
        now = now.join(links, "above").select("name", F.col("parent").alias("above"), F.lit(d).alias("depth"))
        if not now.head(1):
            return out
        out = out.union(now)
    if now.join(links, "above").head(1):
        raise ValueError(f"labels are over {most} deep, or in a circle")
    return out


def labelled(mentions: DataFrame, pattern: str) -> DataFrame:
    """Mentions one of whose labels fits the regex."""
    return mentions.where(F.exists("labels", lambda x: x.rlike(pattern)))


def state(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sent, tok, mention_id, label): a row for each token and label of a mention."""
    return mentions.select(*keys, "sent", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("tok"), "mention_id", F.col("labels")[0].alias("label"))


def longest(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Of mentions with the same label that begin at the same token, the longest."""
    order = Window.partitionBy(*keys, "sent", "start", F.col("labels")[0]).orderBy(F.desc("end"), "mention_id")
    return mentions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pairs_of(members: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, first, second): combinations of two of a mention's arguments, made within its own row's array."""
    row = members.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return row.select(*keys, F.inline(pairs))


def merged_labels(into: Column, source: Column) -> Column:
    """Labels of `into` with each run of source's labels copied where all of its places are O."""
    starts = F.filter(F.sequence(F.lit(0), F.size(source) - 1), lambda i: (source[i] != "O") & (F.substring(source[i], 1, 1) == "B"))
    ends = lambda i: F.coalesce(F.get(F.filter(F.sequence(i + 1, F.size(source)), lambda j: (j == F.size(source)) | ~F.coalesce(F.get(source, j), F.lit("O")).startswith("I-")), F.lit(0)), F.size(source))
    runs = F.transform(starts, lambda i: F.struct(i.alias("a"), ends(i).alias("b")))
    free = F.filter(runs, lambda r: F.forall(F.slice(into, r["a"] + 1, r["b"] - r["a"]), lambda x: x == "O"))
    return F.transform(into, lambda x, i: F.when(F.exists(free, lambda r: (r["a"] <= i) & (i < r["b"])), source[i]).otherwise(x))


def longest_of_overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, end) that no overlapping one beats, by length, then by the earlier start: those that are best at each of their places.

    Places are a row each, so overlapping spans never form pairs.
    """
    each = spans.select(*keys, "start", "end").distinct()
    places = each.withColumn("_at", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    best = places.groupBy(*keys, "_at").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"))).alias("b"))
    held = best.groupBy(*keys, (-F.col("b.s")).alias("start"), (F.col("b.n") - F.col("b.s")).alias("end")).agg(F.count("*").alias("_n"))
    return held.where("_n = end - start").select(*keys, "start", "end")


def top_of_head(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Of the mentions (keys, head, start, end) with one head, the longest, ties to the earlier start."""
    order = Window.partitionBy(*keys, "head").orderBy(F.desc(F.col("end") - F.col("start")), "start")
    return mentions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def chain_of(asked: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """All mentions (keys, chain, head, ...) of the chains to which the mentions with the heads asked for (keys, head) belong."""
    chains = asked.join(mentions.select(*keys, "head", "chain"), [*keys, "head"]).select(*keys, "chain").distinct()
    return mentions.join(chains, [*keys, "chain"])


def with_merged_labels(tokens: DataFrame, keys: list[str], into: str, source: str) -> DataFrame:
    """tokens (keys, tok, into, source) with a column `labels`: those of `into`, with each entity of `source` copied where all of its places are O."""
    order = Window.partitionBy(*keys).orderBy("tok")
    kind = F.substring(source, 1, 2)
    rows = tokens.withColumn("_run", F.sum((kind != "I-").cast("int")).over(order))  # a B- or an O begins anew
    inside = Window.partitionBy(*keys, "_run")
    entity = F.max((kind == "B-").cast("int")).over(inside) == 1
    free = F.max((F.col(into) != "O").cast("int")).over(inside) == 0
    return rows.withColumn("labels", F.when(entity & free, F.col(source)).otherwise(F.col(into))).drop("_run")


#: A mention in JSON: arguments and triggers are ids of other mentions of the document.
LINE = "document string, mentions array<struct<id: string, type: string, labels: array<string>, sentence: int, start: int, end: int, text: string, foundBy: string, trigger: string, arguments: map<string, array<string>>>>"


def to_lines(found: DataFrame, key: str) -> DataFrame:
    """(key, value): a JSON line a document with its mentions in the order of sentence, start, end, rule and id.

    found: (key, mention_id, kind, labels, sent, start, end, text, trigger_id, found_by, args), as extract() returns; a mention that comes twice is written once.
    """
    roles = F.array_sort(F.array_distinct(F.transform("args", lambda a: a["role"])))
    of = F.map_from_arrays(roles, F.transform(roles, lambda r: F.transform(F.filter("args", lambda a: a["role"] == r), lambda a: a["mention_id"])))
    body = F.struct(F.col("mention_id").alias("id"), F.col("kind").alias("type"), "labels", F.col("sent").alias("sentence"), "start", "end", "text", F.col("found_by").alias("foundBy"), F.col("trigger_id").alias("trigger"), F.when(F.size("args") > 0, of).alias("arguments"))
    order = F.struct("sent", "start", "end", "found_by", "mention_id")
    once = found.select(key, "mention_id", order.alias("_order"), F.to_json(body).alias("json")).repartition(key).dropDuplicates([key, "mention_id"])  # one shuffle, of lines
    each = once.select(key, F.struct("_order", "json").alias("m")).groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("m"))
    inner = F.array_join(F.transform("m", lambda x: x["json"]), ",")
    return each.select(key, F.concat(F.lit('{"document":'), F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(',"mentions":['), inner, F.lit("]}")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(document, id, type, labels, sentence, start, end, text, foundBy, trigger, arguments): a row a mention of JSON lines in `value`; lines that aren't JSON are an error."""
    parsed = lines.select(F.from_json("value", LINE, {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("d.document", F.inline("d.mentions"))
