"""Dictionary entities: n-grams joined with a lexicon, longest match from left to right, and the algebra of BIO labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lexicon entries up to which the lexicon is broadcast; beyond it, n-grams and lexicon are joined by a shuffle.
BROADCAST_ENTRIES = 200_000

#: Different first words of the entries up to which n-grams begin at these words only; beyond it, all n-grams meet the lexicon.
FIRST_WORDS = 2_000


def read_lexicon(lines: DataFrame, label: str) -> DataFrame:
    """(phrase, label) of a text source: an entry a line, `//` begins a comment, lines with # are skipped."""
    value = F.trim(F.regexp_replace("value", r"\s*//.*$", ""))
    return lines.where(~F.col("value").rlike(r"^\s*#")).select(value.alias("phrase"), F.lit(label).alias("label")).where("phrase <> ''")


def read_overrides(lines: DataFrame) -> DataFrame:
    """(phrase, label): first and last column of tab-separated lines of two or more."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("phrase"), F.trim(F.element_at(parts, -1)).alias("label"))


def read_normed(lines: DataFrame) -> DataFrame:
    """(phrase, norm, unit_class) of lines `phrase // norm::class`."""
    pattern = r"^(.*?)\s*//\s*(.*?)(?:::(.*))?$"
    return lines.where(F.col("value").rlike(pattern)).select(*(F.trim(F.regexp_extract("value", pattern, i)).alias(n) for i, n in ((1, "phrase"), (2, "norm"), (3, "unit_class"))))


def matches(sentences: DataFrame, lexicon: DataFrame, *keys: str, fold: bool = True) -> DataFrame:
    """(keys, start, end, label): longest matches from left to right in (keys, words).

    lexicon: (phrase, label, rank): of equal spans, the least rank wins. Candidates come from an equality join of n-grams,
    the scan from left to right is a fold within each sentence's own row of candidates.
    """
    norm = (lambda c: F.lower(c)) if fold else (lambda c: c)
    entries = lexicon.select(norm(F.col("phrase")).alias("phrase"), "label", "rank")
    entries = entries.groupBy("phrase").agg(F.min(F.struct("rank", "label")).alias("best")).select("phrase", "best.label")
    longest = entries.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    if not longest:
        return sentences.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("label")).where("false")
    if lexicon.count() <= BROADCAST_ENTRIES:
        entries = F.broadcast(entries)
    firsts = entries.select(F.substring_index("phrase", " ", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    if len(firsts) <= FIRST_WORDS:
        begins = F.filter(F.transform("words", lambda w, i: F.when(F.substring_index(norm(w), " ", 1).isin([r.w for r in firsts]), i)), lambda i: i.isNotNull())
        places = F.when(F.size("words") > 0, begins)
    each = sentences.select(*keys, "words", places.alias("_at"))
    grams = F.flatten(F.transform("_at", lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - i)), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), norm(F.array_join(F.slice("words", i + 1, n), " ")).alias("phrase")))))
    hits = each.select(*keys, F.inline(grams)).join(entries, "phrase")
    row = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "label"))).alias("c"))
    kept = F.expr("""
      aggregate(c, named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, label: string>>)),
        (acc, x) -> if(x.start >= acc.at, named_struct('at', -x.e, 'out', array_append(acc.out, named_struct('start', x.start, 'end', -x.e, 'label', x.label))), acc), acc -> acc.out)""")
    return row.select(*keys, F.inline(kept))


def bio(size: Column, spans: Column) -> Column:
    """B- and I- labels of a sentence of `size` tokens from spans (start, end, label), in time linear in both where spans follow each other; of spans that overlap or come in another order, each token looks for its first."""
    inside = lambda i: F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
    any_order = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.concat(F.when(F.get(inside(i), F.lit(0))["start"] == i, "B-").otherwise("I-"), F.get(inside(i), F.lit(0))["label"]), F.lit("O")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    several = lambda label, n: F.array_repeat(label, n.cast("int"))
    runs = F.transform(spans, lambda s, i: F.concat(several(F.lit("O"), s["start"] - before(i)), F.array(F.concat(F.lit("B-"), s["label"])), several(F.concat(F.lit("I-"), s["label"]), s["end"] - s["start"] - 1)))
    in_order = F.forall(F.transform(spans, lambda s, i: s["label"].isNotNull() & (s["start"] >= before(i)) & (s["end"] > s["start"]) & (s["end"] <= size)), lambda x: F.coalesce(x, F.lit(False)))
    rest = several(F.lit("O"), size - F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)))
    return F.when(in_order, F.concat(F.flatten(runs), rest)).otherwise(any_order)


def spans(tokens: DataFrame, *keys: str, label: str = "entity") -> DataFrame:
    """(keys, start, end, label): entities of BIO labels, one a B- or an I- that continues nothing."""
    order = Window.partitionBy(*keys).orderBy("tok")
    kind, before = F.substring(label, 3, 1 << 30), F.lag(label).over(order)
    begins = (F.col(label) != "O") & (F.col(label).startswith("B-") | before.isNull() | (before == "O") | (F.substring(before, 3, 1 << 30) != kind))
    run = tokens.withColumn("_kind", kind).withColumn("_begins", begins.cast("int"))
    run = run.withColumn("_run", F.sum("_begins").over(order)).where(F.col(label) != "O")
    return run.groupBy(*keys, "_run").agg(F.min("tok").alias("start"), (F.max("tok") + 1).alias("end"), F.first("_kind").alias("label")).drop("_run")


def patched(tokens: DataFrame, *keys: str, label: str = "entity") -> DataFrame:
    """tokens with an I- that continues nothing turned into a B-."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy("tok"))
    loose = F.col(label).startswith("I-") & (before.isNull() | (before == "O") | (F.substring(before, 3, 1 << 30) != F.substring(label, 3, 1 << 30)))
    return tokens.withColumn(label, F.when(loose, F.concat(F.lit("B-"), F.substring(label, 3, 1 << 30))).otherwise(F.col(label)))


def sentiment(positive: Column, negative: Column) -> tuple[Column, Column]:
    """Shares of positive and negative from counts: even without any, whole with one side, else a softmax."""
    p = F.when((positive == 0) & (negative == 0), 0.5).when(negative == 0, 1.0).when(positive == 0, 0.0).otherwise(1 / (1 + F.exp((negative - positive).cast("double"))))
    return p, 1 - p


def span_scores(gold: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """(label, tp, fp, fn) of exact spans with their labels."""
    on = [*keys, "start", "end", "label"]
    both = gold.select(*on).withColumn("g", F.lit(1)).join(predicted.select(*on).withColumn("p", F.lit(1)), on, "full_outer")
    return both.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def contentful(words: Column, known: Column) -> Column:
    """Whether a span of words is worth being an entity: it holds a letter, and has two words, over three characters, a digit, an upper-case letter, or a known first word."""
    text = F.array_join(words, " ")
    enough = (F.size(words) > 1) | (F.length(text) > 3) | text.rlike("[0-9]") | text.rlike(r"\p{Lu}") | F.coalesce(F.array_contains(known, F.get(words, F.lit(0))), F.lit(False))
    return text.rlike(r"\p{L}") & enough


def accepted(custom: DataFrame, generic: DataFrame, *keys: str) -> DataFrame:
    """Spans (keys, start, end, label) of `custom` both of whose ends are no inner places of one of `generic`.

    Inner places are a row each, so this is an equality join, however many spans a sentence has.
    """
    inner = generic.where("end - start > 1").select(*keys, F.explode(F.sequence(F.col("start") + 1, F.col("end") - 1)).alias("_at")).distinct()
    left = custom.join(inner.withColumnRenamed("_at", "start"), [*keys, "start"], "left_anti").join(inner.withColumnRenamed("_at", "end"), [*keys, "end"], "left_anti")
    return left.select(*keys, "start", "end", "label")


def cleared_before(tokens: DataFrame, *keys: str, cleared: str, before: str, label: str = "entity") -> DataFrame:
    """tokens with the runs of labels that fit the regex `cleared` turned to O where `before` comes next."""
    loose = F.col(label).rlike(cleared)
    # read backwards, as a frame that only grows is kept from row to row, and one without an end is read anew for each
    following = F.last(F.when(~loose, F.col(label)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("tok")).rowsBetween(Window.unboundedPreceding, -1))
    return tokens.withColumn(label, F.when(loose & (following == before), "O").otherwise(F.col(label)))


def with_variations(entries: DataFrame, variations: Column) -> DataFrame:
    """Entries of a lexicon and, under their labels and ranks, the phrases that `variations`, an array made of an entry's columns, adds."""
    more = entries.select(F.explode(variations).alias("phrase"), "label", "rank")
    return entries.select("phrase", "label", "rank").unionByName(more).distinct()


def overridden(standard: DataFrame, overrides: DataFrame, overwrite: bool = True) -> DataFrame:
    """(phrase, label, rank): the entries of both, overrides first: with `overwrite`, a phrase that they have keeps none of its standard labels, else only its rank falls behind."""
    first = overrides.select("phrase", "label", F.lit(0).alias("rank"))
    rest = standard.join(first.select("phrase").distinct(), "phrase", "left_anti") if overwrite else standard
    return first.unionByName(rest.select("phrase", "label", (F.col("rank") + 1).alias("rank")))


def validated(matched: DataFrame, sentences: DataFrame, valid: Column, *keys: str) -> DataFrame:
    """Matches (keys, start, end, label) of which `valid`, made of these columns and the sentence's words, holds; null is no."""
    return matched.join(sentences.select(*keys, "words"), [*keys]).where(valid).select(*keys, "start", "end", "label")
