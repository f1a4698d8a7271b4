"""Native text operators: DataFrame functions only, so that they stay in the JVM and in the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[^ \t\n\r]+"


def words(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, tok, word): the runs of non-blanks of a text, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(BLANKS), F.lit(0))
    return docs.select(*keys, F.posexplode(found).alias("tok", "word"))


def sentence_numbers(tokens: DataFrame, *keys: str, word: str = "word") -> DataFrame:
    """tokens with `sent`: a new sentence begins after a token that ends in . ! or ?"""
    before = Window.partitionBy(*keys).orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col(word).rlike(r"[.!?]$").cast("int")
    return tokens.withColumn("sent", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int"))


def casing(word: Column) -> Column:
    """x without capitals, X one capital, XX capitals only, Xx capitalised, xX mixed, number, other."""
    has = word.rlike
    return (
        F.when(has(r"^[-+]?[0-9][0-9.,]*$"), "number").when(~has(r"\p{L}"), "other").when(~has(r"\p{Lu}"), "x").when(has(r"^\p{Lu}$"), "X")
        .when(~has(r"\p{Ll}"), "XX").when(has(r"^\p{Lu}[^\p{Lu}]*$"), "Xx").otherwise("xX")
    )


def digits_to_n(word: Column) -> Column:
    return F.regexp_replace(word, "[0-9]", "N")


def prefixes(word: Column, most: int = 3) -> Column:
    return F.array(*(F.substring(word, 1, i) for i in range(1, most + 1)))


def suffixes(word: Column, most: int = 3) -> Column:
    return F.array(*(F.reverse(F.substring(F.reverse(word), 1, i)) for i in range(1, most + 1)))


def context(tokens: DataFrame, *keys: str, around: int = 1, column: str = "word") -> DataFrame:
    """tokens with prev_1.. and next_1..: neighbours in the same text."""
    order = Window.partitionBy(*keys).orderBy("tok")
    for i in range(1, around + 1):
        tokens = tokens.withColumn(f"prev_{i}", F.lag(column, i).over(order)).withColumn(f"next_{i}", F.lead(column, i).over(order))
    return tokens


def quote_marks(tokens: DataFrame, *keys: str) -> DataFrame:
    """tokens with `norm`: double quotes open and close in turn."""
    before = Window.partitionBy(*keys).orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum((F.col("word") == '"').cast("int")).over(before), F.lit(0))
    return tokens.withColumn("norm", F.when(F.col("word") == '"', F.when(quotes % 2 == 0, "``").otherwise("''")).otherwise(F.col("word")))


def parens_normalised(text: Column) -> Column:
    for a, b in (("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def before_first(text: Column, mark: str, all_if_none: bool = True) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substring_index(text, mark, 1)).otherwise(text if all_if_none else F.lit(""))


def after_last(text: Column, mark: str, all_if_none: bool = True) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substring_index(text, mark, -1)).otherwise(text if all_if_none else F.lit(""))


def hyphen_parts(word: Column) -> Column:
    """Both parts of mid-, bi-, semi-, non- and all- compounds; other words alone."""
    fits = word.rlike(r"^(mid|bi|semi|non|all)-[A-Za-z0-9_]+$")
    return F.when(fits, F.split(word, "-", 2)).otherwise(F.array(word))


def contraction_parts(word: Column) -> Column:
    """Words of English contractions, for the common endings."""
    cut = lambda n, right: F.array(F.expr(f"left(word, length(word) - {n})"), F.lit(right))
    low = F.lower(word)
    out = F.when(low == "won't", F.array(F.lit("will"), F.lit("not"))).when(low == "can't", F.array(F.lit("can"), F.lit("not"))).when(low == "shan't", F.array(F.lit("shall"), F.lit("not")))
    out = out.when(low.isin("let's", "cont'd", "ain't"), F.array(word))
    for ending, right in (("'s", "'s"), ("'d", "'d"), ("n't", "not"), ("'m", "am"), ("'ll", "will"), ("'ve", "have"), ("'re", "are")):
        out = out.when(low.endswith(ending), cut(len(ending), right))
    return out.otherwise(F.array(word))


def shifted(sentences: Column, by: Column) -> Column:
    """Offsets moved, as when documents are put together."""
    return F.transform(sentences, lambda s: s.withField("starts", F.transform(s["starts"], lambda x: x + by)).withField("ends", F.transform(s["ends"], lambda x: x + by)))


def combined(docs: DataFrame, group: str, order: str, between: int = 1) -> DataFrame:
    """(group, order, begin, end): the place of each text when those of a group are joined with `between` characters."""
    ahead = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("text") + between).over(ahead), F.lit(0))
    return docs.select(group, order, begin.cast("long").alias("begin"), (begin + F.length("text")).cast("long").alias("end"))


def veiled(text: Column, ranges: Column) -> Column:
    """The text with character ranges (a, b) blanked, its length kept."""
    return F.aggregate(ranges, text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["a"]), F.repeat(F.lit(" "), r["b"] - r["a"]), F.substring(t, r["b"] + 1, F.length(t))))


def without_references(text: Column) -> Column:
    """Bracketed references blanked, the text's length kept."""
    pattern = r"\[[0-9]+(?:[,-] ?[0-9]+)*\]"
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.transform(found, lambda x: F.repeat(F.lit(" "), F.length(x)))
    return F.array_join(F.flatten(F.zip_with(parts, blank, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


#: Word and the word after it, and the tag that the first then has.
DUE_TO = {("due", "to"): "IN"}


def corrected_tags(tokens: DataFrame, pairs: dict[tuple[str, str], str], *keys: str, fold_following: bool = True) -> DataFrame:
    """tokens with tags mended: `vs.` joins, numbers with ds or ws count, and words get a tag before certain others, in whatever case; without `fold_following`, these others count only as written."""
    low, after = F.lower("word"), F.lead("word").over(Window.partitionBy(*keys).orderBy("tok"))
    after = F.lower(after) if fold_following else after
    tag = F.when(low.rlike(r"^vs[.]?\z"), "CC").when(F.col("word").rlike(r"^[0-9]+(ds|ws)\z"), "CD")
    for (word, following), new in pairs.items():
        tag = tag.when((low == word) & (after == following), new)
    return tokens.withColumn("tag", tag.otherwise(F.col("tag")))


def lines_as_sentences(docs: DataFrame, key: str, between: int = 1) -> DataFrame:
    """(key, sent, begin, end): a document of a list of sentences, one a line; offsets go on with `between` characters after each."""
    lines = F.split("text", "\n", -1)
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("sent"), F.length(x).alias("n")))
    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sent:int,begin:int,end:int>>").alias("out")), lambda a, x: F.struct((a["at"] + x["n"] + between).alias("at"), F.array_append(a["out"], F.struct(x["sent"].alias("sent"), a["at"].alias("begin"), (a["at"] + x["n"]).alias("end"))).alias("out")), lambda a: a["out"])
    return docs.where("text is not null").select(key, F.inline(spans))


def made_offsets(words: DataFrame, *keys: str, between: int = 1) -> DataFrame:
    """(keys, tok, start, end) for tokens (keys, tok, word) without offsets: their lengths, `between` characters apart."""
    ahead = Window.partitionBy(*keys).orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + between).over(ahead), F.lit(0))
    return words.select(*keys, "tok", start.cast("int").alias("start"), (start + F.length("word")).cast("int").alias("end"))


def reversed_layers(sentence: Column, names: list[str]) -> Column:
    """A sentence whose layers run from right to left; graphs stay as they are."""
    out = sentence
    for n in names:
        out = out.withField(n, F.reverse(sentence[n]))
    return out


def ordered_hash(words: Column) -> Column:
    """The same for equal sequences."""
    return F.md5(F.array_join(words, "\u001f"))


def unordered_hash(words: Column) -> Column:
    """The same for equal bags, whatever their order."""
    return ordered_hash(F.array_sort(words))


def tokens_between(tokens: DataFrame, *keys: str, first: int, last: int) -> DataFrame:
    """Tokens (keys, tok, ...) from `first` to `last`, numbered anew."""
    return tokens.where((F.col("tok") >= first) & (F.col("tok") < last)).withColumn("tok", F.col("tok") - first)


def properties(arguments: list[str]) -> dict[str, str]:
    """`-name value`, `--name=value` and `-flag` (true) as a map; a name keeps its last value, other words go under ''."""
    out: dict[str, str] = {}
    i = 0
    while i < len(arguments):
        a = arguments[i]
        if a.startswith("-") and a.strip("-"):
            name, eq, value = a.lstrip("-").partition("=")
            if not eq and i + 1 < len(arguments) and not arguments[i + 1].startswith("-"):
                i, value = i + 1, arguments[i + 1]
            out[name] = value if value or eq else "true"
        else:
            out[""] = f"{out[''] } {a}" if "" in out else a
        i += 1
    return out
