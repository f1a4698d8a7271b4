"""Column files, CoNLL-U, SVMlight and JSON documents.

Column files carry their order in the lines, so a file is read as one text and cut into sentences in a projection: no row numbers,
no shuffle. Files are bounded by what a corpus writer cuts them to; large corpora come as many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from glossa.functions.tokenizer import EDGE, SENTENCE

GRAPH = StructType([StructField("edges", ArrayType(EDGE)), StructField("roots", ArrayType(IntegerType()))])
DOCUMENT = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("sentences", ArrayType(StructType([*(StructField({"starts": "startOffsets", "ends": "endOffsets"}.get(f.name, f.name), f.dataType) for f in SENTENCE), StructField("graphs", MapType(StringType(), GRAPH))])))])


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, tok, columns): a token a line in columns parted by blanks; an empty line ends a sentence."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = F.filter(F.split("value", r"\n[ \t]*\n\s*"), lambda b: F.trim(b) != "")
    sentences = files.select("file", F.posexplode(blocks).alias("sent", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    return sentences.select("file", "sent", F.posexplode(F.transform(lines, lambda x: F.split(F.trim(x), r"[ \t]+"))).alias("tok", "columns"))


def _layer(i: int) -> Column:
    return F.transform("t", lambda x: x["columns"][i])


def columns_to_documents(tokens: DataFrame, layers: dict[str, int]) -> DataFrame:
    """(file, sentences): documents with the layers named, from the columns at these places."""
    rows = tokens.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("tok", "columns"))).alias("t"))
    fields = [_layer(layers[f.name]).alias(f.name) if f.name in layers else F.lit(None).cast(f.dataType).alias(f.name) for f in SENTENCE]
    each = rows.select("file", "sent", F.struct(*fields).alias("s"))
    return each.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent", "s"))), lambda x: x["s"]).alias("sentences"))


def conllu_lines(annotated: DataFrame, *keys: str) -> DataFrame:
    """(keys, sent, tok, line): ten columns a token, `_` for what is missing; the head is the first edge that comes in, 0 for none."""
    each = annotated.select(*keys, F.posexplode("sentences").alias("sent", "s"))
    token = each.select(*keys, "sent", "s", F.posexplode("s.words").alias("tok", "word"))
    has = "graphs" in annotated.schema["sentences"].dataType.elementType.names
    of = lambda name: F.coalesce(F.get(F.col(f"s.{name}"), F.col("tok")), F.lit("_"))
    into = F.get(F.filter(F.array_sort(F.col("s.graphs")["universal-enhanced"]), lambda e: e["destination"] == F.col("tok")), F.lit(0)) if has else None
    head = F.coalesce((into["source"] + 1).cast("string"), F.lit("0")) if has else F.lit("_")
    rel = F.coalesce(into["relation"], F.lit("root")) if has else F.lit("_")
    line = F.concat_ws("\t", (F.col("tok") + 1).cast("string"), F.col("word"), of("lemmas"), of("tags"), of("chunks"), of("entities"), head, rel, of("norms"), F.lit("_"))
    return token.select(*keys, "sent", "tok", line.alias("line"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents in JSON, one a line, with their graphs as edge arrays."""
    parsed = spark.read.text(path).select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")
    return parsed.select("id", "text", with_edges(F.col("sentences")).alias("sentences"))


def with_edges(sentences: Column) -> Column:
    """Sentences in the engine's names, graphs as name: edges."""
    names = {"startOffsets": "starts", "endOffsets": "ends"}
    plain = [f.name for f in DOCUMENT["sentences"].dataType.elementType if f.name != "graphs"]
    return F.transform(sentences, lambda s: F.struct(*(s[n].alias(names.get(n, n)) for n in plain), F.transform_values(s["graphs"], lambda k, g: g["edges"]).alias("graphs")))


def documents_json(annotated: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): documents in the format that read_documents reads, without layers that are null."""
    names = {"starts": "startOffsets", "ends": "endOffsets"}
    inner = annotated.schema["sentences"].dataType.elementType.names
    out = F.transform("sentences", lambda s: F.struct(*(s[n].alias(names.get(n, n)) for n in inner if n != "graphs"), *([F.transform_values(s["graphs"], lambda k, e: F.struct(e.alias("edges"))).alias("graphs")] if "graphs" in inner else [])))
    return annotated.select(*keys, F.to_json(F.struct(*(F.col(k).cast("string").alias("id") for k in keys[:1]), out.alias("sentences"))).alias("json"))


def read_svmlight(lines: DataFrame) -> DataFrame:
    """(label, qid, features: map<int, double>, comment) of SVMlight or ranking lines in `value`."""
    read = lines.select(F.trim(F.substring_index("value", "#", 1)).alias("body"), F.trim(F.get(F.split("value", "#", 2), F.lit(1))).alias("comment")).where("body <> ''")
    read = read.select("body", "comment", F.split("body", r"\s+").alias("parts"))
    pairs = F.filter(F.slice("parts", 2, F.size("parts")), lambda x: x.rlike(r"^\d+:"))
    place = lambda x, i: F.substring_index(F.substring_index(x, ":", i), ":", -1)
    features = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int"), place(x, 2).cast("double"))))
    qid = F.regexp_extract("body", r"\sqid:(\S+)", 1)
    return read.select(F.col("parts")[0].cast("double").alias("label"), F.when(qid != "", qid).alias("qid"), features.alias("features"), "comment")


def svmlight_lines(rows: DataFrame) -> DataFrame:
    """(value): lines of (label, qid, features), features by rising index."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    return rows.select(F.concat_ws(" ", F.col("label").cast("string"), F.when(F.col("qid").isNotNull(), F.concat(F.lit("qid:"), F.col("qid"))), pairs).alias("value"))


def _quoted(text: Column) -> Column:
    """A string in JSON, without what goes around it."""
    array = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(array, F.lit(2), F.length(array) - 2))


def graph_json(annotated: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): an array of sentences with tokens and chunks as [word, place], offsets, and sorted edges [source, destination, relation] of
    four graphs; what a sentence lacks is left out."""
    fields = annotated.schema["sentences"].dataType.elementType.names
    part = lambda name, body: F.concat(F.lit(f'"{name}":['), body, F.lit("]"))
    placed = lambda x: F.array_join(F.transform(x, lambda w, i: F.concat(F.lit("["), _quoted(w), F.lit(","), i.cast("string"), F.lit("]"))), ",")
    edges = lambda e: F.array_join(F.transform(F.array_sort(e), lambda x: F.concat(F.lit("["), x["source"].cast("string"), F.lit(","), x["destination"].cast("string"), F.lit(","), _quoted(x["relation"]), F.lit("]"))), ",")
    graphs = {"Basic_syntactic_dependencies": "universal-basic", "Enhanced_syntactic_dependencies": "universal-enhanced", "Semantic_dependencies": "semantic-roles", "Enhanced_semantic_dependencies": "enhanced-semantic-roles"}

    def sentence(s: Column) -> Column:
        parts = [part("Tokens", placed(s["words"]))]
        parts += [part("Chunks", placed(s["chunks"]))] if "chunks" in fields else []
        parts += [part(n, F.array_join(s[f].cast("array<string>"), ",")) for n, f in (("Start_character_offsets", "starts"), ("End_character_offsets", "ends")) if f in fields]
        parts += [part(n, edges(s["graphs"][g])) for n, g in graphs.items()] if "graphs" in fields else []
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    return annotated.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("sentences", sentence), ","), F.lit("]")).alias("json"))


def printed(annotated: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text): documents as lines to read: for each sentence a line with its number, then its layers."""
    each = annotated.select(*keys, F.posexplode("sentences").alias("sent", "s"))
    layers = [f for f in annotated.schema["sentences"].dataType.elementType.names if f != "graphs"]
    lines = F.array(F.concat(F.lit("Sentence #"), F.col("sent").cast("string")), *(F.concat(F.lit(f"{f}: "), F.array_join(F.col(f"s.{f}").cast("array<string>"), " ", "_")) for f in layers))
    out = each.select(*keys, F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("nth", "text"), "sent")
    return out.select(*keys, (F.col("sent") * (len(layers) + 1) + F.col("nth")).cast("int").alias("line"), "text")
