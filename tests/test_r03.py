"""What the findings of the third round asked for."""

from pyspark.sql import functions as F

from glossa import registry
from glossa.operators import text


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be a folder of files, as a single file may be, or without rows."""
    for name, texts in (("many", ["a b", "b c", "a a"]), ("none", [])):
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = {r.word: r.n for r in registry.QUERIES["streamed_counts"](spark, f"{tmp_path}/{name}").collect()}
        assert got == ({"a": 3, "b": 2, "c": 1} if texts else {})


def test_following_words_as_written(spark):
    """The SQL of corrected_tags takes the second word of a pair as it is written, and no line end at the end of a pattern."""
    rows = spark.createDataFrame([(1, "The of The Of vs. vs.\u2028 5ds 5ds\u0085")], "doc_id long, text string")
    words = text.words(rows, "doc_id").withColumn("tag", F.lit("NN"))
    tags = lambda **o: [r.tag for r in text.corrected_tags(words, {("the", "of"): "IN"}, "doc_id", **o).orderBy("tok").collect()]
    assert tags(fold_following=False) == ["IN", "NN", "NN", "NN", "CC", "NN", "CD", "NN"]
    assert tags() == ["IN", "NN", "IN", "NN", "CC", "NN", "CD", "NN"]
