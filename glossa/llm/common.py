"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


#: What cut() and stored() have made, while within().
_made: list[DataFrame] = []
_within = 0


@contextmanager
def within() -> Iterator[None]:
    """On leaving, deletes what cut() and stored() made inside; what is wanted of it must have been written elsewhere."""
    global _within
    first, _within = len(_made), _within + 1
    try:
        yield
    finally:
        _within -= 1
        drop(*_made[first:])
        del _made[first:]


def _kept(df: DataFrame) -> DataFrame:
    if _within:
        _made.append(df)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which lost executors don't take along."""
    shared_dir(df.sparkSession)
    return _kept(df.checkpoint(eager=True))


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, for wide rows of which readers take some columns each."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return _kept(out)


def delete(spark: SparkSession, file: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*cuts: DataFrame) -> None:
    """Deletes the files of what cut(), or a projection of it, or stored() gave, after the last reader; Spark itself keeps them until the application ends."""
    for df in cuts:
        if path := df.__dict__.get("_stored_at"):
            delete(df.sparkSession, path)
            continue
        spark, file = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile()
        if file.isDefined():
            delete(spark, file.get())


def portions(batch: pa.RecordBatch, column: str, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about that many bytes of a column, or of one row."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def hex_digits_for(rows: int, rows_per_cell: int = 1000) -> int:
    """Leading hex digits of a hash that leave about rows_per_cell rows in a cell, or fewer."""
    digits = 1
    while rows / 16**digits > rows_per_cell and digits < 8:
        digits += 1
    return digits


def number_rows(df: DataFrame, group: str, cell: str, order: list, out: str) -> DataFrame:
    """Adds `out`, gapless from 0 within each `group`, ordered by `cell`, then `order`.

    No group meets in one task: only (group, cell) does. Counts of the cells are summed up before each,
    which handles one row per cell. `cell` must sort like the order wanted between cells.
    Rows whose group and order values are all equal are interchangeable.
    """
    cells = df.groupBy(group, cell).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select(F.col(group).alias("_g"), F.col(cell).alias("_c"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    joined = df.join(first, df[group].eqNullSafe(first["_g"]) & df[cell].eqNullSafe(first["_c"]), "left")
    within = Window.partitionBy(group, cell).orderBy(*order)
    return joined.withColumn(out, (F.col("_first") + F.row_number().over(within) - 1).cast("long")).drop("_g", "_c", "_first")


#: Distinct edges up to which one task finds the components, in some tens of MB; beyond it, joins do.
FEW_EDGES = 100_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                root.setdefault(x, x)
                root.setdefault(y, y)
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], ["id", "component"])

    kind = to_arrow_type(edges.schema["a"].dataType)
    return edges.coalesce(1).mapInArrow(run, StructType([StructField("id", edges.schema["a"].dataType), StructField("component", edges.schema["a"].dataType)]))


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reached.

    Few edges, by count, are joined by union-find in one task. Others:

    Alternating large-star and small-star steps until the edges stay as they are. Each step is one
    aggregate of minima (combined before the shuffle) and one join; a hub's neighbours never meet in one row.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        near = both.join(least, "a")
        if large:
            out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = mark(now)
    if state[0] <= few:
        out = cut(_in_one_task(now))
        drop(now)
        return out
    while True:  # ends: every step but the last lowers the sum of the ends of all edges
        last, now = now, cut(star(star(now, True), False))
        drop(last)
        after = mark(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
