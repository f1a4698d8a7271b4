"""Cutting long lineages in the folder that the cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, of which readers take the columns that they need."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def read_written(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """The rows of tables that written() made, in columns that all of them have, in one scan."""
    schema = tables[0].select(*columns).schema
    return tables[0].sparkSession.read.schema(schema).parquet(*(t._written_at for t in tables))


def spread(df: DataFrame) -> DataFrame:
    """df in several parts for each core, before work that costs far more than a shuffle of its rows: a file of one row group is one task otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def delete(*tables: DataFrame) -> None:
    """Deletes what cut() and written() made, after its last reader."""
    for df in tables:
        spark = df.sparkSession
        path = df.__dict__.get("_written_at")
        if path is None:
            file = df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile()
            path = file.get() if file.isDefined() else None
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
