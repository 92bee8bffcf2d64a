"""Shared helpers: tables, written intermediate tables, words, Python on executors."""

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorwatch.session import scratch_dir

# White space between words: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"
# Spark's setting for deleting the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns never come in, so their names can't clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: cuts lineage, survives lost executors.

    What was shuffled for it is deleted when it is written, else it stays until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``landed`` wrote, once nothing is left that reads them."""
    for df in tables:
        for file in [] if df is None else df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text, in order, as an array (null and blank texts: empty)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def longs(values) -> Column:
    """An array literal of 64-bit integers."""
    return F.expr(f"array({','.join(f'{int(v)}L' for v in values)})") if len(values) else F.expr("cast(array() as array<bigint>)")


def use_python(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package (a cluster gets it with --py-files), and
    keep Arrow batches small, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
