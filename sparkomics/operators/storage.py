"""Tables in the shared folder: where a loop cuts its lineage, so that a lost executor costs one step and not all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set where it is missing and all tasks run here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="sparkomics-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _files(df: DataFrame, path: str) -> tuple:
    context = df.sparkSession.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back; the table goes with the application, or earlier by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkomics-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop, files = _files(df, path)
    files.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave, which nothing will read again."""
    for df in tables:
        hadoop, files = _files(df, df._stored_at)
        files.delete(hadoop, True)
