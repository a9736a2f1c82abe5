"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all of Spark is on this machine, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path that nothing uses yet, in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/runmill-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that read them must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/runmill-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df``, written once and read back; ``release`` deletes what was written."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
