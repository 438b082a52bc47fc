"""Working tables: data written once to a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else one in the warehouse.

    Both are shared by the driver and all executors, whatever the master is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_noteflow_work"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path that only this call uses; it is removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/noteflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut.

    A later reader that loses an executor reads the files again and repeats nothing
    before them.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
