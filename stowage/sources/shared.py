"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder in local mode, and else one in the warehouse,
    which executors share as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="spark-stowage-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stowage_cuts"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back, so that lost executors cost no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    # Tasks put their files in place themselves: nobody reads the folder before the job has ended, so the driver needn't move each one.
    df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` returned, once all that reads them has been written."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
