"""File-system inventories, logs and client folders as DataFrames, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.paths import valid_client


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, kind, size and mtime (seconds) of the files under a root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(F.regexp_replace("path", "^[a-z0-9]+:(?://[^/]*)?", "").alias("path"), F.lit("f").alias("kind"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def with_folders(files: DataFrame) -> DataFrame:
    """The files and an entry of kind d for each of their ancestors."""
    from stowage.functions.paths import ancestors

    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("d").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
    return files.unionByName(dirs)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """line of each log under a path, plain or gzipped, with the file it stands in."""
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """client, bno and text of each backup's timestamp file below root/client/backup."""
    found = spark.read.text(f"{root}/*/*/timestamp").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("stamp"))
    rows = found.select(F.regexp_extract("file", "([^/]+)/([^/]+)/timestamp$", 1).alias("client"), F.regexp_extract("file", "([^/]+)/([^/]+)/timestamp$", 2).alias("folder"), "stamp")
    return rows.where(F.col("folder").rlike("^[0-9]") & (F.substring("folder", 1, 8) == F.substring("stamp", 1, 8)) & valid_client(F.col("client"))).select("client", F.substring("folder", 1, 7).cast("long").alias("bno"), "stamp")
